"""Queries of lattices: pockets, burial, lining, and maps of energies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import lattice

from .queries import query, rounded, table

#: Vectors as atoms: three components are coordinates, ten labels are structures, and each atom is a residue of its own.
SCALE = 40.0


def structures(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    xyz = [(F.col("embedding")[n].cast("double") * SCALE).alias(c) for n, c in enumerate("xyz")]
    return e.select("label", k.alias("atom"), *xyz, (1.5 + F.pmod(k, F.lit(3)) * 0.15).alias("radius"), F.pmod(k, F.lit(4)).cast("string").alias("chain"), F.floor(k / 4).cast("int").alias("res_id"), F.concat(F.lit("R"), F.pmod(k, F.lit(7)).cast("string")).alias("res_name"))


ATOMS = """WITH RECURSIVE atoms AS (SELECT label, vec_id AS atom, CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y, CAST(embedding[3] AS DOUBLE) * 40 AS z,
  1.5::DOUBLE + (vec_id % 3) * 0.15::DOUBLE AS radius, CAST(vec_id % 4 AS VARCHAR) AS chain, vec_id // 4 AS res_id, 'R' || (vec_id % 7) AS res_name FROM embeddings)
"""

CELLS = ATOMS + """, fr AS (SELECT label, max(radius + 1.4::DOUBLE) + 1 AS pad, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM atoms GROUP BY label),
frame AS (SELECT label, lx - pad AS ox, ly - pad AS oy, lz - pad AS oz, CAST(floor(hx + pad - (lx - pad)) AS INTEGER) + 1 AS nx, CAST(floor(hy + pad - (ly - pad)) AS INTEGER) + 1 AS ny, CAST(floor(hz + pad - (lz - pad)) AS INTEGER) + 1 AS nz FROM fr),
xs AS (SELECT *, unnest(range(nx)) AS i FROM frame), ys AS (SELECT *, unnest(range(ny)) AS j FROM xs), lat AS (SELECT label, i, j, unnest(range(nz)) AS k, ox, oy, oz, nx, ny, nz FROM ys),
blocked AS (SELECT label, i, j, k FROM lat l WHERE EXISTS (SELECT 1 FROM atoms a WHERE a.label = l.label AND (ox + i - x) * (ox + i - x) + (oy + j - y) * (oy + j - y) + (oz + k - z) * (oz + k - z) <= (radius + 1.4::DOUBLE) * (radius + 1.4::DOUBLE))),
s(n) AS (VALUES (-1), (0), (1)), dirs AS (SELECT a.n AS dx, b.n AS dy, c.n AS dz FROM s a, s b, s c WHERE a.n <> 0 OR b.n <> 0 OR c.n <> 0),
looks AS (SELECT DISTINCT label, i - dx * t AS i, j - dy * t AS j, k - dz * t AS k, dx, dy, dz FROM blocked, dirs, range(1, 6) r(t)),
walled AS (SELECT l.label, l.i, l.j, l.k, count(*) AS n FROM looks l JOIN lat USING (label, i, j, k) WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.label = l.label AND b.i = l.i AND b.j = l.j AND b.k = l.k) GROUP BY ALL)
"""

CAVITIES = CELLS.replace("looks AS (", "looks AS MATERIALIZED (").replace("blocked AS (", "blocked AS MATERIALIZED (") + """, seeds AS MATERIALIZED (SELECT label, i, j, k, n, (i * 4096 + j) * 4096 + k AS cell FROM walled WHERE n / 26::DOUBLE >= 0.55::DOUBLE),
near AS MATERIALIZED (SELECT label, cell, n, i + dx AS i, j + dy AS j, k + dz AS k FROM seeds, dirs),
links AS MATERIALIZED (SELECT a.label, a.cell AS a, b.cell AS b FROM near a JOIN seeds b ON a.label = b.label AND a.i = b.i AND a.j = b.j AND a.k = b.k),
exposed AS (SELECT label, cell, count(*) AS open FROM near n SEMI JOIN lat USING (label, i, j, k) ANTI JOIN blocked USING (label, i, j, k) ANTI JOIN seeds USING (label, i, j, k) GROUP BY ALL),
comp(label, cell, system) USING KEY (label, cell) AS (SELECT label, cell, cell FROM seeds UNION SELECT l.label, l.b, min(c.system) FROM comp c JOIN links l ON l.label = c.label AND l.a = c.cell JOIN recurring.comp o ON o.label = l.label AND o.cell = l.b WHERE c.system < o.system GROUP BY l.label, l.b),
sys AS MATERIALIZED (SELECT s.*, system, max(n) OVER (PARTITION BY label, system) - n AS less FROM seeds s JOIN comp USING (label, cell)),
core AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label, system ORDER BY less, cell) AS r FROM sys WHERE less <= 3),
low AS MATERIALIZED (SELECT a.label, a.system, a.r, (SELECT list(b.r) FROM core b WHERE b.label = a.label AND b.system = a.system AND b.r < a.r AND (a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) + (a.k - b.k) * (a.k - b.k) <= 16) AS lower FROM core a),
w AS (SELECT label, system, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT label, system FROM core) UNION ALL SELECT w.label, w.system, w.r + 1, CASE WHEN lower IS NULL OR NOT list_has_any(lower, kept) THEN list_append(kept, l.r) ELSE kept END FROM w JOIN low l ON l.label = w.label AND l.system = w.system AND l.r = w.r + 1),
centres AS (SELECT c.* FROM core c JOIN (SELECT label, system, unnest(arg_max(kept, r)) AS r FROM w GROUP BY label, system) USING (label, system, r)),
parted AS MATERIALIZED (SELECT a.label, a.system, a.cell, any_value(a.i) AS i, any_value(a.j) AS j, any_value(a.k) AS k, any_value(a.n) AS n, arg_min(b.r, ((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) + (a.k - b.k) * (a.k - b.k)) * 1000000 + b.r) AS r FROM sys a JOIN centres b ON a.label = b.label AND a.system = b.system GROUP BY a.label, a.system, a.cell),
measured AS (SELECT p.label, p.system, p.r, count(*) AS n_points, avg(ox + i) AS cx, avg(oy + j) AS cy, avg(oz + k) AS cz, avg(n / 26::DOUBLE) AS burial, avg(coalesce(open, 0) / 26::DOUBLE) AS exposure FROM parted p JOIN frame USING (label) LEFT JOIN exposed USING (label, cell) GROUP BY ALL),
scored AS (SELECT *, pow(n_points / 100::DOUBLE, 1 / 3::DOUBLE) * burial * greatest(0, 1 - exposure) AS score FROM measured WHERE n_points >= 20),
found AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, n_points DESC, system, r) - 1 AS INTEGER) AS pocket FROM scored) WHERE pocket < 40),
spots AS MATERIALIZED (SELECT label, pocket, cell, ox + i AS x, oy + j AS y, oz + k AS z FROM parted JOIN found USING (label, system, r) JOIN frame USING (label))
"""
SETTINGS = {"min_volume": 20.0, "max_pockets": 40, "pocket_radius": 4.0}


@query(CELLS + "SELECT label, CAST(n AS INTEGER) AS walled, count(*) AS cells, CAST(sum(i) AS BIGINT) AS i, CAST(sum(j) AS BIGINT) AS j, CAST(sum(k) AS BIGINT) AS k FROM walled GROUP BY label, n")
def walled_directions(spark, sf_dir):
    """How many free cells see how many walls, and where."""
    atoms = structures(spark, sf_dir)
    frame = lattice.frames(atoms, ["label"], 1.0, 1.4)
    cells = lattice.walled_directions(lattice.blocked_cells(atoms, frame, ["label"]), frame, ["label"], 5)
    return cells.groupBy("label", "walled").agg(F.count("*").alias("cells"), *[F.sum(lattice.index_of(F.col("cell"), c)).alias(n) for c, n in zip("xyz", "ijk", strict=True)])


@query(CAVITIES + "SELECT label, pocket, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, CAST(n_points AS DOUBLE) AS volume, round(score, 6) AS score, n_points FROM found")
def find_pockets(spark, sf_dir):
    return rounded(lattice.find_pockets(structures(spark, sf_dir), ["label"], **SETTINGS).found, "cx", "cy", "cz", "score")


@query(CAVITIES + """, lined AS (SELECT label, pocket, list(trim(res_name || res_id || ' ' || chain) ORDER BY chain, res_id, res_name) AS lining FROM (SELECT DISTINCT s.label, s.pocket, chain, res_id, res_name FROM spots s JOIN atoms a ON a.label = s.label
  AND (s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y) + (s.z - a.z) * (s.z - a.z) <= 25) GROUP BY ALL),
unit AS (SELECT dx, dy, dz, dx / sqrt(dx * dx + dy * dy + dz * dz) AS ux, dy / sqrt(dx * dx + dy * dy + dz * dz) AS uy, dz / sqrt(dx * dx + dy * dy + dz * dz) AS uz FROM dirs),
pairs AS (SELECT s.label, s.pocket, s.cell, a.x - s.x AS gx, a.y - s.y AS gy, a.z - s.z AS gz, radius FROM spots s JOIN atoms a ON a.label = s.label),
rays AS (SELECT *, gx * ux + gy * uy + gz * uz AS along FROM pairs, unit WHERE gx * gx + gy * gy + gz * gz <= 75),
hits AS (SELECT DISTINCT label, pocket, cell, dx, dy, dz FROM rays WHERE along > 0 AND along <= 5 AND sqrt(greatest(gx * gx + gy * gy + gz * gz - along * along, 0)) < radius + 1.4::DOUBLE),
burial AS (SELECT s.label, s.pocket, avg(coalesce(h, 0) / 26::DOUBLE) AS buriedness FROM spots s LEFT JOIN (SELECT label, pocket, cell, count(*) AS h FROM hits GROUP BY ALL) USING (label, pocket, cell) GROUP BY s.label, s.pocket),
grid AS (SELECT label, pocket, cx + a.g AS x, cy + b.g AS y, cz + c.g AS z FROM found, range(-6, 7) a(g), range(-6, 7) b(g), range(-6, 7) c(g) WHERE a.g * a.g + b.g * b.g + c.g * c.g <= 36),
local AS (SELECT label, pocket, count(*)::DOUBLE AS free_volume FROM grid g WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.label = g.label AND (g.x - a.x) * (g.x - a.x) + (g.y - a.y) * (g.y - a.y) + (g.z - a.z) * (g.z - a.z) <= (radius + 1.4::DOUBLE) * (radius + 1.4::DOUBLE)) GROUP BY ALL)
SELECT label, pocket, n_points, array_to_string(coalesce(lining, []), ',') AS lining, round(buriedness, 6) AS buriedness, coalesce(free_volume, 0) AS free_volume FROM found LEFT JOIN lined USING (label, pocket) LEFT JOIN burial USING (label, pocket) LEFT JOIN local USING (label, pocket)""")
def detect_pockets(spark, sf_dir):
    found = lattice.detect_pockets(structures(spark, sf_dir), ["label"], most=1.8, **SETTINGS)
    return rounded(found.select("label", "pocket", "n_points", F.array_join("lining", ",").alias("lining"), "buriedness", "free_volume"), "buriedness")


#: Kinds of probes: radius, and what they can do.
TYPES = [("C_H", 1.9, True, False, False), ("O_A", 1.7, False, False, True), ("N_D", 1.8, False, True, False)]
BOX, SPACING, CUTOFF = 9.0, 0.75, 6.0


def field(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Boxes around the middle of each structure as lattices, atoms with their kinds, probes, and the maps."""
    k = F.col("atom")
    atoms = structures(spark, sf_dir).select("label", "x", "y", "z", "radius", (F.pmod(k, F.lit(2)) == 0).alias("hydrophobic"), (F.pmod(k, F.lit(3)) == 0).alias("donor"), (F.pmod(k, F.lit(5)) == 0).alias("acceptor"))
    boxes = atoms.groupBy("label").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"]).withColumns({f"s{c}": F.lit(BOX + n) for n, c in enumerate("xyz")})
    frame = lattice.box_frames(boxes, SPACING)
    types = spark.createDataFrame(TYPES, "type string, radius double, hydrophobic boolean, donor boolean, acceptor boolean")
    return frame, atoms, types, lattice.energy_maps(frame, atoms, types, ["label"], SPACING, CUTOFF)


def poses(spark, sf_dir) -> DataFrame:
    """Atoms of poses in the structures: three further components of the vectors, some of them outside of the boxes."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    kind = F.when(F.pmod(k, F.lit(3)) == 0, "C_H").when(F.pmod(k, F.lit(3)) == 1, "O_A").otherwise("N_D")
    return e.select("label", F.pmod(k, F.lit(12)).alias("pose"), kind.alias("type"), *[(F.col("embedding")[n + 3].cast("double") * 25).alias(c) for n, c in enumerate("xyz")])


FIELD = ATOMS + """, kinds AS (SELECT label, x, y, z, radius, atom % 2 = 0 AS hydrophobic, atom % 3 = 0 AS donor, atom % 5 = 0 AS acceptor FROM atoms),
types(type, t_radius, t_hydrophobic, t_donor, t_acceptor) AS (VALUES ('C_H', 1.9::DOUBLE, true, false, false), ('O_A', 1.7::DOUBLE, false, false, true), ('N_D', 1.8::DOUBLE, false, true, false)),
frame AS (SELECT label, avg(x) - 4.5::DOUBLE AS ox, avg(y) - 5.25::DOUBLE AS oy, avg(z) - 5.625::DOUBLE AS oz, 13 AS nx, 15 AS ny, 16 AS nz FROM kinds GROUP BY label),
lat AS (SELECT label, i, j, k, ox + i * 0.75::DOUBLE AS px, oy + j * 0.75::DOUBLE AS py, oz + k * 0.75::DOUBLE AS pz FROM frame, range(13) a(i), range(15) b(j), range(16) c(k)),
near AS (SELECT l.label, i, j, k, type, sqrt((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z)) - radius - t_radius AS s, hydrophobic AND t_hydrophobic AS hyd, (donor AND t_acceptor) OR (acceptor AND t_donor) AS hb FROM lat l JOIN kinds a ON a.label = l.label
  AND (px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z) <= 36, types),
maps AS (SELECT label, type, i, j, k, sum(-0.035579::DOUBLE * exp(-(s / 0.5::DOUBLE) * (s / 0.5::DOUBLE)) - 0.005156::DOUBLE * exp(-((s - 3) / 2) * ((s - 3) / 2)) + CASE WHEN s < 0 THEN 0.840245::DOUBLE * s * s ELSE 0 END
  + CASE WHEN hyd THEN -0.035069::DOUBLE * greatest(0, least(1, 1.5::DOUBLE - s)) ELSE 0 END + CASE WHEN hb THEN -0.587439::DOUBLE * greatest(0, least(1, s / -0.7::DOUBLE)) ELSE 0 END) AS value FROM near GROUP BY ALL)
"""


@query(FIELD + "SELECT label, type, CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iy, CAST(k AS INTEGER) AS iz, round(value, 6) AS value FROM maps")
def energy_maps(spark, sf_dir):
    return rounded(field(spark, sf_dir)[3], "value")


@query(FIELD + """, probes AS (SELECT vec_id, label, vec_id % 12 AS pose, CASE vec_id % 3 WHEN 0 THEN 'C_H' WHEN 1 THEN 'O_A' ELSE 'N_D' END AS type, CAST(embedding[4] AS DOUBLE) * 25 AS x, CAST(embedding[5] AS DOUBLE) * 25 AS y, CAST(embedding[6] AS DOUBLE) * 25 AS z FROM embeddings),
placed AS (SELECT vec_id, label, pose, type, (x - ox) / 0.75::DOUBLE AS ax, (y - oy) / 0.75::DOUBLE AS ay, (z - oz) / 0.75::DOUBLE AS az FROM probes JOIN frame USING (label)),
clamped AS (SELECT *, greatest(0, least(12, ax)) AS u, greatest(0, least(14, ay)) AS v, greatest(0, least(15, az)) AS w, 0.75::DOUBLE * (greatest(-ax, ax - 12, 0) + greatest(-ay, ay - 14, 0) + greatest(-az, az - 15, 0)) AS beyond FROM placed),
based AS (SELECT *, least(floor(u), 11) AS bu, least(floor(v), 13) AS bv, least(floor(w), 14) AS bw FROM clamped),
corners AS (SELECT vec_id, label, pose, type, CASE WHEN a.d + b.d + c.d = 0 THEN beyond * 10 ELSE 0 END AS extra, bu + a.d AS i, bv + b.d AS j, bw + c.d AS k,
  CASE a.d WHEN 1 THEN u - bu ELSE 1 - (u - bu) END * CASE b.d WHEN 1 THEN v - bv ELSE 1 - (v - bv) END * CASE c.d WHEN 1 THEN w - bw ELSE 1 - (w - bw) END AS share FROM based, range(2) a(d), range(2) b(d), range(2) c(d))
SELECT label, pose, round(sum(coalesce(value * share, 0) + extra), 6) AS energy FROM corners LEFT JOIN maps USING (label, type, i, j, k) GROUP BY label, pose""")
def map_energy(spark, sf_dir):
    frame, _, _, maps = field(spark, sf_dir)
    return rounded(lattice.map_energy(poses(spark, sf_dir), maps, frame, ["label"], ["label", "pose"], SPACING, 10.0), "energy")


@query(FIELD + """, probes AS (SELECT label, vec_id % 12 AS pose, CASE vec_id % 3 WHEN 0 THEN 'C_H' WHEN 1 THEN 'O_A' ELSE 'N_D' END AS type, CAST(embedding[4] AS DOUBLE) * 25 AS qx, CAST(embedding[5] AS DOUBLE) * 25 AS qy, CAST(embedding[6] AS DOUBLE) * 25 AS qz FROM embeddings),
met AS (SELECT p.label, pose, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)) - radius - t_radius AS s, hydrophobic AND t_hydrophobic AS hyd, (donor AND t_acceptor) OR (acceptor AND t_donor) AS hb FROM probes p JOIN types USING (type) JOIN kinds a ON a.label = p.label
  AND (qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z) <= 36),
summed AS (SELECT label, pose, sum(-0.035579::DOUBLE * exp(-(s / 0.5::DOUBLE) * (s / 0.5::DOUBLE)) - 0.005156::DOUBLE * exp(-((s - 3) / 2) * ((s - 3) / 2)) + CASE WHEN s < 0 THEN 0.840245::DOUBLE * s * s ELSE 0 END
  + CASE WHEN hyd THEN -0.035069::DOUBLE * greatest(0, least(1, 1.5::DOUBLE - s)) ELSE 0 END + CASE WHEN hb THEN -0.587439::DOUBLE * greatest(0, least(1, s / -0.7::DOUBLE)) ELSE 0 END) AS e FROM met GROUP BY ALL)
SELECT label, pose, round(coalesce(e, 0), 6) AS energy FROM (SELECT DISTINCT label, pose FROM probes) LEFT JOIN summed USING (label, pose)""")
def direct_energy(spark, sf_dir):
    _, atoms, types, _ = field(spark, sf_dir)
    return rounded(lattice.direct_energy(poses(spark, sf_dir), atoms, types, ["label"], ["label", "pose"], CUTOFF), "energy")
