"""Boxes, planes, rotations, grids, contact schemas and energies on the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import geometry
from quarry.functions import similarity as sim
from quarry.operators import simjoin, spatial, structure
from quarry.sources import records

from .queries import ATOMS, POINTS, _contacts, points, query, rounded, table
from .queries_receptors import RATOMS, atoms


@query(RATOMS + "SELECT label, count(*) FILTER (element <> 'H') AS heavy_atoms, round(sum(4::DOUBLE / 3 * pi() * pow(radius, 3)), 5) AS volume FROM ratoms GROUP BY label")
def heavy_atom_count(spark, sf_dir):
    """Heavy atoms and the volume of all atoms' spheres."""
    a = atoms(spark, sf_dir)
    return rounded(a.groupBy("label").agg(F.count_if(geometry.heavy(F.col("element"))).alias("heavy_atoms"), F.sum(geometry.sphere_volume(F.col("radius"))).alias("volume")), "volume", places=5)


@query(RATOMS + "SELECT label, " + ", ".join(f"round((max({c}) + min({c})) / 2, 6) AS c{c}, round(max({c}) - min({c}) + 8, 6) AS s{c}" for c in "xyz") + " FROM ratoms WHERE element <> 'H' AND chain = 'A' GROUP BY label")
def box_from_selection(spark, sf_dir):
    """The box of the heavy atoms of one chain, 4 to each side."""
    own = atoms(spark, sf_dir).where(geometry.heavy(F.col("element")) & (F.col("chain") == "A"))
    return rounded(spatial.bounding_box(own, ["label"], 4.0), "cx", "cy", "cz", "sx", "sy", "sz")


BOXES = RATOMS + ", g AS (SELECT label, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM ratoms GROUP BY label), b AS (SELECT *, label % 3 AS cx, CASE WHEN label % 4 = 0 THEN 50 ELSE 0 END AS cy, 0 AS cz FROM g)\n"


def _boxes(spark, sf_dir):
    a = atoms(spark, sf_dir)
    g = a.groupBy("label").agg(*[f(c).alias(p + c) for c in "xyz" for f, p in ((F.min, "l"), (F.max, "h"))])
    return a, g.withColumns({"cx": F.pmod("label", F.lit(3)).cast("double"), "cy": F.when(F.pmod("label", F.lit(4)) == 0, 50.0).otherwise(0.0), "cz": F.lit(0.0)})


@query(BOXES + "SELECT b.label, count(*) FILTER (abs(x - cx) <= 1.5 AND abs(y - cy) <= 1.5 AND abs(z - cz) <= 1.5) AS inside, CASE WHEN cx + 1.5 < lx OR cx - 1.5 > hx THEN 'x' WHEN cy + 1.5 < ly OR cy - 1.5 > hy THEN 'y' WHEN cz + 1.5 < lz OR cz - 1.5 > hz THEN 'z' ELSE '' END AS complaint FROM b JOIN ratoms r ON r.label = b.label GROUP BY ALL")
def check_box(spark, sf_dir):
    """Atoms in a box, and the axis on which a box misses its structure."""
    a, b = _boxes(spark, sf_dir)
    centre, size = [F.col(f"c{c}") for c in "xyz"], [F.lit(3.0)] * 3
    word = geometry.box_complaint(centre, size, [F.col(f"l{c}") for c in "xyz"], [F.col(f"h{c}") for c in "xyz"])
    rows = a.join(b.withColumn("complaint", word), "label")
    return rows.groupBy("label", "complaint").agg(F.count_if(geometry.inside([F.col(c) for c in "xyz"], centre, size)).alias("inside")).select("label", "inside", "complaint")


@query(RATOMS + """, k AS (SELECT label, chain, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, count(*) AS n FROM ratoms GROUP BY ALL), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM k),
p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q), r AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM p WHERE n > 3)
SELECT label, chain, round(sqrt(greatest(0, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3))), 4) AS planarity FROM r""")
def planarity(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return rounded(geometry.planarity(a, ["label", "chain"]), "planarity", places=4)


@query(POINTS + "SELECT label, atom, round(x * cos(radians(atom % 360)) - y * sin(radians(atom % 360)), 6) AS x, round(x * sin(radians(atom % 360)) + y * cos(radians(atom % 360)), 6) AS y, round(z, 6) AS z FROM points")
def set_dihedral(spark, sf_dir):
    """Points turned about the third axis, each by its own angle."""
    p = points(spark, sf_dir)
    turned = geometry.rotated([F.col(c) for c in "xyz"], [F.lit(0.0)] * 3, [F.lit(0.0), F.lit(0.0), F.lit(2.0)], F.pmod("atom", F.lit(360)).cast("double"))
    return rounded(p.select("label", "atom", *[t.alias(c) for t, c in zip(turned, "xyz", strict=True)]), "x", "y", "z")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice < l_quantity * 1000 OR (l_discount + 0.005) * 10 < exp((l_quantity * 1000 - l_extendedprice) / 1000 / 1.2::DOUBLE) AS taken FROM lineitem")
def metropolis_accept(spark, sf_dir):
    before, after = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.metropolis(before, after, (F.col("l_discount") + 0.005) * 10).alias("taken"))


GRID = POINTS + """, grid AS (SELECT s AS label, CAST(i - 3 AS INTEGER) AS ix, CAST(j - 3 AS INTEGER) AS iy, CAST(k - 3 AS INTEGER) AS iz, (i * 7 + j * 3 + k * k + s)::DOUBLE AS value FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j), (SELECT unnest(range(6)) AS k), (SELECT DISTINCT label AS s FROM points)),
c AS (SELECT p.label, atom, floor(x) + a AS ix, floor(y) + b AS iy, floor(z) + d AS iz, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE d WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w FROM points p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d))
"""


@query(GRID + "SELECT c.label, atom AS point, CASE WHEN count(value) = 8 THEN round(sum(w * value), 5) END AS value FROM c LEFT JOIN grid g ON g.label = c.label AND g.ix = c.ix AND g.iy = c.iy AND g.iz = c.iz GROUP BY c.label, atom")
def grid_eval(spark, sf_dir):
    p = points(spark, sf_dir).select("label", F.col("atom").alias("point"), "x", "y", "z")
    axis = [F.explode(F.sequence(F.lit(-3), F.lit(2)))]
    g = p.select("label").distinct().select("label", axis[0].alias("ix")).select("*", axis[0].alias("iy")).select("*", axis[0].alias("iz"))
    i, j, k = (F.col(c) + 3 for c in ("ix", "iy", "iz"))
    g = g.withColumn("value", (i * 7 + j * 3 + k * k + F.col("label")).cast("double"))
    return rounded(geometry.interpolated(p, g, ["label"]), "value", places=5)


@query("SELECT l_orderkey, l_linenumber, round(-l_quantity + l_discount - 0.0072::DOUBLE * l_extendedprice / 100 + l_tax * 3, 6) AS total, round(sqrt(1 / l_quantity), 6) AS amplitude FROM lineitem")
def endpoint_total(spark, sf_dir):
    """Interaction, electrostatics, the buried area's share and entropy added up; beside it the amplitude of a mode."""
    line = table(spark, sf_dir, "lineitem")
    total = -F.col("l_quantity") + F.col("l_discount") - 0.0072 * F.col("l_extendedprice") / 100 + F.col("l_tax") * 3
    return rounded(line.select("l_orderkey", "l_linenumber", total.alias("total"), geometry.amplitude(F.col("l_quantity")).alias("amplitude")), "total", "amplitude")


@query(ATOMS + ", k AS (SELECT label, b // 10 AS residue, count(*) AS n FROM kinds WHERE kind <> 'clash' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, residue) AS i FROM k) SELECT label, string_agg(residue::VARCHAR, ', ' ORDER BY residue) AS residues FROM r WHERE i <= 6 GROUP BY label")
def interaction_summary(spark, sf_dir):
    rows = _contacts(spark, sf_dir).withColumn("residue", F.floor(F.col("b") / 10))
    out = structure.busiest_residues(rows, ["label"], "residue", 6)
    return out.select("label", F.array_join(F.transform("residues", lambda r: r.cast("string")), ", ").alias("residues"))


@query(ATOMS + "SELECT kind, residue, CAST(row_number() OVER (ORDER BY kind, residue) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT kind, b // 10 AS residue FROM kinds)")
def observed_schema(spark, sf_dir):
    rows = _contacts(spark, sf_dir).withColumn("residue", F.floor(F.col("b") / 10))
    return structure.observed_schema(rows, ["kind", "residue"])


@query(ATOMS + "SELECT DISTINCT b.atom // 10 AS residue, kind FROM atoms b, (SELECT unnest(['clash', 'hbond', 'hydrophobic', 'salt']) AS kind) WHERE b.atom % 5 <> 0")
def receptor_schema(spark, sf_dir):
    a = points(spark, sf_dir).where("atom % 5 <> 0").withColumn("residue", F.floor(F.col("atom") / 10))
    return structure.receptor_schema(a, ["residue"], ["clash", "hbond", "hydrophobic", "salt"])


VECTORS = ATOMS + ", v AS (SELECT label, a, [count(*) FILTER (kind = 'clash'), count(*) FILTER (kind = 'hbond'), count(*) FILTER (kind = 'hydrophobic'), count(*) FILTER (kind = 'salt')] AS c FROM kinds GROUP BY ALL), p AS (SELECT x.a, y.a AS b, x.c AS cx, y.c AS cy FROM v x JOIN v y ON x.label = y.label AND x.a < y.a),\n"


@query(VECTORS + """s AS (SELECT *, list_sum([CASE WHEN cx[i] > 0 AND cy[i] > 0 THEN 1 ELSE 0 END FOR i IN [1, 2, 3, 4]]) AS k, list_sum([CASE WHEN cx[i] > 0 THEN 1 ELSE 0 END FOR i IN [1, 2, 3, 4]]) AS n, list_sum([CASE WHEN cy[i] > 0 THEN 1 ELSE 0 END FOR i IN [1, 2, 3, 4]]) AS m, list_sum([cx[i] * cy[i] FOR i IN [1, 2, 3, 4]]) AS xy, list_sum([cx[i] * cx[i] FOR i IN [1, 2, 3, 4]]) AS xx, list_sum([cy[i] * cy[i] FOR i IN [1, 2, 3, 4]]) AS yy FROM p)
SELECT a, b, round(k / (n + m - k), 6) AS tanimoto, round(2 * k / (n + m), 6) AS dice, round(xy / sqrt(xx::DOUBLE * yy), 6) AS cosine FROM s""")
def contact_similarity(spark, sf_dir):
    """Contact fingerprints of all pairs of a structure's ligand atoms that have contacts."""
    rows = _contacts(spark, sf_dir)
    v = rows.groupBy("label", "a").agg(F.array(*[F.count_if(F.col("kind") == k) for k in ("clash", "hbond", "hydrophobic", "salt")]).alias("c"))
    x = simjoin.in_parts(v.select("label", "a", F.col("c").alias("cx")), ["label"], "a", "part_x", "part_y")
    y = simjoin.in_parts(v.select("label", F.col("a").alias("b"), F.col("c").alias("cy")), ["label"], "b", "part_y", "part_x")
    p = x.join(y.hint("shuffle_hash"), ["label", "part_x", "part_y"]).where("a < b")
    return rounded(p.select("a", "b", *[sim.contact_similarity(F.col("cx"), F.col("cy"), k).alias(k) for k in ("tanimoto", "dice", "cosine")]), "tanimoto", "dice", "cosine")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 20 + 1, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 20, 3) AS y, round(CAST(embedding[3] AS DOUBLE) * 20, 3) AS z, 'LIG' AS res_name, 'OA' AS ad_type FROM embeddings")
def with_coordinates(spark, sf_dir):
    """Records with new coordinates written into their columns, read again."""
    p = points(spark, sf_dir)
    line = records.format_atom(F.pmod("atom", F.lit(100000)).cast("int"), F.lit("C"), F.lit("LIG"), F.lit("A"), F.col("label"), *[F.lit(0.0)] * 3, F.lit(1.0), F.lit(0.0), F.col("charge"), F.lit("OA"))
    moved = records.with_coordinates(line, F.round(F.col("x") + 1, 3), F.round("y", 3), F.round("z", 3))
    return records.parse_atoms(p.select(F.col("atom").alias("vec_id"), moved.alias("line"))).select("vec_id", "x", "y", "z", "res_name", "ad_type")
