"""Receptors, surfaces and pockets on the driver's tables, each beside its SQL.

``embeddings`` stand for atoms: five to a residue, names, residues and elements by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import covalent
from quarry.functions import metrics as m
from quarry.operators import pockets, receptors, spatial, surface

from .queries import POINTS, points, query, rounded, table

NAMES = ["ASP", "HOH", "CYS", "ZN", "HEM", "LIG", "GLY", "SO4", "SER", "XYZ", "ALA", "MSE"]
ATOM_NAMES = ["N", "CA", "C", "SG", "CB"]
ELEMENTS = ["N", "C", "C", "S", "H"]


def pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def atoms(spark, sf_dir) -> DataFrame:
    k = F.floor(F.col("atom") / 5)
    p = points(spark, sf_dir).withColumns({"res_id": k.cast("int"), "res_name": pick(NAMES, F.pmod(k, F.lit(len(NAMES)))), "name": pick(ATOM_NAMES, F.pmod("atom", F.lit(5))), "element": pick(ELEMENTS, F.pmod("atom", F.lit(5)))})
    p = p.withColumn("chain", F.when(F.pmod("res_id", F.lit(2)) == 0, "A").otherwise("B"))
    return p.withColumn("radius", m.radius_of(F.col("element"))).withColumn("covalent", F.when(F.col("element") == "H", 0.31).otherwise(0.76))


RATOMS = POINTS + f""", ratoms AS (SELECT *, {NAMES}[CAST(res_id % {len(NAMES)} AS INTEGER) + 1] AS res_name, {ATOM_NAMES}[CAST(atom % 5 AS INTEGER) + 1] AS name, {ELEMENTS}[CAST(atom % 5 AS INTEGER) + 1] AS element, [1.55, 1.7, 1.7, 1.8, 1.2][CAST(atom % 5 AS INTEGER) + 1]::DOUBLE AS radius,
 CASE WHEN res_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, CASE WHEN atom % 5 = 4 THEN 0.31 ELSE 0.76 END::DOUBLE AS covalent FROM (SELECT *, CAST(floor(atom / 5) AS INTEGER) AS res_id FROM points))
"""
SPHERE = """, sphere AS (SELECT sqrt(1 - z * z) * cos(2.399963229728653 * id) AS px, sqrt(1 - z * z) * sin(2.399963229728653 * id) AS py, z AS pz FROM (SELECT range AS id, 1 - 2 * (range + 0.5::DOUBLE) / 92 AS z FROM range(92)))
"""


def area_sql(own: str, covers: str, same: str = "c.atom <> a.atom", keys: str = "label") -> str:
    """Area of each atom of ``own``: the share of its sphere that no atom of ``covers`` reaches."""
    on = " AND ".join(f"c.{k} = a.{k}" for k in keys.split(","))
    return f"""(SELECT a.*, (SELECT count(*) FROM sphere s WHERE NOT EXISTS (SELECT 1 FROM {covers} c WHERE {on} AND {same} AND pow(c.x - a.x - (a.radius + 1.4::DOUBLE) * s.px, 2) + pow(c.y - a.y - (a.radius + 1.4::DOUBLE) * s.py, 2) + pow(c.z - a.z - (a.radius + 1.4::DOUBLE) * s.pz, 2) < pow(c.radius + 1.4::DOUBLE, 2))) / 92::DOUBLE
  * 4 * pi() * pow(a.radius + 1.4::DOUBLE, 2) AS area FROM {own} a)"""


@query(POINTS + """, sa AS (SELECT *, [1.7, 1.55, 1.52, 1.8][CAST(atom % 4 AS INTEGER) + 1]::DOUBLE AS radius FROM points)""" + SPHERE + "SELECT label, atom, round(area, 4) AS sasa FROM " + area_sql("sa", "sa"))
def atom_sasa(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("radius", m.radius_of(pick(list("CNOS"), F.pmod("atom", F.lit(4)))))
    return rounded(spatial.sasa(p.select("label", "atom", "x", "y", "z", "radius"), ["label"]), "sasa", places=4)


@query(RATOMS + SPHERE + "SELECT label, chain, res_id, res_name, count(*) AS atoms, round(sum(area), 3) AS area FROM " + area_sql("ratoms", "ratoms") + " GROUP BY ALL")
def residue_sasa(spark, sf_dir):
    return rounded(surface.residue_areas(atoms(spark, sf_dir), ["label"]), "area", places=3)


HALVES = ", lig AS (SELECT * FROM ratoms WHERE atom % 4 = 0), rec AS (SELECT * FROM ratoms WHERE atom % 4 <> 0), allatoms AS (SELECT * FROM ratoms)\n"


def halves(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return a.where("atom % 4 = 0"), a.where("atom % 4 <> 0")


@query(RATOMS + SPHERE + """, cut AS (SELECT label, chain, res_id, res_name, sum(area) AS r FROM """ + area_sql("ratoms", "ratoms", "c.atom <> a.atom", "label,chain,res_id,res_name") + """ GROUP BY ALL),
whole AS (SELECT label, chain, res_id, res_name, count(*) AS atoms, sum(area) AS area FROM """ + area_sql("ratoms", "ratoms") + """ GROUP BY ALL)
SELECT label, chain, res_id, res_name, atoms, round(area, 3) AS area, round(r, 3) AS reference_area, round(greatest(0, r - area), 3) AS buried_area, round(least(1, greatest(0, r - area) / r), 4) AS buried_fraction FROM whole JOIN cut USING (label, chain, res_id, res_name)""")
def burial_free(spark, sf_dir):
    out = surface.burial(atoms(spark, sf_dir), ["label"])
    return rounded(rounded(out, "area", "reference_area", "buried_area", places=3), "buried_fraction", places=4)


@query(RATOMS + HALVES + SPHERE + """, free AS (SELECT label, atom, area AS f FROM """ + area_sql("lig", "lig") + """), bound AS (SELECT label, atom, area AS b FROM """ + area_sql("lig", "allatoms") + """)
SELECT label, round(sum(f), 3) AS free_area, round(sum(b), 3) AS complex_area, count(*) AS ligand_atoms, count(*) FILTER (b < f - 1e-9) AS contact_atoms, round(greatest(0, sum(f) - sum(b)), 3) AS buried_area, round(greatest(0, sum(f) - sum(b)) / sum(f), 4) AS buried_fraction FROM free JOIN bound USING (label, atom) GROUP BY label""")
def ligand_buried_contact(spark, sf_dir):
    out = surface.buried_contact(*halves(spark, sf_dir), ["label"])
    return rounded(rounded(out, "free_area", "complex_area", "buried_area", places=3), "buried_fraction", places=4)


@query(RATOMS + HALVES + ", poses AS (SELECT *, CAST(atom % 3 AS INTEGER) AS pose FROM lig), others AS (SELECT r.label, p.pose, r.atom, r.x, r.y, r.z, r.radius FROM rec r JOIN (SELECT DISTINCT label, pose FROM poses) p USING (label) UNION ALL SELECT label, pose, atom, x, y, z, radius FROM poses)" + SPHERE + """, free AS (SELECT label, pose, atom, area AS f FROM """
       + area_sql("poses", "poses", keys="label,pose") + "), bound AS (SELECT label, pose, atom, area AS b FROM " + area_sql("poses", "others", keys="label,pose") + """)
SELECT label, pose, round(greatest(0, sum(f) - sum(b)), 3) AS buried_area, count(*) AS ligand_atoms FROM free JOIN bound USING (label, pose, atom) GROUP BY label, pose""")  # fmt: skip
def buried_contact_per_pose(spark, sf_dir):
    lig, rec = halves(spark, sf_dir)
    out = surface.buried_contact(lig.withColumn("pose", F.pmod("atom", F.lit(3)).cast("int")), rec, ["label", "pose"], on=["label"])
    return rounded(out.select("label", "pose", "buried_area", "ligand_atoms"), "buried_area", places=3)


BOTH_SIDES = """, lf AS (SELECT label, sum(area) AS v FROM """ + area_sql("lig", "lig") + " GROUP BY label), lb AS (SELECT label, sum(area) AS v FROM " + area_sql("lig", "allatoms") + " GROUP BY label), rf AS (SELECT label, sum(area) AS v, count(*) AS n FROM " + area_sql("rec", "rec") + " GROUP BY label), rb AS (SELECT label, sum(area) AS v FROM " + area_sql("rec", "allatoms") + " GROUP BY label)\n"


@query(RATOMS + HALVES + SPHERE + BOTH_SIDES + "SELECT label, round(rf.v, 3) AS free_area, rf.n AS receptor_atoms, round(rb.v, 3) AS complex_area, round(greatest(0, rf.v - rb.v), 3) AS buried_area FROM rf JOIN rb USING (label)")
def interface_area(spark, sf_dir):
    lig, rec = halves(spark, sf_dir)
    return rounded(surface.interface_area(rec, lig, ["label"]), "free_area", "complex_area", "buried_area", places=3)


@query(RATOMS + HALVES + SPHERE + BOTH_SIDES + "SELECT label, round(greatest(0, lf.v - lb.v), 3) AS ligand, round(greatest(0, rf.v - rb.v), 3) AS receptor, round(greatest(0, lf.v - lb.v) + greatest(0, rf.v - rb.v), 3) AS total FROM lf JOIN lb USING (label) JOIN rf USING (label) JOIN rb USING (label)")
def buried_area(spark, sf_dir):
    return rounded(surface.buried_area(*halves(spark, sf_dir), ["label"]), "ligand", "receptor", "total", places=3)


POLAR = "least(1::DOUBLE, abs(charge) / 0.5::DOUBLE)"


@query(RATOMS + HALVES + SPHERE + f", b AS (SELECT label, CASE WHEN abs(charge) > 0 THEN {POLAR} WHEN element IN ('N', 'O', 'S') THEN 0.35::DOUBLE ELSE 0 END AS p, 1 - least(1::DOUBLE, area / 35) AS q FROM " + area_sql("lig", "allatoms") + ") SELECT label, round(avg(p * q), 5) AS desolvation, count(*) FILTER (p >= 0.5 AND q >= 0.5) AS buried_polar, count(*) AS n_atoms FROM b GROUP BY label")
def complex_desolvation(spark, sf_dir):
    lig, rec = halves(spark, sf_dir)
    return rounded(surface.polar_burial(lig.withColumn("polarity", m.polarity(F.col("element"), F.col("charge"))), ["label"], rec), "desolvation", places=5)


@query(RATOMS + HALVES + ", pair AS (SELECT l.label, l.atom, least(1, sum(greatest(0, 0.9::DOUBLE * (l.radius + r.radius) - sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2))))) AS v FROM lig l JOIN rec r ON l.label = r.label GROUP BY l.label, l.atom) SELECT label, round(avg(coalesce(v, 0)), 5) AS overlap FROM lig LEFT JOIN pair USING (label, atom) GROUP BY label")
def overlap_penalty(spark, sf_dir):
    return rounded(surface.overlap_penalty(*halves(spark, sf_dir), ["label"]), "overlap", places=5)


# -- residues --------------------------------------------------------------------------------------------

KINDS = RATOMS + f""", res AS (SELECT label, chain, res_id, res_name, count(*) AS atoms, count(*) FILTER (element <> 'H') AS heavy_atoms, sum(CASE element WHEN 'C' THEN 12.011 WHEN 'N' THEN 14.007 WHEN 'S' THEN 32.06 ELSE 0 END::DOUBLE) * 1.0 AS mass FROM ratoms GROUP BY ALL),
het AS (SELECT *, CASE WHEN res_name = 'HOH' THEN 'solvent' WHEN res_name = 'HEM' THEN 'cofactor' WHEN res_name IN ('ZN', 'SO4') THEN 'ion' WHEN heavy_atoms > 1 AND mass > {receptors.LIGAND_MASS} THEN 'ligand' ELSE 'other' END AS kind FROM res WHERE res_name NOT IN ('ASP', 'CYS', 'GLY', 'SER', 'ALA', 'MSE'))
"""


@query(KINDS + "SELECT label, chain, res_id, res_name, atoms, heavy_atoms, round(mass, 3) AS mass, kind FROM het")
def classify_hetero(spark, sf_dir):
    return rounded(receptors.hetero_residues(atoms(spark, sf_dir), ["label"]), "mass", places=3)


@query(KINDS + """, wet AS (SELECT DISTINCT a.label, a.chain, a.res_id, a.res_name FROM ratoms a JOIN het h USING (label, chain, res_id, res_name) WHERE h.kind = 'solvent' AND EXISTS (SELECT 1 FROM ratoms b WHERE b.label = a.label AND b.res_name IN ('LIG', 'XYZ') AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 4))
SELECT a.label, atom FROM ratoms a LEFT JOIN het h USING (label, chain, res_id, res_name) WHERE h.kind IS NULL OR res_name = 'SO4' OR h.kind = 'cofactor' OR res_name IN ('LIG', 'XYZ') OR EXISTS (SELECT 1 FROM wet w WHERE w.label = a.label AND w.chain = a.chain AND w.res_id = a.res_id AND w.res_name = a.res_name)""")
def clean_receptor(spark, sf_dir):
    """Residues LIG and XYZ count as ligands here by being named; their stand-in atoms weigh too little for the rule."""
    a = atoms(spark, sf_dir)
    near = receptors.clean_receptor(a, ["label"], keep=("SO4",), drop=("HOH",))
    waters = a.where("res_name = 'HOH'")
    wet = spatial.range_join(waters.select("label", *receptors.RESIDUE, "x", "y", "z"), a.where("res_name in ('LIG', 'XYZ')").select("label", "x", "y", "z"), 2.0, ["label"]).select("label", *[F.col(f"a_{c}").alias(c) for c in receptors.RESIDUE]).distinct()
    return near.select("label", "atom").unionByName(waters.join(wet, ["label", *receptors.RESIDUE], "left_semi").select("label", "atom"))


@query(RATOMS + """, want AS (SELECT DISTINCT label, chain, res_id, res_name, unnest(CASE res_name WHEN 'ASP' THEN ['N', 'CA', 'C', 'O', 'CB', 'CG', 'OD1', 'OD2'] WHEN 'CYS' THEN ['N', 'CA', 'C', 'O', 'CB', 'SG'] WHEN 'GLY' THEN ['N', 'CA', 'C', 'O'] WHEN 'SER' THEN ['N', 'CA', 'C', 'O', 'CB', 'OG'] ELSE ['N', 'CA', 'C', 'O', 'CB'] END) AS name
  FROM (SELECT DISTINCT label, chain, res_id, res_name FROM ratoms WHERE res_name IN ('ASP', 'CYS', 'GLY', 'SER', 'ALA')))
SELECT label, chain, res_id, res_name, array_to_string(list_sort(list(name)), ',') AS missing FROM want w WHERE NOT EXISTS (SELECT 1 FROM ratoms a WHERE a.label = w.label AND a.chain = w.chain AND a.res_id = w.res_id AND a.res_name = w.res_name AND a.name = w.name) GROUP BY ALL""")
def missing_atoms(spark, sf_dir):
    return receptors.missing_atoms(atoms(spark, sf_dir), ["label"]).withColumn("missing", F.array_join("missing", ","))


BONDS = RATOMS + ", bonds AS (SELECT a.label, a.atom AS i, b.atom AS j FROM ratoms a JOIN ratoms b ON a.label = b.label AND a.res_id = b.res_id AND a.atom < b.atom AND b.atom % 5 IN (1, 4) AND a.atom % 5 <> 4)\n"


def bonds(spark, sf_dir):
    a = atoms(spark, sf_dir)
    x, y = a.select("label", "res_id", F.col("atom").alias("i")), a.select("label", "res_id", F.col("atom").alias("j"))
    return x.join(y, ["label", "res_id"]).where("i < j and j % 5 in (1, 4) and i % 5 <> 4").select("label", "i", "j")


@query(BONDS + "SELECT h.label, h.atom, p.atom AS parent, p.element AS parent_element, p.element IN ('N', 'O', 'S') AS polar FROM ratoms h JOIN bonds b ON b.label = h.label AND b.j = h.atom JOIN ratoms p ON p.label = b.label AND p.atom = b.i WHERE h.element = 'H'")
def hydrogens(spark, sf_dir):
    return receptors.hydrogens(atoms(spark, sf_dir), bonds(spark, sf_dir), ["label"])


@query(BONDS + """, gone AS (SELECT h.label, h.atom, p.atom AS parent, h.charge FROM ratoms h JOIN bonds b ON b.label = h.label AND b.j = h.atom JOIN ratoms p ON p.label = b.label AND p.atom = b.i WHERE h.element = 'H' AND p.element = 'C')
SELECT a.label, a.atom, round(a.charge + coalesce((SELECT sum(g.charge) FROM gone g WHERE g.label = a.label AND g.parent = a.atom), 0), 6) AS charge FROM ratoms a WHERE (a.label, a.atom) NOT IN (SELECT label, atom FROM gone)""")
def strip_nonpolar_hydrogens(spark, sf_dir):
    out = receptors.without_nonpolar_hydrogens(atoms(spark, sf_dir), bonds(spark, sf_dir), ["label"])
    return rounded(out.select("label", "atom", "charge"), "charge")


GROUPS = RATOMS + ", grp AS (SELECT label, res_id AS g, atom, CAST(res_id % 3 AS DOUBLE) - 1 AS expected, charge FROM ratoms)\n"


def groups(spark, sf_dir):
    return atoms(spark, sf_dir).select("label", F.col("res_id").alias("group"), "atom", (F.pmod("res_id", F.lit(3)) - 1).cast("double").alias("expected"), "charge")


@query(GROUPS + "SELECT label, g AS \"group\", min(expected) AS expected, round(sum(charge), 6) AS observed, count(*) AS n, CASE WHEN min(expected) = 0 THEN true ELSE sign(sum(charge)) = sign(min(expected)) AND abs(sum(charge)) >= 0.5 END AS possible, abs(min(expected) - sum(charge)) >= 1e-9 AS disagrees FROM grp GROUP BY label, g")
def formal_charges(spark, sf_dir):
    return rounded(receptors.group_charges(groups(spark, sf_dir), ["label"]), "observed")


@query(GROUPS + "SELECT label, atom, round(CASE WHEN expected <> 0 AND abs(expected - s) >= 1e-9 THEN charge + (expected - s) / n ELSE charge END, 6) AS charge FROM (SELECT *, sum(charge) OVER (PARTITION BY label, g) AS s, count(*) OVER (PARTITION BY label, g) AS n FROM grp)")
def correct_formal_charges(spark, sf_dir):
    return rounded(receptors.corrected_charges(groups(spark, sf_dir), ["label"]).select("label", "atom", "charge"), "charge")


@query(RATOMS + "SELECT g.label, g.res_id AS \"group\", r.atom, round(min(sqrt(pow(g.x - r.x, 2) + pow(g.y - r.y, 2) + pow(g.z - r.z, 2))), 5) AS distance FROM ratoms g JOIN ratoms r ON g.label = r.label AND g.atom % 4 = 0 AND r.atom % 4 <> 0 AND g.charge * r.charge < 0 WHERE pow(g.x - r.x, 2) + pow(g.y - r.y, 2) + pow(g.z - r.z, 2) <= 16 GROUP BY ALL")
def salt_bridges(spark, sf_dir):
    lig, rec = halves(spark, sf_dir)
    return rounded(receptors.salt_bridges(lig.select("label", F.col("res_id").alias("group"), "x", "y", "z", "charge"), rec, ["label"]), "distance", places=5)


CENTRES = RATOMS + ", near AS (SELECT a.label, chain, res_id, res_name, min(sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2))) AS d FROM ratoms a JOIN (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ratoms GROUP BY label) c ON a.label = c.label GROUP BY ALL)\n"


def centres(a):
    return a.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"])


@query(CENTRES + "SELECT label, chain, res_id, res_name, round(d, 5) AS distance FROM near WHERE d <= 2")
def residues_within(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return rounded(receptors.residues_within(a, centres(a), ["label"], 2.0), "distance", places=5)


@query(CENTRES + "SELECT label, chain, res_id, res_name, round(d, 5) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY d, chain, res_id, res_name) AS INTEGER) AS rank FROM near WHERE d <= 3) WHERE rank <= 10")
def select_site(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return rounded(receptors.site_residues(a, centres(a), ["label"], 3.0, 10), "distance", places=5)


@query("SELECT p_partkey, chain, res_id, res_name FROM (SELECT p_partkey, unnest(['A', '', 'B']) AS chain, unnest([p_size, p_size + 1, 7]) AS res_id, unnest(['ASP', NULL, 'GLY']) AS res_name FROM part)")
def parse_site_spec(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    spec = F.concat(F.lit("a:asp"), F.col("p_size").cast("string"), F.lit("; "), (F.col("p_size") + 1).cast("string"), F.lit(" ,, b/GLY7"))
    return p.select("p_partkey", F.explode(receptors.site_spec(spec)).alias("s")).select("p_partkey", "s.chain", "s.res_id", "s.res_name")


@query(RATOMS + """, w AS (SELECT * FROM ratoms WHERE atom % 7 = 0), ra AS (SELECT w.label, w.atom AS water, min((sqrt(pow(w.x - r.x, 2) + pow(w.y - r.y, 2) + pow(w.z - r.z, 2)), r.atom)) AS m FROM w JOIN ratoms r ON w.label = r.label AND r.atom % 7 IN (1, 2) WHERE pow(w.x - r.x, 2) + pow(w.y - r.y, 2) + pow(w.z - r.z, 2) <= 2.25 GROUP BY ALL),
la AS (SELECT w.label, w.atom AS water, min((sqrt(pow(w.x - r.x, 2) + pow(w.y - r.y, 2) + pow(w.z - r.z, 2)), r.atom)) AS m FROM w JOIN ratoms r ON w.label = r.label AND r.atom % 7 IN (3, 4) WHERE pow(w.x - r.x, 2) + pow(w.y - r.y, 2) + pow(w.z - r.z, 2) <= 2.25 GROUP BY ALL)
SELECT label, water, ra.m[2] AS a, la.m[2] AS b, round(least(ra.m[1], la.m[1]), 5) AS distance FROM ra JOIN la USING (label, water)""")
def water_mediated(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return rounded(receptors.water_bridges(a.where("atom % 7 = 0"), a.where("atom % 7 in (1, 2)"), a.where("atom % 7 in (3, 4)"), ["label"], 1.5), "distance", places=5)


@query(RATOMS + "SELECT a.label, a.chain, a.res_id, a.res_name, a.atom, a.x, a.y, a.z, b.atom AS anchor FROM ratoms a LEFT JOIN ratoms b ON a.label = b.label AND a.res_id = b.res_id AND b.name = 'CB' WHERE a.res_name = 'CYS' AND a.name = 'SG'")
def perceive_nucleophiles(spark, sf_dir):
    return receptors.nucleophiles(atoms(spark, sf_dir), ["label"])


@query(RATOMS + """, n AS (SELECT p.label, p.atom AS point, min((pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2), 'p' || c.res_name, c.chain)) AS m FROM ratoms p JOIN ratoms c ON p.label = c.label AND p.atom % 6 = 0 AND c.atom % 6 = 1 WHERE pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2) <= 1 GROUP BY ALL)
SELECT p.label, p.atom AS point, m[2] AS "pocket", coalesce(m[3], 'bulk') AS kind FROM ratoms p LEFT JOIN n ON n.label = p.label AND n.point = p.atom WHERE p.atom % 6 = 0""")
def classify_points(spark, sf_dir):
    a = atoms(spark, sf_dir)
    p = a.where("atom % 6 = 0").select(F.col("label").alias("s"), F.col("atom").alias("point"), "x", "y", "z")
    c = a.where("atom % 6 = 1").select(F.col("label").alias("s"), F.concat(F.lit("p"), "res_name").alias("label"), F.col("chain").alias("kind"), "x", "y", "z")
    return receptors.classify_points(p, c, ["s"], 1.0).select(F.col("s").alias("label"), "point", F.col("label").alias("pocket"), "kind")


@query(RATOMS + ", c AS (SELECT p.label, p.atom AS point, min(sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2) + pow(p.z - a.z, 2)) - a.radius) AS c FROM ratoms p JOIN ratoms a ON p.label = a.label AND p.atom % 6 = 0 AND a.atom % 6 <> 0 GROUP BY ALL) SELECT label, -max((c, -point))[2] AS point, round(max(c), 5) AS clearance FROM c GROUP BY label")
def clearest_point(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return rounded(receptors.clearest_points(a.where("atom % 6 = 0").withColumnRenamed("atom", "point"), a.where("atom % 6 <> 0"), ["label"]), "clearance", places=5)


PERCEIVED = RATOMS + ", b AS (SELECT a.label, a.atom AS i, c.atom AS j, sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2)) AS d, a.covalent + c.covalent AS r FROM ratoms a JOIN ratoms c ON a.label = c.label AND a.atom < c.atom), bonds AS (SELECT label, i, j, d FROM b WHERE d < 0.6::DOUBLE * r)\n"


@query(PERCEIVED + "SELECT label, i, j, round(d, 5) AS length FROM bonds")
def perceive_bonds(spark, sf_dir):
    return rounded(receptors.perceived_bonds(atoms(spark, sf_dir), ["label"], 0.6), "length", places=5)


@query(PERCEIVED + """, one AS (SELECT label, i, j FROM bonds UNION SELECT label, j, i FROM bonds), two AS (SELECT DISTINCT x.label, x.i, y.j FROM one x JOIN one y ON x.label = y.label AND x.j = y.i WHERE x.i <> y.j), three AS (SELECT DISTINCT x.label, x.i, y.j FROM two x JOIN one y ON x.label = y.label AND x.j = y.i WHERE x.i <> y.j)
SELECT label, i, j, CAST(min(s) AS INTEGER) AS steps FROM (SELECT *, 1 AS s FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) WHERE i < j GROUP BY label, i, j""")
def bonded_within(spark, sf_dir):
    return receptors.bonded_within(receptors.perceived_bonds(atoms(spark, sf_dir), ["label"], 0.6), ["label"])


# -- covalent attack -------------------------------------------------------------------------------------

ATTACK = """WITH g AS (SELECT p_partkey, 1.2::DOUBLE + (p_partkey % 37) / 10::DOUBLE AS d, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE 60::DOUBLE + p_size * 2 END AS a FROM part),
q AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE (CASE WHEN greatest(0, d - 4) >= 0.6::DOUBLE THEN 0 ELSE 0.5::DOUBLE * (1 + cos(pi() * greatest(0, d - 4) / 0.6::DOUBLE)) END) * (CASE WHEN greatest(0, 90 - a, a - 125) >= 20 THEN 0 ELSE 0.5::DOUBLE * (1 + cos(pi() * greatest(0, 90 - a, a - 125) / 20)) END) END AS quality,
 0.5::DOUBLE * (1 - cos(pi() * greatest(0, least(1, (2 - d) / 0.5::DOUBLE)))) AS bond FROM g), t AS (SELECT *, -(3 * quality + 5 * bond * quality) + 0.03::DOUBLE * pow(coalesce(greatest(0, abs(a - 109.5::DOUBLE) - 10), 0), 2) * bond AS term FROM q)
"""


def attacks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = F.lit(1.2) + F.pmod("p_partkey", F.lit(37)) / 10.0
    a = F.when(F.pmod("p_partkey", F.lit(50)) == 0, None).otherwise(60.0 + F.col("p_size") * 2)
    low, high = F.lit(90.0), F.lit(125.0)
    g = p.select("p_partkey", d.alias("d"), a.alias("a"))
    d, a = F.col("d"), F.col("a")
    return g.withColumns({"quality": covalent.quality(d, a, low, high), "bond": covalent.bond_fraction(d), "class": covalent.attack_class(d, a, low, high), "reason": covalent.attack_reason(d, a, low, high)})


@query(ATTACK + """SELECT p_partkey, round(quality, 6) AS quality, round(bond, 6) AS bond, round(term, 6) AS term, round(term - 7, 6) AS score, CASE WHEN a IS NULL THEN 'non_productive' WHEN d <= 2 + 1e-9 AND a BETWEEN 90 AND 125 THEN 'bonded' WHEN d <= 4 + 1e-9 AND a BETWEEN 90 AND 125 THEN 'near_attack' ELSE 'non_productive' END AS class,
CASE WHEN a IS NULL THEN 'undefined angle' WHEN d <= 4 + 1e-9 AND a BETWEEN 90 AND 125 THEN '' WHEN d > 4 THEN 'out of reach' ELSE 'angle outside the window' END AS reason FROM t""")
def covalent_attack(spark, sf_dir):
    g = attacks(spark, sf_dir)
    term = covalent.covalent_term(F.col("quality"), F.col("bond"), F.col("a"))
    out = g.withColumn("term", term).withColumn("score", covalent.covalent_score(F.lit(-7.0), F.col("quality"), F.col("bond"), F.col("a")))
    return rounded(out, "quality", "bond", "term", "score").select("p_partkey", "quality", "bond", "term", "score", "class", "reason")


@query(ATTACK + "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY -d, p_partkey) AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY round(-d + term, 9), p_partkey) AS INTEGER) AS covalent_rank FROM t")
def covalent_ranking(spark, sf_dir):
    from quarry.operators import ranking

    g = attacks(spark, sf_dir).withColumn("pocket", F.pmod("p_partkey", F.lit(20))).withColumn("plain", -F.col("d"))
    g = g.withColumn("with", F.round(F.col("plain") + covalent.covalent_term(F.col("quality"), F.col("bond"), F.col("a")), 9))
    g = ranking.ranked(ranking.ranked(g, "plain", ["pocket"], ["p_partkey"]), "with", ["pocket"], ["p_partkey"], out="covalent_rank")
    return g.select("p_partkey", "rank", "covalent_rank")


@query("""WITH s AS (SELECT i, 1.5::DOUBLE + 3 * i / 40::DOUBLE AS d FROM (SELECT unnest(range(41)) AS i)), t AS (SELECT *, CASE WHEN greatest(0, d - 4) >= 0.6::DOUBLE THEN 0 ELSE 0.5::DOUBLE * (1 + cos(pi() * greatest(0, d - 4) / 0.6::DOUBLE)) END AS q, 0.5::DOUBLE * (1 - cos(pi() * greatest(0, least(1, (2 - d) / 0.5::DOUBLE)))) AS b FROM s), e AS (SELECT *, -(3 * q + 5 * b * q) AS term FROM t)
SELECT CAST(i AS INTEGER) AS i, round(term, 6) AS term, round(abs(term - lag(term) OVER (ORDER BY i)), 6) AS step FROM e""")
def continuity_scan(spark, sf_dir):
    """The covalent term along a distance, and how much it moves from sample to sample."""
    from pyspark.sql import Window

    d, a = F.col("d"), F.lit(109.5)
    s = spark.range(41).select(F.col("id").cast("int").alias("i"), (1.5 + 3 * F.col("id") / 40.0).alias("d"))
    term = covalent.covalent_term(covalent.quality(d, a, F.lit(90.0), F.lit(125.0)), covalent.bond_fraction(d), a)
    s = s.withColumn("term", term)
    return rounded(s.withColumn("step", F.abs(F.col("term") - F.lag("term").over(Window.orderBy("i")))).drop("d"), "term", "step")


# -- pockets ---------------------------------------------------------------------------------------------

TRACKS = """WITH t AS (SELECT l_suppkey AS s, l_partkey % 15 AS track, l_linenumber AS c, avg(l_quantity) AS q, avg(l_tax) AS tax, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
r AS (SELECT s, CAST(track AS INTEGER) AS track, CAST(c AS VARCHAR) AS c, CASE WHEN flag <> 'A' THEN q * 6 END AS volume, q * CASE WHEN flag <> 'A' THEN 4 ELSE tax * 50 END AS free, CAST(track AS DOUBLE) + 5 AS noise, CASE WHEN track % 4 = 0 THEN NULL ELSE (track % 10) / 10::DOUBLE END AS stability FROM t),
g AS (SELECT s, track, count(*) AS n, count(volume) AS k, coalesce(bool_or(volume IS NOT NULL) FILTER (c = '1'), false) AS ref, max(volume) AS vmax, min(volume) AS vmin, max(free) AS fmax, min(free) AS fmin, max(free) FILTER (volume IS NOT NULL) AS p, max(free) FILTER (volume IS NULL) AS a, min(noise) AS noise, min(stability) AS stability FROM r GROUP BY s, track),
h AS (SELECT *, CASE WHEN p IS NULL OR a IS NULL THEN NULL WHEN p <= 0 THEN 0 ELSE a / p END AS closure FROM g),
i AS (SELECT *, coalesce(closure < 0.2, false) AS closed, coalesce(closure >= 0.8, false) AS artefact, coalesce(closure >= 0.2 AND closure < 0.8, false) AS narrowed, fmax - fmin > 2 * noise AS changing FROM h),
j AS (SELECT *, coalesce(stability >= 0.6, true) AND NOT artefact AND changing AND (NOT (vmin < 100) OR closed) AS confident FROM i)
"""


def track_rows(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    t = line.groupBy(F.col("l_suppkey").alias("s"), F.pmod("l_partkey", F.lit(15)).cast("int").alias("track"), F.col("l_linenumber").cast("string").alias("conformation")).agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("tax"), F.min("l_returnflag").alias("flag"))
    here = F.col("flag") != "A"
    track = F.col("track")
    return t.select("s", "track", "conformation", F.when(here, F.col("q") * 6).alias("volume"), (F.col("q") * F.when(here, 4).otherwise(F.col("tax") * 50)).alias("free"), (track.cast("double") + 5).alias("noise"), F.when(track % 4 == 0, None).otherwise(track % 10 / 10.0).alias("stability"))


@query(TRACKS + """SELECT s, track, n AS n_conformations, k AS n_found, round(vmax, 6) AS volume_max, round(fmax - fmin, 6) AS free_change, round(closure, 6) AS closure, closed AS closed_elsewhere, artefact AS presence_artefact, narrowed, changing, confident,
 coalesce(confident AND NOT narrowed AND ((k > 0 AND k < n) OR NOT ref), false) AS cryptic, round((0.5::DOUBLE + 0.5::DOUBLE * k / n) * CASE WHEN ref THEN 1 ELSE 2 END * greatest(0, least(20, (fmax - fmin) / noise)), 6) AS cryptic_score FROM j""")
def pocket_tracks(spark, sf_dir):
    t = pockets.tracks(track_rows(spark, sf_dir), ["s"], "1").withColumn("cryptic", F.coalesce("cryptic", F.lit(False)))
    return rounded(t.select("s", "track", "n_conformations", "n_found", "volume_max", "free_change", "closure", "closed_elsewhere", "presence_artefact", "narrowed", "changing", "confident", "cryptic", "cryptic_score"), "volume_max", "free_change", "closure", "cryptic_score")


@query(TRACKS + """, k AS (SELECT s, track, round((0.5::DOUBLE + 0.5::DOUBLE * k / n) * CASE WHEN ref THEN 1 ELSE 2 END * greatest(0, least(20, (fmax - fmin) / noise)), 9) AS score FROM j)
SELECT s, track, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY score DESC, track) AS INTEGER) AS rank FROM k) WHERE rank <= 5""")
def ranked_tracks(spark, sf_dir):
    t = pockets.tracks(track_rows(spark, sf_dir), ["s"], "1").withColumn("cryptic_score", F.round("cryptic_score", 9))
    return pockets.ranked_tracks(t, ["s"], 5).select("s", "track", "rank")


LININGS = "WITH o AS (SELECT l_suppkey AS s, l_partkey % 15 AS track, l_linenumber AS c, list_distinct(list(l_partkey % 7)) AS lining FROM lineitem GROUP BY ALL)\n"


def linings(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("s"), F.pmod("l_partkey", F.lit(15)).alias("track"), F.col("l_linenumber").alias("conformation")).agg(F.collect_set(F.pmod("l_partkey", F.lit(7))).alias("lining"))


@query(LININGS + ", p AS (SELECT a.s, a.track, len(list_intersect(a.lining, b.lining)) / len(list_distinct(list_concat(a.lining, b.lining)))::DOUBLE AS j FROM o a JOIN o b ON a.s = b.s AND a.track = b.track AND a.c < b.c) SELECT s, track, round(coalesce((SELECT avg(j) FROM p WHERE p.s = k.s AND p.track = k.track), 1), 6) AS lining_jaccard FROM (SELECT DISTINCT s, track FROM o) k")
def lining_jaccard(spark, sf_dir):
    return rounded(pockets.lining_agreement(linings(spark, sf_dir), ["s"]), "lining_jaccard")


@query("""WITH v AS (SELECT l_suppkey AS s, l_partkey % 15 AS track, l_linenumber AS jitter, avg(l_quantity) AS volume FROM lineitem GROUP BY ALL), n AS (SELECT s, count(DISTINCT jitter) AS n FROM v GROUP BY s),
t AS (SELECT s, track, max(volume) - min(volume) AS ch, avg(volume) AS mean, count(DISTINCT jitter) AS f FROM v GROUP BY s, track) SELECT s, round(max(ch) FILTER (f = n), 6) AS absolute, round(max(ch / mean) FILTER (f = n), 6) AS relative, round(avg(f / n::DOUBLE), 6) AS stability FROM t JOIN n USING (s) GROUP BY s""")
def detector_noise(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    v = line.groupBy(F.col("l_suppkey").alias("s"), F.pmod("l_partkey", F.lit(15)).alias("track"), F.col("l_linenumber").alias("jitter")).agg(F.avg("l_quantity").alias("volume"))
    return rounded(pockets.detector_noise(v, ["s"]), "absolute", "relative", "stability")


@query()
def match_pockets(spark, sf_dir):
    """Order decides who joins a track; a test holds it against a plain version."""
    a = atoms(spark, sf_dir)
    o = a.select(F.col("label").alias("s"), F.pmod("atom", F.lit(4)).cast("string").alias("conformation"), F.col("atom").alias("pocket"), "x", "y", "z", F.array("res_name", F.pmod("atom", F.lit(3)).cast("string")).alias("lining"))
    return pockets.match_pockets(o, ["s"], "0", 1.5, 0.3)
