"""Queries of molecules as graphs, with their SQL. Twelve vectors are the atoms of a molecule; a tree and a few more bonds follow from the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import molgraph

from .queries import query, rounded, table

KEYS = ["molecule"]


def atoms(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    element = F.when(F.col("label") == 9, "H").when(F.col("label").isin(2, 7), "N").when(F.col("label").isin(3, 5), "O").otherwise("C")
    return table(spark, sf_dir, "embeddings").select(F.floor(k / 12).alias("molecule"), F.pmod(k, F.lit(12)).alias("atom"), element.alias("element"), *[(F.col("embedding")[n].cast("double") * 20).alias(c) for n, c in enumerate("xyz")])


def bonds(spark, sf_dir) -> DataFrame:
    """Each atom but the first hangs on an earlier one; some close a ring with the atom four places before."""
    a, m = F.col("atom"), F.col("molecule")
    rows = atoms(spark, sf_dir).select("molecule", "atom", F.expr("CASE WHEN atom > 0 THEN pmod(atom * 5 + molecule, atom) END").alias("p"))
    order = F.when(F.pmod(a + m, F.lit(9)) == 0, 4).when(F.pmod(a + m, F.lit(4)) == 0, 2).otherwise(1)
    tree = rows.where("atom > 0").select("molecule", F.col("p").alias("i"), F.col("atom").alias("j"), order.alias("order"))
    ring = rows.where((a >= 4) & (F.pmod(m + a, F.lit(5)) == 0) & (F.col("p") != a - 4)).select("molecule", (a - 4).alias("i"), a.alias("j"), F.lit(1).alias("order"))
    return tree.unionByName(ring)


MOL = """WITH RECURSIVE atoms AS MATERIALIZED (SELECT vec_id // 12 AS molecule, vec_id % 12 AS atom, CASE WHEN label = 9 THEN 'H' WHEN label IN (2, 7) THEN 'N' WHEN label IN (3, 5) THEN 'O' ELSE 'C' END AS element,
  CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z FROM embeddings),
hung AS (SELECT molecule, atom, (atom * 5 + molecule) % atom AS p FROM atoms WHERE atom > 0),
bonds AS MATERIALIZED (SELECT molecule, p AS i, atom AS j, CASE WHEN (atom + molecule) % 9 = 0 THEN 4 WHEN (atom + molecule) % 4 = 0 THEN 2 ELSE 1 END AS ord FROM hung UNION ALL SELECT molecule, atom - 4, atom, 1 FROM hung WHERE atom >= 4 AND (molecule + atom) % 5 = 0 AND p <> atom - 4),
ends AS MATERIALIZED (SELECT molecule, i AS atom, j AS other, ord FROM bonds UNION ALL SELECT molecule, j, i, ord FROM bonds)
"""

CLASSES = """, cls AS (SELECT 0 AS step, molecule, atom, min(atom) OVER (PARTITION BY molecule, element) AS c FROM atoms UNION ALL
SELECT step + 1, molecule, atom, min(atom) OVER (PARTITION BY molecule, c, around) FROM (SELECT x.step, x.molecule, x.atom, x.c, list(e.ord * 100 + y.c ORDER BY e.ord * 100 + y.c) AS around FROM cls x LEFT JOIN ends e ON e.molecule = x.molecule AND e.atom = x.atom LEFT JOIN cls y ON y.molecule = e.molecule AND y.atom = e.other WHERE x.step < 12 GROUP BY x.step, x.molecule, x.atom, x.c)),
classes AS MATERIALIZED (SELECT molecule, atom, c AS symmetry FROM cls WHERE step = 12)
"""

BRIDGES = """, walk AS (SELECT molecule, i, j, i AS node FROM bonds UNION SELECT w.molecule, w.i, w.j, e.other FROM walk w JOIN ends e ON e.molecule = w.molecule AND e.atom = w.node WHERE NOT (least(e.atom, e.other) = least(w.i, w.j) AND greatest(e.atom, e.other) = greatest(w.i, w.j))),
bridges AS MATERIALIZED (SELECT molecule, least(i, j) AS i, greatest(i, j) AS j FROM bonds b WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.molecule = b.molecule AND w.i = b.i AND w.j = b.j AND w.node = b.j))
"""

REASONS = MOL + CLASSES + BRIDGES + """, around AS MATERIALIZED (SELECT e.molecule, e.atom, e.other, e.ord, a.element, symmetry FROM ends e JOIN atoms a ON a.molecule = e.molecule AND a.atom = e.other JOIN classes c ON c.molecule = e.molecule AND c.atom = e.other WHERE a.element <> 'H'),
flags AS (SELECT b.molecule, least(b.i, b.j) AS i, greatest(b.i, b.j) AS j, b.ord, x.element AS ei, y.element AS ej, r.i IS NOT NULL AS bridge,
  (SELECT count(*) FROM around n WHERE n.molecule = b.molecule AND n.atom = b.i) AS di, (SELECT count(*) FROM around n WHERE n.molecule = b.molecule AND n.atom = b.j) AS dj,
  (SELECT count(*) FROM around n WHERE n.molecule = b.molecule AND n.atom = b.i AND n.element = 'O' AND n.ord = 2) AS oi, (SELECT count(*) FROM around n WHERE n.molecule = b.molecule AND n.atom = b.j AND n.element = 'O' AND n.ord = 2) AS oj,
  (SELECT count(*) >= 3 AND count(DISTINCT n.symmetry) = 1 FROM around n WHERE n.molecule = b.molecule AND n.atom = b.i AND n.other <> b.j) AS si, (SELECT count(*) >= 3 AND count(DISTINCT n.symmetry) = 1 FROM around n WHERE n.molecule = b.molecule AND n.atom = b.j AND n.other <> b.i) AS sj
  FROM bonds b JOIN atoms x ON x.molecule = b.molecule AND x.atom = b.i JOIN atoms y ON y.molecule = b.molecule AND y.atom = b.j LEFT JOIN bridges r ON r.molecule = b.molecule AND r.i = least(b.i, b.j) AND r.j = greatest(b.i, b.j)),
reasons AS MATERIALIZED (SELECT molecule, i, j, CASE WHEN ei = 'H' OR ej = 'H' THEN 'hydrogen' WHEN ord = 4 THEN 'aromatic' WHEN ord <> 1 THEN 'bond-order' WHEN NOT bridge THEN 'ring' WHEN (ei = 'C' AND ej = 'N' AND oi > 0) OR (ej = 'C' AND ei = 'N' AND oj > 0) THEN 'amide' WHEN di < 2 OR dj < 2 THEN 'terminal' WHEN si OR sj THEN 'symmetric' ELSE 'rotatable' END AS reason FROM flags)
"""

TREES = REASONS + """, stiff AS MATERIALIZED (SELECT e.* FROM ends e LEFT JOIN reasons r ON r.molecule = e.molecule AND r.i = least(e.atom, e.other) AND r.j = greatest(e.atom, e.other) WHERE r.reason <> 'rotatable'),
spread AS (SELECT molecule, atom AS root, atom FROM atoms UNION SELECT s.molecule, s.root, e.other FROM spread s JOIN stiff e ON e.molecule = s.molecule AND e.atom = s.atom),
parts AS MATERIALIZED (SELECT molecule, atom, min(root) AS part FROM spread GROUP BY molecule, atom),
middle AS (SELECT molecule, coalesce(avg(x) FILTER (element <> 'H'), avg(x)) AS mx, coalesce(avg(y) FILTER (element <> 'H'), avg(y)) AS my, coalesce(avg(z) FILTER (element <> 'H'), avg(z)) AS mz FROM atoms GROUP BY molecule),
sized AS MATERIALIZED (SELECT molecule, part, count(*) AS n_atoms, round(sqrt((avg(x) - any_value(mx)) * (avg(x) - any_value(mx)) + (avg(y) - any_value(my)) * (avg(y) - any_value(my)) + (avg(z) - any_value(mz)) * (avg(z) - any_value(mz))), 9) AS gap FROM parts JOIN atoms USING (molecule, atom) JOIN middle USING (molecule) GROUP BY molecule, part),
links AS MATERIALIZED (SELECT r.molecule, p.part AS a, q.part AS b, r.i AS at, r.j AS to_ FROM reasons r JOIN parts p ON p.molecule = r.molecule AND p.atom = r.i JOIN parts q ON q.molecule = r.molecule AND q.atom = r.j WHERE reason = 'rotatable' UNION ALL SELECT r.molecule, q.part, p.part, r.j, r.i FROM reasons r JOIN parts p ON p.molecule = r.molecule AND p.atom = r.i JOIN parts q ON q.molecule = r.molecule AND q.atom = r.j WHERE reason = 'rotatable'),
grown AS (SELECT molecule, part, NULL::BIGINT AS parent, NULL::BIGINT AS parent_atom, NULL::BIGINT AS attach_atom, 0 AS depth FROM (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY molecule ORDER BY n_atoms DESC, gap, part) = 1) UNION ALL SELECT g.molecule, l.b, g.part, l.at, l.to_, depth + 1 FROM grown g JOIN links l ON l.molecule = g.molecule AND l.a = g.part WHERE g.parent IS NULL OR l.b <> g.parent),
tree AS MATERIALIZED (SELECT g.molecule, g.part, n_atoms, parent, parent_atom, attach_atom, depth FROM grown g JOIN sized USING (molecule, part))
"""

PATHS = MOL + """, weighted AS MATERIALIZED (SELECT e.molecule, e.atom, e.other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS w FROM ends e JOIN atoms a ON a.molecule = e.molecule AND a.atom = e.atom JOIN atoms b ON b.molecule = e.molecule AND b.atom = e.other),
ways AS (SELECT molecule, atom AS source, atom AS node, [atom] AS nodes, 0::DOUBLE AS cost, 1e300::DOUBLE AS width FROM atoms WHERE atom % 6 = 0 UNION ALL SELECT w.molecule, w.source, e.other, list_append(nodes, e.other), cost + e.w, least(width, e.w) FROM ways w JOIN weighted e ON e.molecule = w.molecule AND e.atom = w.node WHERE NOT list_contains(nodes, e.other))
"""


@query(MOL + CLASSES + "SELECT molecule, atom, symmetry FROM classes")
def symmetry_classes(spark, sf_dir):
    return molgraph.symmetry_classes(atoms(spark, sf_dir), bonds(spark, sf_dir), KEYS)


@query(MOL + BRIDGES + "SELECT molecule, i, j FROM bridges")
def bridges(spark, sf_dir):
    return molgraph.bridges(atoms(spark, sf_dir), bonds(spark, sf_dir), KEYS)


@query(REASONS + "SELECT molecule, i, j, reason FROM reasons")
def rotatable_bonds(spark, sf_dir):
    return molgraph.rotation_reasons(atoms(spark, sf_dir), bonds(spark, sf_dir), KEYS)


def trees(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a, b = atoms(spark, sf_dir), bonds(spark, sf_dir)
    rotors = molgraph.rotation_reasons(a, b, KEYS).where("reason = 'rotatable'")
    return molgraph.torsion_trees(a, b, rotors, KEYS)


@query(TREES + "SELECT molecule, part, n_atoms, parent, parent_atom, attach_atom, CAST(depth AS INTEGER) AS depth FROM tree")
def torsion_tree(spark, sf_dir):
    return trees(spark, sf_dir)[0]


@query(TREES + """, below AS (SELECT molecule, part, part AS holds FROM tree WHERE parent IS NOT NULL UNION ALL SELECT b.molecule, b.part, t.part FROM below b JOIN tree t ON t.molecule = b.molecule AND t.parent = b.holds)
SELECT molecule, b.part, atom FROM below b JOIN parts p USING (molecule) WHERE p.part = b.holds""")
def turning_atoms(spark, sf_dir):
    tree, parts = trees(spark, sf_dir)
    return molgraph.turning_atoms(tree, parts, KEYS)


def distances(spark, sf_dir) -> DataFrame:
    a = atoms(spark, sf_dir)
    rows = bonds(spark, sf_dir)
    for c in "ij":
        rows = rows.join(a.select("molecule", F.col("atom").alias(c), *[F.col(n).alias(f"{c}{n}") for n in "xyz"]), ["molecule", c])
    gap = sum(((F.col(f"i{n}") - F.col(f"j{n}")) * (F.col(f"i{n}") - F.col(f"j{n}")) for n in "xyz"), F.lit(0.0))
    return rows.select("molecule", "i", "j", F.sqrt(gap).alias("weight"))


def sources(spark, sf_dir) -> DataFrame:
    return atoms(spark, sf_dir).where(F.pmod("atom", F.lit(6)) == 0).select("molecule", F.col("atom").alias("source"))


@query(PATHS + "SELECT molecule, source, node, round(min(cost), 6) AS cost, max(width) FILTER (node <> source) AS w, round(max(width) FILTER (node <> source), 6) AS widest FROM ways GROUP BY molecule, source, node".replace("max(width) FILTER (node <> source) AS w, ", ""))
def path_costs(spark, sf_dir):
    """From two atoms of each molecule to all others: the least sum of bond lengths, and the largest least one."""
    e, s = distances(spark, sf_dir), sources(spark, sf_dir)
    wide = molgraph.best_paths(e, s, KEYS, widest=True).where("node <> source").select(*KEYS, "source", "node", F.col("cost").alias("widest"))
    return rounded(molgraph.best_paths(e, s, KEYS).drop("previous").join(wide, [*KEYS, "source", "node"], "left"), "cost", "widest")


@query(PATHS + "SELECT molecule, source, node AS target, array_to_string(arg_min(nodes, cost), ' ') AS nodes, round(min(cost), 6) AS cost FROM ways WHERE node = 11 GROUP BY molecule, source, node")
def pathways(spark, sf_dir):
    e, s = distances(spark, sf_dir), sources(spark, sf_dir)
    found = molgraph.traced(molgraph.best_paths(e, s, KEYS), s.withColumn("target", F.lit(11).cast("long")), KEYS)
    return rounded(found.select("molecule", "source", "target", F.array_join("nodes", " ").alias("nodes"), "cost"), "cost")


@query(MOL + CLASSES + """, sized AS (SELECT molecule, symmetry, count(*) AS n FROM classes GROUP BY ALL),
costs AS MATERIALIZED (SELECT a.molecule, c.symmetry, c.atom AS a, d.atom AS b, (a.x - e.u) * (a.x - e.u) + (a.y - e.v) * (a.y - e.v) + (a.z - e.w) * (a.z - e.w) AS cost FROM atoms a JOIN classes c USING (molecule, atom) JOIN classes d ON d.molecule = c.molecule AND d.symmetry = c.symmetry
  JOIN (SELECT vec_id // 12 AS molecule, vec_id % 12 AS atom, CAST(embedding[4] AS DOUBLE) * 20 AS u, CAST(embedding[5] AS DOUBLE) * 20 AS v, CAST(embedding[6] AS DOUBLE) * 20 AS w FROM embeddings) e ON e.molecule = d.molecule AND e.atom = d.atom),
chosen AS (SELECT molecule, symmetry, -1::BIGINT AS a, []::BIGINT[] AS used, 0::DOUBLE AS cost FROM sized UNION ALL SELECT c.molecule, c.symmetry, c.a, list_append(used, c.b), h.cost + c.cost FROM chosen h JOIN costs c ON c.molecule = h.molecule AND c.symmetry = h.symmetry AND NOT list_contains(h.used, c.b)
  AND c.a = (SELECT min(k.atom) FROM classes k WHERE k.molecule = h.molecule AND k.symmetry = h.symmetry AND k.atom > h.a)),
least AS (SELECT molecule, symmetry, min(cost) AS cost FROM chosen JOIN sized USING (molecule, symmetry) WHERE len(used) = n GROUP BY ALL)
SELECT molecule, round(sqrt(sum(cost) / sum(n)), 6) AS rmsd FROM least JOIN sized USING (molecule, symmetry) GROUP BY molecule""")
def symmetry_aware_rmsd(spark, sf_dir):
    """Two poses of each molecule, from six components of its vectors."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    xyz = [(F.col("embedding")[n].cast("double") * 20).alias(c) for n, c in enumerate(("ax", "ay", "az", "bx", "by", "bz"))]
    pairs = e.select(F.floor(k / 12).alias("molecule"), F.pmod(k, F.lit(12)).alias("atom"), *xyz)
    classes = molgraph.symmetry_classes(atoms(spark, sf_dir), bonds(spark, sf_dir), KEYS)
    return rounded(molgraph.symmetry_aware_rmsd(pairs.join(classes, [*KEYS, "atom"]), KEYS), "rmsd")


@query("""WITH a AS (SELECT vec_id // 12 AS molecule, vec_id % 12 AS atom, 'A' || (vec_id * 7 % 12 + CASE WHEN vec_id // 12 % 5 = 0 AND vec_id % 12 = 3 THEN 1 ELSE 0 END) AS name FROM embeddings),
b AS (SELECT vec_id // 12 AS molecule, vec_id % 12 AS atom, 'A' || (vec_id * 5 % CASE WHEN vec_id // 12 % 7 = 0 THEN 11 ELSE 12 END) AS name FROM embeddings),
bad AS (SELECT molecule FROM (SELECT molecule, name, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT molecule, name, count(*) FROM b GROUP BY ALL) GROUP BY molecule, name HAVING count(*) <> 2 OR max(n) > 1)
SELECT molecule, a.atom, b.atom AS target FROM a JOIN b USING (molecule, name) WHERE molecule NOT IN (SELECT molecule FROM bad)""")
def atom_permutation(spark, sf_dir):
    """Names in two orders; in some molecules a name repeats or is missing."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.floor(k / 12).alias("molecule"), F.pmod(k, F.lit(12)).alias("atom"), "vec_id")
    odd = ((F.pmod("molecule", F.lit(5)) == 0) & (F.col("atom") == 3)).cast("int")
    a = e.select("molecule", "atom", F.concat(F.lit("A"), (F.pmod(k * 7, F.lit(12)) + odd).cast("string")).alias("name"))
    b = e.select("molecule", "atom", F.concat(F.lit("A"), F.pmod(k * 5, F.when(F.pmod("molecule", F.lit(7)) == 0, 11).otherwise(12)).cast("string")).alias("name"))
    return molgraph.atom_permutation(a, b, KEYS)
