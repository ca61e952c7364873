"""Queries of files and trees, with their SQL: molecules of twelve atoms in four frames, written as text, read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.stages import new_path
from quarry.sources import records, trees

from .queries import query, table

#: Order of lines: frame 3 hangs on frame 1, frames 1 and 2 on the root.
LAYOUT = ["ROOT", *[0, 1, 2], "ENDROOT", "BRANCH   1   4", *[3, 4, 5], "BRANCH   5  10", *[9, 10, 11], "ENDBRANCH   5  10", "ENDBRANCH   1   4", "BRANCH   2   7", *[6, 7, 8], "ENDBRANCH   2   7", "TORSDOF 3"]


def ligands(spark, sf_dir) -> DataFrame:
    """``(molecule, text)``; some leave a branch open, close the wrong one, have no degrees of freedom, or a line that no reader knows."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    x, y, z = ((F.round(F.col("embedding")[n].cast("double") * 20, 3)) for n in range(3))
    n = F.pmod(k, F.lit(12)).cast("int")
    line = records.format_atom(n + 1, F.lit("C"), F.lit("LIG"), F.lit("A"), F.lit(1), x, y, z, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit("C"))
    own = e.groupBy(F.floor(k / 12).alias("molecule")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), line.alias("line")))).alias("a")).where(F.size("a") == 12)
    lines = F.array(*[F.lit(x) if isinstance(x, str) else F.col("a")[x]["line"] for x in LAYOUT])
    m = F.col("molecule")
    lines = F.when(F.pmod(m, F.lit(9)) == 1, F.filter(lines, lambda x: x != "ENDBRANCH   2   7")).when(F.pmod(m, F.lit(9)) == 2, F.filter(lines, lambda x: ~x.startswith("TORSDOF"))).when(F.pmod(m, F.lit(9)) == 3, F.transform(lines, lambda x: F.when(x == "ENDBRANCH   5  10", "ENDBRANCH   5  11").otherwise(x))).when(F.pmod(m, F.lit(9)) == 4, F.array_append(lines, F.lit("BOGUS"))).otherwise(lines)
    return own.select("molecule", F.array_join(lines, "\n").alias("text"))


FRAMES = "(VALUES (0, 0, NULL, 0, NULL, NULL), (1, 6, 0, 1, 1, 4), (2, 16, 0, 1, 2, 7), (3, 10, 6, 2, 5, 10)) f(n, frame, parent, depth, i, j)"
ATOMS = """WITH a AS (SELECT vec_id // 12 AS molecule, vec_id % 12 AS n, round(CAST(embedding[1] AS DOUBLE) * 20, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 20, 3) AS y, round(CAST(embedding[3] AS DOUBLE) * 20, 3) AS z FROM embeddings WHERE vec_id // 12 IN (SELECT vec_id // 12 FROM embeddings GROUP BY 1 HAVING count(*) = 12))
"""


@query(ATOMS + f"SELECT molecule, CAST(a.n + 1 AS INTEGER) AS serial, x, y, z, frame, CAST(depth AS BIGINT) AS depth FROM a JOIN {FRAMES} ON a.n // 3 = f.n WHERE molecule % 9 NOT IN (1, 3)")
def ligand_tree_atoms(spark, sf_dir):
    atoms, _ = trees.ligand_trees(ligands(spark, sf_dir).where(~F.pmod("molecule", F.lit(9)).isin(1, 3)))
    return atoms.select("molecule", "serial", "x", "y", "z", "frame", "depth")


@query(ATOMS + f"SELECT molecule, frame, CAST(parent AS INTEGER) AS parent, CAST(depth AS BIGINT) AS depth, i, j FROM (SELECT DISTINCT molecule FROM a), {FRAMES} WHERE parent IS NOT NULL AND molecule % 9 NOT IN (1, 3)")
def ligand_tree_frames(spark, sf_dir):
    return trees.ligand_trees(ligands(spark, sf_dir).where(~F.pmod("molecule", F.lit(9)).isin(1, 3)))[1]


@query(ATOMS + "SELECT DISTINCT molecule, CASE WHEN molecule % 9 <> 2 THEN 3 END AS torsdof, 12 AS n_atoms, 3 AS n_branches, CASE molecule % 9 WHEN 1 THEN 'branch left open' WHEN 2 THEN 'no TORSDOF' WHEN 3 THEN 'branch closed out of order' WHEN 4 THEN 'unknown tag' ELSE '' END AS error FROM a")
def ligand_checks(spark, sf_dir):
    return trees.ligand_checks(ligands(spark, sf_dir))


@query(ATOMS + "SELECT DISTINCT molecule, 12 AS n_atoms, CASE WHEN molecule % 9 IN (1, 2) THEN 8 ELSE 9 END AS n_flexible, CASE WHEN molecule % 9 = 4 THEN 'unknown tag' ELSE '' END AS error FROM a")
def receptor_checks(spark, sf_dir):
    return trees.receptor_checks(ligands(spark, sf_dir))


@query(ATOMS + """, l AS (SELECT molecule, n, printf('ATOM  %5d  C   LIG A   1    %8.3f%8.3f%8.3f  1.00  0.00     0.000 C ', n + 1, x, y, z) AS line FROM a WHERE molecule % 9 NOT IN (1, 2, 3, 4)),
t(p, k, s) AS (VALUES """ + ", ".join(f"({p}, {x if isinstance(x, int) else 'NULL'}, {'NULL' if isinstance(x, int) else chr(39) + x + chr(39)})" for p, x in enumerate(LAYOUT)) + """)
SELECT molecule, md5(string_agg(coalesce(s, line), chr(10) ORDER BY p)) AS text_md5 FROM (SELECT DISTINCT molecule FROM l) JOIN t ON true LEFT JOIN l USING (molecule) WHERE l.n IS NULL OR l.n = coalesce(k, 0) GROUP BY molecule""")
def ligand_round_trip(spark, sf_dir):
    """Read as trees and written again."""
    own = ligands(spark, sf_dir).where(~F.pmod("molecule", F.lit(9)).isin(1, 2, 3, 4))
    atoms, frames = trees.ligand_trees(own)
    text = trees.tree_text(atoms, frames, own.select("molecule", records.torsdof(F.col("text")).alias("torsdof")), ["molecule"])
    return text.select("molecule", F.md5("text").alias("text_md5"))


@query(ATOMS + "SELECT molecule, n AS atom, x, y, z, CASE n % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'N' ELSE 'O' END AS element FROM a")
def sd_files(spark, sf_dir):
    """Molecules written to SD files and read back by splits of the files; names say which is which."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    n = F.pmod(k, F.lit(12)).cast("int")
    x, y, z = ((F.round(F.col("embedding")[c].cast("double") * 20, 3)) for c in range(3))
    element = F.array(F.lit("C"), F.lit("N"), F.lit("O"))[F.pmod(n, F.lit(3))]
    line = F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", x, y, z, element)
    own = e.groupBy(F.floor(k / 12).alias("molecule")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), line.alias("line")))).alias("a")).where(F.size("a") == 12)
    body = F.concat(F.col("molecule").cast("string"), F.lit("\n  made\n\n 12  0  0  0  0  0            999 V2000\n"), F.array_join(F.transform("a", lambda r: r["line"]), "\n"), F.lit("\nM  END\n"))
    path = new_path(spark, "sd")
    own.select(body.alias("value")).write.option("lineSep", trees.SEPARATORS["sdf"]).text(path)
    got = trees.read_molecules(spark, path).select(F.col("name").cast("long").alias("molecule"), F.posexplode("atoms").alias("atom", "p"))
    return got.select("molecule", F.col("atom").cast("long").alias("atom"), "p.x", "p.y", "p.z", "p.element")
