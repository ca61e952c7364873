"""Files of records that are split anywhere, and molecules with a tree of rigid parts (ROOT, BRANCH, ENDBRANCH, TORSDOF).

A file of any size is read by many tasks: records are what stands between separators, and Spark's reader finds the first one of each
split. Nesting comes from running counts over a molecule's lines, so no parser keeps a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import positions
from quarry.plans.stages import drop_path, written

from .records import format_atom, parse_atoms, torsdof
from .tables import molecule_blocks

#: What separates the records of a file.
SEPARATORS = {"sdf": "$$$$\n", "mol2": "@<TRIPOS>MOLECULE\n", "pdbqt": "ENDMDL\n"}


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(file, record, text)``: the records of files, numbered from 0 in each. Records that are blank are left out.

    Splits of one file go to as many tasks as its size asks for. A record's place is its split's start and its place there.
    """
    got = spark.read.option("lineSep", SEPARATORS[kind]).text(path)
    place = F.monotonically_increasing_id()  # grows within a split
    rows = got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"), F.col("value").alias("text"))
    rows, _ = written(rows.where(F.trim(F.regexp_replace("text", r"[\r\n]", " ")) != ""), "records")
    return positions(rows, ["file"], ["block", "place"], "record").select("file", (F.col("record") - 1).alias("record"), "text")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """The molecules of SD files, however large a file is; see ``molecule_blocks``."""
    rows = read_records(spark, path, "sdf").withColumnRenamed("record", "at")
    return molecule_blocks(rows, "text").drop("record").withColumnRenamed("at", "record")


def mol2_molecules(records: DataFrame, text: str = "text") -> DataFrame:
    """``(.., name, atoms, bonds, error)`` of MOL2 records (what follows the MOLECULE tag): atoms are structs of serial, name, x, y, z, kind and
    charge, bonds of i, j and kind. A record without atoms has an error."""
    keys = [c for c in records.columns if c != text]
    parts = records.withColumn("p", F.split(F.regexp_replace(F.col(text), "\r", ""), r"(?m)^@<TRIPOS>"))

    def section(name: str) -> Column:
        body = F.get(F.filter("p", lambda x: x.startswith(name + "\n")), F.lit(0))
        lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & (x != name))
        return F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))

    def get(x: Column, k: int, kind: str) -> Column:
        return F.get(x, F.lit(k)).try_cast(kind)

    atoms = F.transform(section("ATOM"), lambda x: F.struct(get(x, 0, "int").alias("serial"), get(x, 1, "string").alias("name"), get(x, 2, "double").alias("x"), get(x, 3, "double").alias("y"), get(x, 4, "double").alias("z"), get(x, 5, "string").alias("kind"), get(x, 8, "double").alias("charge")))
    bonds = F.transform(section("BOND"), lambda x: F.struct(get(x, 1, "int").alias("i"), get(x, 2, "int").alias("j"), get(x, 3, "string").alias("kind")))
    rows = parts.select(*keys, F.trim(F.split(F.col("p")[0], "\n")[0]).alias("name"), atoms.alias("atoms"), bonds.alias("bonds"))
    return rows.withColumn("error", F.when(F.size("atoms") == 0, "no atoms").otherwise(""))


# -- trees -------------------------------------------------------------------------------------------------


def numbered_lines(molecules: DataFrame, text: str) -> DataFrame:
    keys = [c for c in molecules.columns if c != text]
    return molecules.select(*keys, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def ligand_trees(molecules: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Atoms and frames of molecules ``(keys, text)``.

    Atoms are those of ``parse_atoms`` with ``frame`` and ``depth``; frames are ``(keys, frame, parent, depth, i, j)``. The frame of the ROOT is 0, any other
    is named by the number of its BRANCH line from 1 on, and turns about the bond from atom ``i`` of its parent to its own ``j``. A line belongs to
    the branch that was last opened at its depth, which is how many are open there.
    """
    keys = [c for c in molecules.columns if c != text]
    lines = numbered_lines(molecules, text)
    opens, closes = F.col("line").rlike(r"^BRANCH\b"), F.col("line").rlike(r"^ENDBRANCH\b")
    w = Window.partitionBy(*keys).orderBy("line_no")  # a molecule's lines
    rows = lines.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    rows = rows.withColumn("opened", F.when(opens, F.col("line_no") + 1))
    inside = Window.partitionBy(*keys, "depth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("frame", F.coalesce(F.last("opened", True).over(inside), F.lit(0)))
    atoms = parse_atoms(rows.drop("opened"))
    # a BRANCH line asks, one level up, which branch was opened there last
    up = rows.where(F.col("opened").isNotNull()).select(*keys, (F.col("depth") - 1).alias("depth"), "line_no", F.lit(None).cast("int").alias("opened"), F.col("frame").alias("own"), "line")
    seen = rows.select(*keys, "depth", "line_no", F.col("opened").cast("int").alias("opened"), F.lit(None).cast("int").alias("own"), "line").unionByName(up)
    before = Window.partitionBy(*keys, "depth").orderBy("line_no", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    frames = seen.withColumn("parent", F.coalesce(F.last("opened", True).over(before), F.lit(0))).where("own is not null")
    atom = [F.regexp_extract("line", r"^BRANCH\s+(\d+)\s+(\d+)", k).try_cast("int") for k in (1, 2)]
    return atoms, frames.select(*keys, F.col("own").alias("frame"), "parent", (F.col("depth") + 1).alias("depth"), atom[0].alias("i"), atom[1].alias("j"))


#: Tags that may begin a line of a ligand or of a rigid receptor.
LIGAND_TAGS = ("ROOT", "ENDROOT", "BRANCH", "ENDBRANCH", "TORSDOF", "ATOM", "HETATM", "REMARK", "WARNING", "USER", "MODEL", "ENDMDL", "TER", "END")
RECEPTOR_TAGS = ("ATOM", "HETATM", "MODEL", "ENDMDL", "REMARK", "WARNING", "CRYST1", "TER", "END")
FLEXIBLE_TAGS = ("ROOT", "ENDROOT", "BRANCH", "ENDBRANCH", "BEGIN_RES", "END_RES", "TORSDOF")


def ligand_checks(molecules: DataFrame, text: str = "text") -> DataFrame:
    """``(keys, torsdof, n_atoms, n_branches, error)``: the first of: an unknown tag; no ROOT atoms; an ENDBRANCH that closes another branch
    than the last one open, or none; a branch that stays open; no TORSDOF."""
    keys = [c for c in molecules.columns if c != text]
    lines = numbered_lines(molecules, text)
    tag = F.regexp_extract("line", r"^([A-Z_0-9]*)", 1)
    ends = F.regexp_extract("line", r"^(?:END)?BRANCH\s+(\d+\s+\d+)", 1)
    opens, closes = tag == "BRANCH", tag == "ENDBRANCH"
    w = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.withColumns({"tag": tag, "ends": F.regexp_replace(ends, r"\s+", " "), "depth": F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w)})
    # an opening line and the line that closes it stand at one level: the depth after the one, before the other
    rows = rows.withColumn("level", F.col("depth") + (F.col("tag") == "ENDBRANCH").cast("int"))
    last = Window.partitionBy(*keys, "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.last(F.when(F.col("tag") == "BRANCH", F.col("ends")), True).over(last))
    bad_close = (F.col("tag") == "ENDBRANCH") & ((F.col("depth") < 0) | F.coalesce(F.col("open") != F.col("ends"), F.lit(True)))
    atom = F.col("tag").isin("ATOM", "HETATM")
    sums = rows.groupBy(*keys).agg(
        F.count_if(atom).alias("n_atoms"), F.count_if(F.col("tag") == "BRANCH").alias("n_branches"), F.count_if(atom & (F.col("depth") == 0)).alias("root"), F.count_if(bad_close).alias("bad"),
        F.sum((F.col("tag") == "BRANCH").cast("int") - (F.col("tag") == "ENDBRANCH").cast("int")).alias("left"), F.count_if((F.trim("line") != "") & ~F.col("tag").isin(*LIGAND_TAGS)).alias("unknown"),
    )
    rows = molecules.select(*keys, torsdof(F.col(text)).alias("torsdof")).join(sums, keys)
    error = F.when(F.col("unknown") > 0, "unknown tag").when(F.col("root") == 0, "no root atoms").when(F.col("bad") > 0, "branch closed out of order").when(F.col("left") != 0, "branch left open").when(F.col("torsdof").isNull(), "no TORSDOF").otherwise("")
    return rows.select(*keys, "torsdof", "n_atoms", "n_branches", error.alias("error"))


def receptor_checks(structures: DataFrame, text: str = "text") -> DataFrame:
    """``(keys, n_atoms, n_flexible, error)`` of rigid receptors: records of flexible residues are counted and taken as rigid; more than one model, an
    unknown tag, or no atoms are errors, in the order of their lines."""
    keys = [c for c in structures.columns if c != text]
    lines = numbered_lines(structures, text).withColumn("tag", F.regexp_extract("line", r"^([A-Z_0-9]*)", 1))
    w = Window.partitionBy(*keys).orderBy("line_no")
    models = F.sum((F.col("tag") == "MODEL").cast("int")).over(w)
    wrong = F.when((F.col("tag") == "MODEL") & (models > 1), "several models").when((F.trim("line") != "") & ~F.col("tag").isin(*RECEPTOR_TAGS, *FLEXIBLE_TAGS), "unknown tag")
    rows = lines.withColumn("wrong", wrong)
    sums = rows.groupBy(*keys).agg(F.count_if(F.col("tag").isin("ATOM", "HETATM")).alias("n_atoms"), F.count_if(F.col("tag").isin(*FLEXIBLE_TAGS)).alias("n_flexible"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("line_no", "wrong"))).alias("first"))
    return sums.select(*keys, "n_atoms", "n_flexible", F.coalesce("first.wrong", F.when(F.col("n_atoms") == 0, "no atoms").otherwise("")).alias("error"))


def tree_text(atoms: DataFrame, frames: DataFrame, degrees: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, text)``: molecules written as trees, from atoms, frames and ``degrees (keys, torsdof)``.

    Each line has a place: the frames on the way down to it, then its own place there. Places are compared as arrays, so sorting a molecule's lines
    nests them. Ways down grow by one level in each round.
    """
    spark = atoms.sparkSession
    place = "array<int>"
    ways, path = written(frames.where("parent = 0").select(*keys, "frame", F.array(F.lit(1), F.col("frame")).cast(place).alias("way")), "ways")
    new, paths = ways, [path]
    while True:
        new, new_path = written(frames.join(new.select(*keys, F.col("frame").alias("parent"), F.col("way").alias("down")), [*keys, "parent"]).select(*keys, "frame", F.concat("down", F.array(F.lit(1), F.col("frame"))).cast(place).alias("way")), "ways")
        paths.append(new_path)
        if not new.limit(1).count():
            break
        ways = ways.unionByName(new)
    root = degrees.select(*keys, F.lit(0).alias("frame"), F.array().cast(place).alias("way"))
    way = ways.unionByName(root)

    def at(*parts) -> Column:
        return F.concat("way", F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast(place)).alias("place")

    line = format_atom("serial", F.col("name"), F.col("res_name"), F.col("chain"), F.col("res_id"), F.col("x"), F.col("y"), F.col("z"), F.col("occupancy"), F.col("b_factor"), F.col("charge"), F.col("ad_type"))
    rows = atoms.join(way, [*keys, "frame"]).select(*keys, at(0, F.col("serial")), line.alias("line"))
    branch = frames.join(way, [*keys, "frame"])
    for n, word in ((-1, "BRANCH"), (2, "ENDBRANCH")):
        rows = rows.unionByName(branch.select(*keys, at(n), F.format_string(f"{word} %3d %3d", "i", "j").alias("line")))
    one = degrees.join(root, keys)
    for parts, text in (((-1,), F.lit("ROOT")), ((0, 2**31 - 1), F.lit("ENDROOT")), ((2,), F.format_string("TORSDOF %d", "torsdof"))):
        rows = rows.unionByName(one.select(*keys, at(*parts), text.alias("line")))
    texts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls")).select(*keys, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
    out, _ = written(texts, "trees")
    drop_path(spark, *paths)
    return out
