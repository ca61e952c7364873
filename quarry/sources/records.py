"""Sources and sinks: fixed-width structure records, line libraries, result logs and containers.

Files are read by Spark's readers, so any file system it knows will do; a file's records keep its order by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Result log; a line that was cut off lands in the last column and is dropped by ``read_results``.
RESULT_SCHEMA = "receptor string, ligand string, seed bigint, status string, affinity double, properties map<string,double>, interactions array<struct<kind:string,distance:double>>, _corrupt string"


def format_atom(serial, name, res_name, chain, res_id, x, y, z, occupancy, b_factor, charge, kind, record: str = "ATOM") -> Column:
    """A fixed-width atom line."""
    return F.format_string(f"{record:<6}%5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f    %6.3f %-2s", serial, name, res_name, chain, res_id, x, y, z, occupancy, b_factor, charge, kind)


def parse_atoms(lines: DataFrame, line: str = "line") -> DataFrame:
    """Atom lines as columns; other lines are dropped. Columns of the input stay."""
    def cut(a, b):
        return F.trim(F.substring(F.col(line), a, b - a + 1))

    rows = lines.where(F.col(line).startswith("ATOM") | F.col(line).startswith("HETATM"))
    return rows.select(
        *[c for c in lines.columns if c != line],
        cut(1, 6).alias("record"), cut(7, 11).try_cast("int").alias("serial"), cut(13, 16).alias("name"), cut(17, 17).alias("altloc"), cut(18, 20).alias("res_name"), cut(22, 22).alias("chain"), cut(23, 26).try_cast("int").alias("res_id"),
        cut(31, 38).try_cast("double").alias("x"), cut(39, 46).try_cast("double").alias("y"), cut(47, 54).try_cast("double").alias("z"), cut(55, 60).try_cast("double").alias("occupancy"), cut(61, 66).try_cast("double").alias("b_factor"),
        cut(71, 76).try_cast("double").alias("charge"), cut(78, 79).alias("ad_type"),
    )


def lines_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """A document's lines with their position; other columns stay."""
    return documents.select(*[c for c in documents.columns if c != text], F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Structure files -> atoms with file, model number and order."""
    from pyspark.sql import Window

    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = lines_of(docs)
    model = F.sum(F.when(F.col("line").startswith("MODEL"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line_no"))
    return parse_atoms(lines.withColumn("model", model))


def remarks(text: Column) -> Column:
    """The affinity and both bounds of a result remark, as a struct of doubles."""
    pattern = r"REMARK VINA RESULT:\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)"
    return F.struct(*[F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("double").alias(n) for k, n in ((1, "affinity"), (2, "rmsd_lb"), (3, "rmsd_ub"))])


def torsdof(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^TORSDOF\s+(\d+)", 1), F.lit("")).try_cast("int")


def read_smiles(spark: SparkSession, path: str, with_target: bool = False) -> DataFrame:
    """``SMILES name [target]`` lines; comments and empty lines are skipped, a missing name is the ordinal's."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    parts = F.split("v", r"\s+")
    cols = [F.get(parts, F.lit(0)).alias("smiles"), F.get(parts, F.lit(1)).alias("name")] + ([F.get(parts, F.lit(2)).alias("target")] if with_target else [])
    return rows.select("file", *cols)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines result log without lines that were cut off."""
    rows = spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and receptor is not null").drop("_corrupt")


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row; numbers that are not finite are left out."""
    def safe(c, kind):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c)

    return df.select(F.to_json(F.struct(*[safe(c, k) for c, k in df.dtypes])).alias("value"))


def member_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each file of a container folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_members(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Members that are missing, changed or not listed."""
    m = manifest.select("name", F.col("size").alias("ms"), F.col("sha256").alias("mh"))
    j = found.join(m, "name", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("mh").isNull(), "unlisted").when((F.col("sha256") != F.col("mh")) | (F.col("size") != F.col("ms")), "changed").otherwise("ok")
    return j.select("name", state.alias("state"))


def with_coordinates(line: Column, x: Column, y: Column, z: Column) -> Column:
    """A record with other coordinates in its columns 31 to 54; the rest stays."""
    return F.concat(F.substring(line, 1, 30), F.format_string("%8.3f%8.3f%8.3f", x, y, z), F.substring(line, 55, 1000))
