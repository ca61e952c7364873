"""Tables of results and libraries as CSV, TSV and JSON lines; molecule files; documents of settings.

Columns are declared, never inferred. Null is an empty field in CSV and null in JSON; values that are not finite become null in
both. CSV drops nested columns but for lists of text, which are joined by '; ', and writes flags as 1 and 0.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIBRARY = "index int, key string, name string, source string, passed boolean, failed_filters array<string>, n_heavy int, n_torsions int, error string"
RESULTS = "receptor string, ligand string, name string, index int, status string, affinity double, n_heavy int, seed long, violations array<string>, in_box boolean, error string"


def columns_for(base: Iterable[str], *more: Iterable[str]) -> list[str]:
    """The base columns, then others as they are first seen."""
    out = list(dict.fromkeys(base))
    for names in more:
        out += [n for n in names if n not in out]
    return out


def flat(df: DataFrame) -> DataFrame:
    """Columns as CSV has them."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.BooleanType):
            c = F.when(c, "1").when(~c, "0")
        elif isinstance(kind, T.DoubleType | T.FloatType):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, "; ")
        elif isinstance(kind, T.ArrayType | T.StructType | T.MapType):
            continue
        out.append(c.alias(f.name))
    return df.select(*out)


def write_rows(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Writes a folder of files; the format from the path's ending if it is not named."""
    kind = fmt or ("tsv" if path.endswith(".tsv") else "csv" if path.endswith(".csv") else "jsonl")
    if kind in ("csv", "tsv"):
        flat(df).write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').option("emptyValue", '""').csv(path)
    elif kind in ("jsonl", "json", "ndjson"):
        numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
        rows = [F.when(F.isnan(F.col(f"`{c}`")) | (F.abs(F.col(f"`{c}`")) == float("inf")), None).otherwise(F.col(f"`{c}`")).alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns]
        df.select(*rows).write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {kind!r}; use 'jsonl', 'csv' or 'tsv'")
    return path


def read_rows(spark: SparkSession, path: str, schema: str, fmt: str | None = None) -> DataFrame:
    """Reads what ``write_rows`` wrote, with the columns of ``schema``; a JSON line that is cut off is left out, and so is a CSV row
    without its first field."""
    kind = fmt or ("tsv" if path.endswith(".tsv") else "csv" if path.endswith(".csv") else "jsonl")
    want = T._parse_datatype_string(schema)
    if kind == "jsonl":
        got = spark.read.schema(T.StructType([*want.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)
        return got.where("_bad is null").drop("_bad")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in want.fields])
    got = spark.read.schema(text).option("header", True).option("enforceSchema", False).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)
    out = []
    for f in want.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c == "1"
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "; "))
        out.append(c.cast(f.dataType).alias(f.name))
    first = want.fields[0].name
    return got.select(*out).where(F.col(first).isNotNull())


# -- molecule files --------------------------------------------------------------------------------------


def smiles_records(lines: DataFrame, text: str = "value", order: list[str] | None = None) -> DataFrame:
    """``(position, smiles, name, status)`` of lines ``SMILES name``: blank lines and comments are left out, the rest numbered from 0 in the
    given order; a line of one field has an empty name."""
    rows = lines.withColumn("__t", F.trim(text)).where((F.col("__t") != "") & ~F.col("__t").startswith("#"))
    parts = F.split("__t", r"[ \t]+", 2)
    from quarry.operators.ranking import positions

    numbered = positions(rows, [], order or ["__t"], "__n")
    return numbered.select((F.col("__n") - 1).alias("position"), parts[0].alias("smiles"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("name"))


def member_keys(rows: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Rows with ``key``: the file's name and the row's number in the whole library, so that equal names never meet."""
    from quarry.operators.ranking import positions

    numbered = positions(rows, [], [file, *order], "__n")
    return numbered.withColumn("key", F.concat_ws("#", F.element_at(F.split(F.col(file), "/"), -1), (F.col("__n") - 1).cast("string"))).drop("__n")


def models_of(documents: DataFrame, text: str) -> DataFrame:
    """``(.., model, line_no, line)``: the lines of each model of a document, numbered from 0; a document without models is one.

    A model's number is how many MODEL lines stand at or above; what stands outside of models is left out where there are any.
    """
    lines = F.split(F.col(text), "\n")
    keys = [c for c in documents.columns if c != text]
    rows = documents.select(*keys, lines.alias("l")).withColumn("n", F.size(F.filter("l", lambda x: x.startswith("MODEL"))))
    rows = rows.select(*keys, "n", F.posexplode("l").alias("line_no", "line"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    opened = F.sum(F.col("line").startswith("MODEL").cast("int")).over(w)
    closed = F.sum(F.col("line").startswith("ENDMDL").cast("int")).over(w)
    rows = rows.withColumn("model", F.when(F.col("n") == 0, 0).otherwise(opened - 1)).withColumn("inside", (F.col("n") == 0) | (opened > closed))
    return rows.where(F.col("inside") & ~F.col("line").startswith("MODEL")).select(*keys, "model", "line_no", "line")


def molecule_blocks(documents: DataFrame, text: str) -> DataFrame:
    """``(.., record, name, n_atoms, n_bonds, atoms, bonds, error)`` of each record of an SD file (V2000), records numbered from 0.

    Atoms are structs of x, y, z and element, bonds of i, j (from 1) and order. A record whose counts line does not read, or that
    has fewer lines than it counts, keeps its place with an error.
    """
    keys = [c for c in documents.columns if c != text]
    parts = F.filter(F.split(F.regexp_replace(F.col(text), "\r", ""), r"(?m)^\$\$\$\$[^\n]*(?:\n|$)"), lambda p: F.trim(p) != "")
    rows = documents.select(*keys, F.posexplode(parts).alias("record", "body")).withColumn("l", F.split("body", "\n"))
    counts = F.coalesce(F.get("l", F.lit(3)), F.lit(""))
    rows = rows.withColumn("n_atoms", F.expr("try_cast(trim(substring(coalesce(get(l, 3), ''), 1, 3)) as int)")).withColumn("n_bonds", F.expr("try_cast(trim(substring(coalesce(get(l, 3), ''), 4, 3)) as int)"))
    bad = F.col("n_atoms").isNull() | F.col("n_bonds").isNull() | ~counts.contains("V2000")
    short = F.size("l") < 4 + F.col("n_atoms") + F.col("n_bonds")
    error = F.when(bad, "counts line").when(short, "too few lines").otherwise("")

    def number(line: Column, a: int, n: int, kind: str) -> Column:
        return F.trim(F.substring(line, a, n)).try_cast(kind)

    atoms = F.transform(F.slice("l", 5, F.col("n_atoms")), lambda x: F.struct(number(x, 1, 10, "double").alias("x"), number(x, 11, 10, "double").alias("y"), number(x, 21, 10, "double").alias("z"), F.trim(F.substring(x, 32, 3)).alias("element")))
    bonds = F.transform(F.slice("l", F.col("n_atoms") + 5, F.col("n_bonds")), lambda x: F.struct(number(x, 1, 3, "int").alias("i"), number(x, 4, 3, "int").alias("j"), number(x, 7, 3, "int").alias("order")))
    rows = rows.withColumn("error", error)
    fine = F.col("error") == ""
    return rows.select(*keys, "record", F.trim(F.col("l")[0]).alias("name"), "n_atoms", "n_bonds", F.when(fine, atoms).alias("atoms"), F.when(fine, bonds).alias("bonds"), "error")


# -- documents of settings -------------------------------------------------------------------------------


def canonical_json(settings: dict) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def settings_hash(settings: dict, leave_out: Iterable[str] = ()) -> str:
    """The identity of settings: SHA-256 of their canonical form, without fields that say nothing about results."""
    skip = set(leave_out)
    return hashlib.sha256(canonical_json({k: v for k, v in settings.items() if k not in skip}).encode()).hexdigest()


class SettingsError(ValueError):
    """A field of a settings document that does not hold."""


#: What each field of a protocol must satisfy; the message names the field.
CHECKS = {
    "engine.scoring": (lambda v: isinstance(v, str) and v.strip() != "", "must not be empty"),
    "engine.exhaustiveness": (lambda v: int(v) >= 1, "must be at least 1"),
    "engine.num_poses": (lambda v: int(v) >= 1, "must be at least 1"),
    "engine.min_rmsd": (lambda v: float(v) > 0, "must be positive"),
    "box.spacing": (lambda v: float(v) > 0, "must be positive"),
    "box.ligand_padding": (lambda v: float(v) >= 0, "must not be negative"),
    "execution.checkpoint_every": (lambda v: int(v) >= 1, "must be at least 1"),
    "library.format": (lambda v: v in ("jsonl", "csv"), "must be jsonl or csv"),
    "library.consensus_method": (lambda v: v in ("rank", "borda", "z"), "must be rank, borda or z"),
}


def validated(protocol: dict) -> dict:
    """The protocol, if every field that it has holds; else SettingsError names the first that does not."""
    for path, (holds, message) in CHECKS.items():
        section, field = path.split(".")
        if field in protocol.get(section, {}) and not holds(protocol[section][field]):
            raise SettingsError(f"{path} {message}, got {protocol[section][field]!r}")
    return protocol


def check_resume(stored: dict, now: dict, leave_out: Iterable[str] = ()) -> list[str]:
    """Fields in which a campaign that is taken up again differs from what it was begun with."""
    skip = set(leave_out)
    return sorted(k for k in (stored.keys() | now.keys()) - skip if stored.get(k) != now.get(k))
