"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards. Compaction looks at sizes alone: shards below the target are put into tiers, each
four times the size of the one before; within a tier, in order of arrival, runs of shards are merged into files
of about the target size. Shards at the target, and runs of one, stay as they are. Readers see the shards that the
newest manifest names. A manifest is a Parquet table of shards beside the store's schema; it is written under a name of its
own and renamed to its version, which fails if another writer took the version first. The loser removes what it
wrote and starts again from the new head. Shards are never changed; ``vacuum`` removes those that no kept manifest names.

Data moves through DataFrame functions alone, and so does the manifest: the driver handles one row for each write, not
one for each shard. Sizes are the UTF-8 bytes of the text, so a plan depends on the rows and not on files. The columns of a
row lie in one struct, so columns of any name are kept and none clashes with the store's. An append may
bring new columns (older rows have null there) or lack some (its rows have null); a column of another type is
refused with ``SchemaChange``, and nothing is written. Null texts have no bytes and stay null. Rows with null ids arrive in
shards of their own, by a hash of the text. Repeated rows are kept; an append of no rows is a version without new
shards. A task that is lost writes its file again under another name; Spark commits only one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ranking import running_total

from .common import drop_path, hadoop, new_path, packed, tasks_for, tune, written

TARGET_BYTES = 32 << 20
#: The smallest tier ends here; each further tier is four times as large.
TIER_BYTES, FANOUT, TIERS = 256 << 10, 4, 12
#: Rows of an arrival in the query.
ARRIVAL_ROWS = 250
#: Groups that rows without an id are dealt into.
NULL_ARRIVALS = 64
#: How often a writer starts again after another one was first.
ATTEMPTS = 5

SHARDS = "shard string, write string, bytes long, rows long, arrival long"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class SchemaChange(ValueError):
    """A column has another type than in the store."""


def arrival_of(doc_id: Column, text: Column, rows: int = ARRIVAL_ROWS) -> Column:
    """The arrival of a row: a range of ids."""
    return F.when(doc_id.isNull(), -1 - F.pmod(F.xxhash64(text), F.lit(NULL_ARRIVALS))).otherwise(F.floor(doc_id / F.lit(rows)))


def tier_of(size: Column) -> Column:
    """How many tier ends are not above the size."""
    return sum((F.when(size >= TIER_BYTES * FANOUT**k, 1).otherwise(0) for k in range(TIERS)), F.lit(0)).cast("int")


def plan(shards: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """``shards`` with ``merged``: the name of the shard that each goes to, or its own.

    Bytes are counted on through each tier by ranges of arrival, so no task holds a tier.
    """
    tiered = shards.withColumn("tier", tier_of(F.col("bytes")))
    small = running_total(tiered.where(F.col("bytes") < target), ["tier"], ["arrival", "shard"], "bytes", "upto")
    run = F.floor((F.col("upto") - F.col("bytes")) / F.lit(target)).cast("long")
    small = small.withColumn("run", run)
    several = small.groupBy("tier", "run").agg(F.count("*").alias("n")).where("n > 1").select("tier", "run")
    moved = small.join(several.withColumn("name", F.concat_ws("-", F.lit("t"), F.col("tier").cast("string"), F.col("run").cast("string"))), ["tier", "run"], "left")
    merged = moved.select(*shards.columns, F.coalesce("name", "shard").alias("merged"))
    return merged.unionByName(tiered.where(F.col("bytes") >= target).select(*shards.columns, F.col("shard").alias("merged")))


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """All columns of both, as nullable; raises SchemaChange where one has two types."""
    fields = {f.name: T.StructField(f.name, f.dataType, True) for f in (old.fields if old else [])}
    for f in new.fields:
        held = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        if held.dataType != f.dataType:
            raise SchemaChange(f"{f.name} is {held.dataType.simpleString()} in the store, {f.dataType.simpleString()} here")
    return T.StructType(list(fields.values()))


class ShardStore:
    """A folder with ``data/write=ID/shard=NAME/`` and ``manifest/VERSION/{schema.json,shards/}``."""

    def __init__(self, spark: SparkSession, path: str, text_col: str = "text"):
        self.spark, self.path, self.text_col = tune(spark), path.rstrip("/"), text_col

    # -- manifests ---------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit())

    def head(self, version: int | None = None) -> dict:
        """Version, schema, and the writes (with the shards that each made) that a manifest stands on, the newest by default."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "writes": {}}
        at = found[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{at:08d}/schema.json", wholetext=True).first()[0])

    def shards(self, version: int | None = None) -> DataFrame:
        """The shards of a version: name, write, bytes, rows, first arrival."""
        at = self.head()["version"] if version is None else version
        return self.spark.read.schema(SHARDS).parquet(f"{self.path}/manifest/{at:08d}/shards") if at else self.spark.createDataFrame([], SHARDS)

    def commit(self, base: int, shards: DataFrame, schema: T.StructType, writes: dict[str, int]) -> int:
        """Names the shards of version ``base + 1``; raises Conflict if that version is there already."""
        jvm = self.spark.sparkContext._jvm
        version = base + 1
        draft = f"{self.path}/manifest/.{version:08d}-{uuid.uuid4().hex}"
        shards.write.parquet(f"{draft}/shards")
        fs, folder = hadoop(self.spark, draft)
        out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, "schema.json"), False)
        out.write(json.dumps({"version": version, "schema": json.loads(schema.json()), "writes": writes}).encode())
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{version:08d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri() if folder.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # a rename that never replaces
            context.rename(folder, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            drop_path(self.spark, draft)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    def _attempt(self, write: Callable[[dict, str], int]) -> int:
        """Calls ``write(head, id)`` until no other writer is first; what a failed attempt wrote is removed."""
        for k in range(ATTEMPTS):
            name = uuid.uuid4().hex
            try:
                return write(self.head(), name)
            except BaseException as e:
                drop_path(self.spark, f"{self.path}/data/write={name}")
                if not isinstance(e, Conflict) or k + 1 == ATTEMPTS:
                    raise
        raise AssertionError

    # -- data --------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, write: str) -> None:
        """``(shard, arrival, row)`` -> one folder for each shard."""
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.path}/data/write={write}")

    def _rows(self, writes: list[str], schema: T.StructType) -> DataFrame:
        """``(arrival, row, write, shard)`` of some writes, with the columns of ``schema``."""
        fields = T.StructType([T.StructField("arrival", T.LongType()), T.StructField("row", schema), T.StructField("write", T.StringType()), T.StructField("shard", T.StringType())])
        if not writes:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/write={w}" for w in writes])

    def _sizes(self, write: str, schema: T.StructType) -> DataFrame:
        """The shards of a write."""
        size = F.coalesce(F.sum(F.octet_length(F.col("row").getField(self.text_col)).cast("long")), F.lit(0))
        return self._rows([write], schema).groupBy("shard", "write").agg(size.alias("bytes"), F.count("*").alias("rows"), F.min("arrival").alias("arrival")).select("shard", "write", "bytes", "rows", "arrival")

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Writes each arrival as a small shard of its own and commits it."""

        def write(head: dict, name: str) -> int:
            schema = merged_schema(T.StructType.fromJson(head["schema"]) if head["schema"] else None, rows.schema)
            named = packed(rows, arrival=arrival.cast("long"))
            named = named.withColumn("shard", F.concat_ws("-", F.lit(f"a{head['version'] + 1}"), F.col("arrival").cast("string")))
            self._write(named.repartition(tasks_for(self.spark), "arrival"), name)
            new, path = written(self._sizes(name, schema), "shard-sizes")
            made = new.count()
            done = self.commit(head["version"], self.shards(head["version"]).unionByName(new), schema, head["writes"] | ({name: made} if made else {}))
            drop_path(self.spark, path)
            return done

        return self._attempt(write)

    def read_shards(self, version: int | None = None) -> DataFrame:
        """``(shard, arrival, row)`` of a version: the row's columns lie in the struct.

        Writes whose shards are all named are read as they are; of others, the shards that the version names.
        """
        head = self.head(version)
        if head["schema"] is None:
            raise ValueError("the store is empty")
        schema, live = T.StructType.fromJson(head["schema"]), self.shards(head["version"])
        named = {r["write"]: r["n"] for r in live.groupBy("write").agg(F.count("*").alias("n")).collect()}  # a row for each write
        whole = [w for w, n in head["writes"].items() if named.get(w) == n]
        part = [w for w in named if w not in whole]
        rows = self._rows(whole, schema)
        if part:
            rows = rows.unionByName(self._rows(part, schema).join(live.select("write", "shard"), ["write", "shard"], "left_semi"))
        return rows.select("shard", "arrival", "row")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the columns of the store's schema."""
        rows = self.read_shards(version)
        return rows.select(*[F.col("row").getField(f.name).alias(f.name) for f in rows.schema["row"].dataType.fields])

    def compact(self, target: int = TARGET_BYTES, keep_versions: int = 1) -> int:
        """Merges runs of similar shards, commits the outcome and removes what no kept version names.

        Readers of the version before need ``keep_versions`` of 2 until they have ended.
        """

        def write(head: dict, name: str) -> int:
            if head["schema"] is None:
                return head["version"]
            version, schema = head["version"] + 1, T.StructType.fromJson(head["schema"])
            planned, path = written(plan(self.shards(head["version"]), target), "shard-plan")
            moves = planned.where(F.col("merged") != F.col("shard")).select("shard", F.concat("merged", F.lit(f"-v{version}")).alias("to"))
            targets = moves.agg(F.count_distinct("to")).first()[0]
            if targets:
                rows = self.read_shards(head["version"]).join(moves, "shard").select(F.col("to").alias("shard"), "arrival", "row")
                # a task has few targets and writes one after the other
                self._write(rows.repartition(max(targets, tasks_for(self.spark)), "shard"), name)
                new, sizes = written(self._sizes(name, schema), "shard-sizes")
                stay = planned.where(F.col("merged") == F.col("shard")).drop("merged")
                version = self.commit(head["version"], stay.unionByName(new), schema, head["writes"] | {name: targets})
                self.vacuum(keep_versions)
                drop_path(self.spark, sizes)
            drop_path(self.spark, path)
            return version if targets else head["version"]

        return self._attempt(write)

    def vacuum(self, keep_versions: int = 1) -> None:
        """Removes manifests but for the newest, and what those do not name: writes as a whole, or single shards of them."""
        found = self.versions()
        kept = None
        for v in found[-keep_versions:]:
            kept = self.shards(v) if kept is None else kept.unionByName(self.shards(v))
        if kept is None:
            return
        kept = kept.select("write", "shard").distinct()
        live = {r["write"] for r in kept.select("write").distinct().collect()}  # a row for each write
        old = found[:-keep_versions]
        for w in {w for v in old for w in self.head(v)["writes"]} - live:
            drop_path(self.spark, f"{self.path}/data/write={w}")
        for v in old:
            gone = self.shards(v).where(F.col("write").isin(sorted(live))).join(kept, ["write", "shard"], "left_anti").select("write", "shard")
            for r in gone.toLocalIterator():
                drop_path(self.spark, f"{self.path}/data/write={r['write']}/shard={r['shard']}")
        for v in old:
            drop_path(self.spark, f"{self.path}/manifest/{v:08d}")


def compacted_documents(docs: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """Appends the documents by arrival, compacts, and reads the committed store:
    ``(doc_id, arrival, shard, n_bytes, text_sha256)``."""
    spark = docs.sparkSession
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append(docs, arrival_of(F.col("doc_id"), F.col("text")))
    store.compact(target)
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    name = F.regexp_replace("shard", "^a[0-9]+|-v[0-9]+$", "")
    return store.read_shards().select(F.col("row").getField("doc_id").alias("doc_id"), "arrival", name.alias("shard"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


#: The same rows by SQL; names of shards follow from sizes alone.
SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(floor(doc_id / {ARRIVAL_ROWS}) AS BIGINT) AS arrival FROM documents
), sizes AS (
  SELECT arrival, sum(octet_length(encode(text))) AS bytes FROM docs GROUP BY arrival
), tiers AS (
  SELECT *, {" + ".join(f"CASE WHEN bytes >= {TIER_BYTES * FANOUT**k} THEN 1 ELSE 0 END" for k in range(TIERS))} AS tier FROM sizes
), runs AS (
  SELECT *, CAST(floor(coalesce(sum(bytes) OVER (PARTITION BY tier ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {TARGET_BYTES}) AS BIGINT) AS run
  FROM tiers WHERE bytes < {TARGET_BYTES}
), named AS (
  SELECT arrival, CASE WHEN count(*) OVER (PARTITION BY tier, run) > 1 THEN 't-' || tier || '-' || run ELSE '-' || arrival END AS shard FROM runs
  UNION ALL SELECT arrival, '-' || arrival FROM tiers WHERE bytes >= {TARGET_BYTES}
)
SELECT doc_id, arrival, shard, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
FROM docs JOIN named USING (arrival)
"""
