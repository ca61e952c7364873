"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.stages import drop_path, hadoop, new_path, release, shared_dir, shuffled, tasks_for, written

__all__ = ["drop_path", "hadoop", "map_rows", "new_path", "packed", "quoted", "release", "row_key", "shared_dir", "shuffled", "table", "tasks_for", "texts", "trim", "trimmed", "tune", "unpacked", "written"]

#: Rows of one Arrow batch; documents are long, so batches stay near a few MB.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark alone (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for long texts; shuffle files go as soon as the job that made them has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone: other columns, whatever their names, play no part; null text is empty."""
    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """SHA-256 of id and text, as bytes: rows that are equal in both share it; others would with a probability of 2**-128 and less."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), text).cast("binary"), 256))


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside the extra ones, so that no name of theirs can clash."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of a packed frame in their order; those named in ``changed`` have new values."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])


def trim() -> None:
    """Gives memory that a task no longer uses back to the system; Python workers live on for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, which trims the worker's memory once a task has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def map_rows(df: DataFrame, fn: Callable[[list, list], dict], schema: str) -> DataFrame:
    """``fn(ids, texts) -> columns`` over Arrow batches of ``(doc_id, text)``.

    ``fn`` is a zero-argument factory's product, so that each task builds its state once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(work(b.column(0).to_pylist(), b.column(1).to_pylist()))

    return df.mapInArrow(trimmed(run), schema)
