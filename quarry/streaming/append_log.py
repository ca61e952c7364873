"""The append-only result log as a stream: rows arrive as files, each key is written once, and a restart goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.library import first_rows


def append_once(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: list[str], available_now: bool = True):
    """Starts a query that appends to ``target`` the first row of each key that is not there yet.

    A batch that is run again finds its keys written and adds nothing, so a crash between write and commit does no harm.
    Each batch is a folder of its own name, which a second run of the batch replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = first_rows(batch, keys, order)
        before = _earlier(spark, target, number)
        if before is not None:
            rows = rows.join(before.select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(source)
    writer = reader.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _earlier(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    if not any(s.getPath().getName() != f"batch={number}" for s in fs.listStatus(path)):
        return None
    return spark.read.parquet(target).where(F.col("batch") != number)


def progress(spark: SparkSession, target: str) -> DataFrame:
    """Rows by receptor and status that are on disk so far."""
    return spark.read.parquet(target).groupBy("receptor", "status").agg(F.count("*").alias("n"))
