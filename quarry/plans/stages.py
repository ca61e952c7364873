"""Intermediate tables in the folder that driver and executors share.

A table that is written and read again cuts the lineage, survives lost executors, and is the same for every plan that
reads it: ranges sampled anew by each plan, or ids made by the order of rows, are not.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a folder below the warehouse is set and used. A cluster
    without the setting is refused, for its local folders are not shared.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as Hadoop has it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes with the application at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    for path in paths:
        fs, p = hadoop(spark, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, codec: str = "zstd", sub: str = "") -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder (below ``sub`` there) and reads it again; the frame and the folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    at = f"{path}/{sub}" if sub else path
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(schema).parquet(at), path


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that never goes through the driver: Spark broadcasts by the compressed size of a shuffle, and in rounds
    the driver would gather such a table in each of them."""
    return df.hint("merge")


def tasks_for(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
