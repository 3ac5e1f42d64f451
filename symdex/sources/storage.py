"""Shared storage of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A session of one machine that names none gets a temporary one; on a cluster that would be a folder of each machine, so there it is
    an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symdex-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` has written and no later step reads."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, where = file_system(df.sparkSession, folder)
            fs.delete(where, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once and read back, so that later steps see the very same rows and no executor holds them."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
