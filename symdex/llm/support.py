"""Session helpers of the corpus operators: tables, shared storage, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: later steps neither recompute it nor depend on an executor.

    The shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` has written and no later step reads."""
    for df in frames:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return in_batches(df).mapInArrow(run, schema)


def in_batches(df: DataFrame, size: str = BATCH_BYTES) -> DataFrame:
    """df, in a session that hands rows to Python by bytes rather than by their number; another size holds until the next call."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def with_text(documents: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """Columns ``keep`` with the text as a string, and its name; a text that is kept isn't sent twice."""
    if "text" in keep and dict(documents.dtypes)["text"] == "string":
        return documents.select(*keep), "text"
    name = "__text"
    while name in keep:
        name += "_"
    return documents.select(*keep, F.col("text").cast("string").alias(name)), name


def id_and_text(documents: DataFrame) -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column | str) -> Column:
    """crc32 of the document id as text, modulo 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(5)


def is_settled(edges: DataFrame) -> bool:
    """Whether each node ``a`` has one edge, to a node that has none; edges go to the smaller node, so that one is then the smallest of all."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is two aggregations and joins over the edges, the
    number of rounds grows with the logarithm of the number of nodes.  The smallest neighbours are written before they are joined, so
    the join has a shuffle of its own, and Spark splits a node with very many edges there.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    for _ in range(rounds):
        if is_settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        discard(now, least)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
        small = large.join(least, large.a == least.u).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        now = stored(small.select("e.*").where("a <> b").distinct(), "small")
        discard(large, least)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
