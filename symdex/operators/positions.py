"""Places of prefix ranges in the sorted table of names, as numbers (low, high) and without reading the range.

``fences`` is a sparse index: of each ``BLOCK`` rows in index order the first key and place.  ``bounds_of`` finds one word's range with it: a fence says
which block each end of the range lies in, and only these two blocks are read, as their places are pushed to the Parquet scan.
``bounds`` finds the ranges of any number of words in one pass: distinct keys with their counts and the words' ends are dealt by ranges of one order, and
the counts before each end are summed within a range and over the ranges.

Order is that of UTF-8 bytes.  The byte FF occurs in no key, so a word followed by it stands right behind all keys that start with the word.  A word without
hits has the place where it would stand as low, and high is low - 1; the empty word has all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.functions.text import fold_case, folded
from symdex.sources.storage import stored

#: Rows between two fences.
BLOCK = 8192


def fences(names: DataFrame, key: str = "name_key", place: str = "pos", block: int = BLOCK) -> DataFrame:
    """(first_key, first): key and place of every ``block``-th row of a table that is numbered in the order of its key."""
    return names.where(F.col(place) % block == 0).select(F.col(key).alias("first_key"), F.col(place).alias("first"))


def _ends(key: Column, word: str) -> dict[str, Column]:
    """Conditions on a key: before the word, and before or in its range."""
    before = key < F.lit(word)
    return {"low": before, "high": before | key.startswith(word)}


def bounds_of(names: DataFrame, fence: DataFrame, word: str, key: str = "name_key", place: str = "pos", block: int = BLOCK) -> tuple[int, int]:
    """(low, high) of one word, whatever its case."""
    word = folded(word)
    found = fence.agg(*(F.max(F.when(x, F.col("first"))).alias(name) for name, x in _ends(F.col("first_key"), word).items())).first()
    out = []
    for name, x in _ends(F.col(key), word).items():
        first = found[name]
        if first is None:  # not even the first row
            out.append(0)
        else:
            out.append(first + names.where(F.col(place).between(first, first + block - 1)).where(x).count())
    return out[0], out[1] - 1


def slice_of(names: DataFrame, low: int, high: int, place: str = "pos") -> DataFrame:
    """The rows of a range by their places."""
    return names.where(F.col(place).between(low, high))


def bounds(names: DataFrame, words: DataFrame, key: str = "name_key") -> DataFrame:
    """(word, low, high) of every distinct word.  words: word; nulls are left out."""
    c = F.col
    asked = words.where("word is not null").select("word").distinct().withColumn("k", fold_case("word").cast("binary"))
    ends = asked.select("word", F.explode(F.array(F.struct(F.lit("low").alias("end"), c("k")), F.struct(F.lit("high").alias("end"), F.concat("k", F.lit(b"\xff")).alias("k")))).alias("x")).select("word", "x.*", F.lit(0).cast("long").alias("n"))
    held = names.groupBy(c(key).cast("binary").alias("k")).agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("end"), "k", "n")
    # an end comes before a key that equals it
    order = ["k", "of_key", "word"]
    both = ends.unionByName(held).withColumn("of_key", c("end").isNull())
    split = stored(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merged")
    sizes = split.groupBy("part").agg(F.sum("n").alias("size"))
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = split.withColumn("before", F.sum("n").over(within)).where("end is not null").join(F.broadcast(offsets), "part")
    at = placed.select("word", "end", (c("before") + c("offset")).alias("at"))
    return at.groupBy("word").agg(F.max(F.when(c("end") == "low", c("at"))).alias("low"), (F.max(F.when(c("end") == "high", c("at"))) - 1).alias("high"))
