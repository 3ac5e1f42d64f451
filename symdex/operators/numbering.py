"""Dense numbers in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symdex.sources.storage import stored


def dense(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``, 0, 1, 2 ... in the order of columns that leave no ties.

    A global row_number would sort all rows in one task.  Rows are dealt by ranges instead and numbered in each range; only the sizes of
    the ranges (one for each shuffle partition) are summed in one place.
    """
    split = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    split = stored(split, "numbered")
    sizes = split.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return split.join(F.broadcast(offsets), "__part").withColumn(name, within + F.col("__before")).drop("__part", "__id", "__before")


def within(df: DataFrame, group: list[str], order: list, name: str, last: str | None = None) -> DataFrame:
    """Adds ``name``, 1, 2, 3 ... in the order of columns within each group, however large a group is, and ``last``, whether a row ends its group.

    Rows are dealt by ranges of group and order, so a large group has several ranges, and are numbered in each range.  A range shares at most
    one group with the ranges before it and one with those behind it; for these alone, two rows for each range at most, the rows before it are summed.
    """
    split = stored(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    parts = Window.partitionBy(*group).orderBy("__part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy(*group, "__part").agg(F.count("*").alias("__size"))
    offsets = sizes.select(*group, "__part", F.sum("__size").over(before).alias("__before"), F.lead("__part").over(parts).isNotNull().alias("__after")).where("__before is not null or __after")
    own = Window.partitionBy("__part", *group).orderBy(*order)
    place = F.row_number().over(own).cast("long")
    offsets = offsets.select(F.col("__part").alias("__of"), "__before", "__after", *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)))
    same = F.col("__part") == F.col("__of")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    ends = F.lead("__part").over(own).isNull()
    numbered = split.withColumns({name: place, "__ends": ends} if last else {name: place}).join(F.broadcast(offsets), same, "left")
    numbered = numbered.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0)))
    if last is None:
        return numbered.select(*df.columns, name)
    return numbered.select(*df.columns, name, (F.col("__ends") & ~F.coalesce("__after", F.lit(False))).alias(last))
