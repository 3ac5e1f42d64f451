"""Following links to their end: pointer doubling over a relation of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.sources.storage import discard, stored


def ends(links: DataFrame) -> DataFrame:
    """(id, end, total): where the links from each id end, and the sum of their weights; null and null where they never do.

    links: id (each once), next (null at an end), weight of the step to next.  A next that isn't an id is an end itself.  Every round doubles the
    steps that are known, by one join of the open rows with all rows, so chains of n links take log2(n) rounds.  Of the rows that are
    open and don't lie on or before a cycle some are closed in each round, so a round that closes none ends the work.
    """
    c = F.col
    own = links.select("id", "next", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    outside = own.where("next is not null").select(c("next").alias("id")).distinct().join(own.select("id"), "id", "left_anti")
    every = own.unionByName(outside.select("id", F.lit(None).cast(own.schema["next"].dataType).alias("next"), F.lit(0).cast("long").alias("weight")))
    is_end = c("next").isNull()
    now = stored(every.select("id", F.coalesce("next", "id").alias("end"), F.when(is_end, 0).otherwise(c("weight")).cast("long").alias("total"), is_end.alias("done")), "links")
    left = now.where("not done").count()
    while left:
        on = now.select(c("id").alias("via"), c("end").alias("beyond"), c("total").alias("more"), c("done").alias("reached"))
        further = now.where("not done").join(on, c("end") == c("via")).select("id", c("beyond").alias("end"), (c("total") + c("more")).alias("total"), c("reached").alias("done"))
        after = stored(now.where("done").unionByName(further), "links")
        still = after.where("not done").count()
        discard(now)
        now, before, left = after, left, still
        if still == before:
            break
    found = lambda name: F.when(c("done"), c(name)).alias(name)
    return now.select("id", found("end"), found("total"))


def symbol_depth(symbols: DataFrame) -> DataFrame:
    """(id, depth): how many symbols other than namespaces contain each symbol.

    symbols: id, parent, kind.  A parent that isn't in the table is none; a symbol that contains itself, over any number of steps, has no
    depth; of several rows with one id the one with the smallest parent and kind counts.
    """
    c = F.col
    own = symbols.where("id is not null").groupBy("id").agg(F.min(F.struct("parent", "kind")).alias("s")).select("id", "s.*")
    above = own.select(c("id").alias("next"), (F.coalesce("kind", F.lit("")) != "namespace").cast("long").alias("weight"))
    links = own.join(above, c("parent") == c("next"), "left").select("id", "next", "weight")
    return ends(links).select("id", c("total").alias("depth"))


def forwarded(references: DataFrame, forwarding: DataFrame) -> DataFrame:
    """references with ``resolved``, the assembly that a type has been moved to, over any number of moves; null where moves go round.

    references: assembly, type and more; forwarding: assembly, type, to_assembly.  A type that isn't moved stays where it is; of several moves of one type
    the smallest counts.
    """
    c = F.col
    moves = forwarding.where("to_assembly is not null").groupBy("assembly", "type").agg(F.min("to_assembly").alias("to_assembly"))
    place = lambda assembly: F.struct(c(assembly).alias("assembly"), c("type"))
    found = ends(moves.select(place("assembly").alias("id"), place("to_assembly").alias("next"), F.lit(1).alias("weight")))
    found = found.select(c("id.assembly").alias("assembly"), c("id.type").alias("type"), c("end.assembly").alias("moved"), F.lit(True).alias("known"))
    out = references.join(found, ["assembly", "type"], "left")
    return out.withColumn("resolved", F.when(c("known"), c("moved")).otherwise(c("assembly"))).drop("moved", "known")
