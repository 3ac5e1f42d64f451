"""Places of regular-expression matches as Spark columns, without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are numbered together; more are numbered chunk by chunk, so that the work stays linear.
CHUNK = 256
#: Characters before a match that count as its context.
CONTEXT = 40

SPAN = "array<struct<start: int, stop: int, text: string, value: string, before: string>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def find(text: Column, pattern: str, quick: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in text, ascending, as ``SPAN``.

    start and stop count code points, stop is exclusive; value is the group asked for; before holds up to ``CONTEXT`` characters
    between the previous match and this one.  quick: a cheap condition that every text with a match fulfils.  The pattern must
    not match an empty string.
    """
    p = F.lit(pattern)
    parts = F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        (F.regexp_extract_all(text, p, F.lit(group)) if group else F.lit(None).cast("array<string>")).alias("v"),
        F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.char_length(x).alias("n"), F.right(x, F.lit(CONTEXT)).alias("t"))).alias("g"),
    )

    def place(s: Column) -> Column:
        m, v, g = s["m"], s["v"], s["g"]
        n = F.size(m)
        width = lambda i: g[i]["n"] + F.char_length(m[i])
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        within = lambda c: F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, n) - 1)
        total = F.transform(chunks, lambda c: F.aggregate(within(c), F.lit(0), lambda a, i: a + width(i)))
        starts = lambda t: F.aggregate(t, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        empty = F.lit(None).cast(SPAN)

        def number(first: Column, c: Column) -> Column:
            def step(a: Column, i: Column) -> Column:
                low = a["at"] + g[i]["n"]
                high = low + F.char_length(m[i])
                span = F.struct(low.alias("start"), high.alias("stop"), m[i].alias("text"), (v[i] if group else m[i]).alias("value"), g[i]["t"].alias("before"))
                return F.struct(high.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

            return F.aggregate(within(c), F.struct(first.alias("at"), F.coalesce(empty, F.array().cast(SPAN)).alias("out")), step, lambda a: a["out"])

        spans = bind(starts(total), lambda t: F.flatten(F.transform(chunks, lambda c: number(t[c], c))))
        return F.when(n > 0, spans).otherwise(F.array().cast(SPAN))

    return F.when(quick, bind(parts, place)).otherwise(F.array().cast(SPAN))


def named(spans: Column, kind: str) -> Column:
    """kind:start:stop of each span."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))
