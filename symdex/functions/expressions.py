"""Build-file expressions: property and item references inside text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_START = re.compile(r"[$@]\(")
_STEP = re.compile(r"[(),-]")


def pieces(text: str) -> list[str]:
    """Literals and expressions of a text, in order.

    An expression ends at its closing parenthesis, one on items also after a comma or dash; another expression inside
    cuts it.  From an expression that doesn't end, the rest is one piece.
    """
    starts = [m.start() for m in _START.finditer(text)]
    cuts = [0]
    for start, following in zip(starts, [*starts[1:], len(text)], strict=False):
        end, depth = None, 1
        for m in _STEP.finditer(text, start + 2):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if depth == 0 or (text[start] == "@" and m[0] in ",-"):
                end = m.end()
                break
        cuts.append(start)
        if end is None:
            break
        cuts.append(min(end, following))
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def split_expressions(text: Column) -> Column:
    """The pieces of a text; balanced parentheses are beyond regular expressions, so this runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pieces(t))

    return run(text)


def expression_refs(df: DataFrame, column: str = "text") -> DataFrame:
    """The columns of df with kind and name of each property or item that an expression uses."""
    piece = F.col("piece")
    inner = F.regexp_replace(F.regexp_replace(piece, r"^[$@]\(", ""), r"[),-]$", "")
    out = df.withColumn("piece", F.explode(split_expressions(F.col(column)))).where(piece.rlike(r"^[$@]\("))
    kind = F.when(piece.startswith("$("), "property").when(~piece.contains("%"), "item")
    name: Column = F.when(piece.startswith("$("), F.regexp_extract(inner, r"^[^.]*", 0)).otherwise(inner)
    return out.withColumn("kind", kind).withColumn("name", F.trim(name)).where("kind is not null and name <> ''").drop("piece")
