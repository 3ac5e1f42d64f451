"""The query language as column expressions: a query string becomes terms, and terms become interpretations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .symbols import KINDS
from .text import last_part, strip_quotes_loose, strip_quotes_strict

TOKEN = '"[^"]*"|"[^"]*$|[^ "]+'
# File extensions that turn a dotted term into a file name, and prefixes of accessors.
EXTENSIONS = ("cs", "vb", "ts", "csproj", "vbproj", "targets", "props", "xaml", "xml", "resx")
ACCESSORS = ("get_", "set_", "add_", "remove_")
SHORTEST, LONGEST = 3, 260


def tokens(query: Column) -> Column:
    """Terms between spaces; quotes group, stay in the term and end it, and an open quote runs to the end."""
    return F.regexp_extract_all(query, F.lit(TOKEN), F.lit(0))


def classified(query: Column) -> Column:
    """struct(kinds, paths, dotted, names)."""
    return F.get(F.transform(F.array(tokens(query)), _classes), F.lit(0))  # terms are made once


def _classes(t: Column) -> Column:
    kind = lambda x: x.isin(*KINDS)
    path = lambda x: ~kind(x) & x.contains("\\")
    new = lambda p: F.array_distinct(F.filter(t, p))
    # a path that has come before is no path again but falls to the next rule
    again = F.filter(t, lambda x, i: path(x) & F.array_contains(F.slice(t, F.lit(1), i), x))
    dotted = F.filter(t, lambda x: ~kind(x) & ~path(x) & x.contains("."))
    names = F.filter(t, lambda x: ~kind(x) & ~path(x) & ~x.contains("."))
    return F.struct(
        F.filter(t, kind).alias("kinds"),
        new(path).alias("paths"),
        F.array_distinct(F.concat(dotted, F.filter(again, lambda x: x.contains(".")))).alias("dotted"),
        F.array_distinct(F.concat(names, F.filter(again, lambda x: ~x.contains(".")))).alias("names"),
    )


INTERPRETATION = "struct<core: string, verbatim: boolean, namespace: string, words: array<string>, dotted: array<string>>"


def interpretations(q: Column) -> Column:
    """Array of the ways to read classified terms: each has a core to look up and filters."""

    def reading(core: Column, verbatim: Column, namespace: Column, words: Column, dotted: Column) -> Column:
        return F.struct(core.alias("core"), verbatim.alias("verbatim"), namespace.alias("namespace"), words.alias("words"), dotted.alias("dotted")).cast(INTERPRETATION)

    none, no = F.lit(None).cast("string"), F.array().cast("array<string>")
    bare_all = lambda a: F.transform(a, strip_quotes_loose)

    def of_name(x: Column) -> Column:
        """Other names filter; they are compared with the bare core, so a quoted name also filters on itself."""
        bare = strip_quotes_strict(x)
        return reading(bare["text"], bare["quoted"], none, bare_all(F.filter(q["names"], lambda w: w != bare["text"])), bare_all(q["dotted"]))

    def of_dotted(x: Column) -> Column:
        bare = strip_quotes_strict(x)
        whole = bare["text"]
        tail = last_part(whole)
        file = F.exists(F.array(*map(F.lit, EXTENSIONS)), lambda e: e.startswith(F.lower(tail)))
        symbol = reading(tail, bare["quoted"], whole, bare_all(q["names"]), bare_all(F.filter(q["dotted"], lambda w: w != whole)))
        return F.when(file, reading(whole, bare["quoted"], none, no, no)).otherwise(symbol)

    def with_accessor(r: Column) -> Column:
        cut = F.lit(None).cast("string")
        for a in reversed(ACCESSORS):
            cut = F.when(r["core"].startswith(a), F.lit(a)).otherwise(cut)
        clone = reading(F.substring(r["core"], F.length(cut) + 1, F.length(r["core"])), r["verbatim"], F.replace(r["namespace"], cut, F.lit("")), r["words"], r["dotted"])
        return F.when(cut.isNull(), F.array(r)).otherwise(F.array(r, clone))

    long = F.filter(q["names"], lambda x: F.length(x) >= SHORTEST)
    return F.flatten(F.transform(F.concat(F.transform(long, of_name), F.transform(q["dotted"], of_dotted)), with_accessor))


def search_terms(q: Column) -> Column:
    """struct(assembly, project, msbuild, symbol): what the other finders look up; null for none."""
    first = lambda a: F.get(q[a], F.lit(0))
    symbol = F.coalesce(first("names"), last_part(first("dotted")))
    return F.struct(
        F.coalesce(first("dotted"), first("names")).alias("assembly"),
        first("paths").alias("project"),
        first("names").alias("msbuild"),
        F.when(F.length(symbol) >= SHORTEST, symbol).alias("symbol"),
    )


def diagnostics(query: Column) -> Column:
    """Why a query isn't run; null if it is."""
    return F.when(query.isNull() | (F.length(query) < SHORTEST), F.lit("too short")).when(F.length(query) > LONGEST, F.lit("too long"))


#: Finders in the order in which their results are shown.
SECTIONS = ("symbols", "assemblies", "projects", "guids", "MSBuildProperty", "MSBuildItem", "MSBuildTarget", "MSBuildTask")


def sections(q: Column) -> Column:
    """Finders that a query goes to: a kind word that names one picks it alone."""
    out = F.array(*map(F.lit, SECTIONS))
    for kind in ("MSBuildTask", "MSBuildTarget", "MSBuildItem", "MSBuildProperty"):
        out = F.when(F.array_contains(q["kinds"], kind), F.array(F.lit(kind))).otherwise(out)
    return F.when(F.array_contains(q["kinds"], "assembly"), F.array(F.lit("assemblies"))).otherwise(out)


def parsed(queries: DataFrame, column: str = "query") -> DataFrame:
    """One row per interpretation: the query's columns, ``reading`` (its number) and those of the interpretation."""
    q = queries.withColumn("q", classified(F.col(column)))
    q = q.withColumn("readings", F.when(diagnostics(F.col(column)).isNull(), interpretations(F.col("q"))))
    return q.select(*queries.columns, F.col("q.kinds").alias("kinds"), F.col("q.paths").alias("paths"), F.posexplode("readings").alias("reading", "r")).select("*", "r.*").drop("r")


def rows(spark: SparkSession, *texts: str) -> DataFrame:
    """(query_id, query) of a few texts, as a plan without a job."""
    return spark.sql("SELECT CAST(pos AS BIGINT) AS query_id, col AS query FROM (SELECT posexplode(:texts))", {"texts": list(texts)})
