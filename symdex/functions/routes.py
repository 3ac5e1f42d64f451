"""Addresses of the client: anchors, file names and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extensions that have a page, prefixes of anchors with the folder of their lists, and folders without an overview.
EXTENSIONS = ("cs", "vb", "ts", "csproj", "vbproj", "targets", "props", "xaml", "xml", "resx")
LISTS = {"MSBuildProperty=": "MSBuildProperties", "MSBuildItem=": "MSBuildItems", "MSBuildTarget=": "MSBuildTargets", "MSBuildTask=": "MSBuildTasks"}
LOOSE = ("MSBuildFiles", "TypeScriptFiles")
EMPTY_ARRAYS = "EmptyArrayAllocation"
# Characters that stay as they are in a component of an address, besides those the JVM's encoder leaves.
PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def _first(x: Column, old: str, new: str) -> Column:
    """x with the first occurrence of a text replaced."""
    at = F.instr(x, old)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(new), F.substring(x, at + len(old), F.length(x)))).otherwise(x)


def decode_comma(x: Column) -> Column:
    """The first escaped comma of either case."""
    return _first(_first(x, "%2c", ","), "%2C", ",")


def decode(x: Column) -> Column:
    """Percent escapes, with plus signs as they are; null where an escape is broken."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def ends_with(x: Column, end: str) -> Column:
    """Whatever the case."""
    return F.lower(x).endswith(end.lower())


def trim_from_end(x: Column, end: str) -> Column:
    return F.when(ends_with(x, end), F.substring(x, F.lit(1), F.length(x) - len(end))).otherwise(x)


def extension(x: Column) -> Column:
    """Lower-cased text after the last full stop, the whole text without one."""
    return F.lower(F.substring_index(x, ".", -1))


def is_file(x: Column) -> Column:
    return extension(trim_from_end(x, ".html")).isin(*EXTENSIONS)


def safe_line(x: Column) -> Column:
    """Numbers of lines begin with a letter, so that ids of symbols, which have 16 digits, stay apart."""
    number = x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.length(x) != 16)
    return F.when(number, F.concat(F.lit("l"), x)).otherwise(x)


def displayed_line(x: Column) -> Column:
    return F.when(x == "#", F.lit("")).when(x.startswith("#l"), F.concat(F.lit(","), F.substring(x, F.lit(3), F.length(x)))).otherwise(x)


def displayed_file(x: Column) -> Column:
    """File name in an address: without its page's extension, escaped but for slashes."""
    out = F.url_encode(trim_from_end(x, ".html"))
    for old, new in (PLAIN | {"%2F": "/"}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def routes(df: DataFrame, anchor: str = "anchor") -> DataFrame:
    """df with content, navigation and search: the pages that an anchor opens in either frame, and the text it searches for."""
    c, none = F.col, F.lit(None).cast("string")
    a = c(anchor)
    listed = none
    for name, folder in LISTS.items():
        page = F.concat(F.lit(f"/{folder}/R/"), F.substring(a, F.lit(len(name) + 1), F.length(a)), F.lit(".html"))
        listed = F.coalesce(listed, F.when(F.lower(a).startswith(name.lower()), page))
    listed = F.coalesce(listed, F.when(F.lower(a).startswith(EMPTY_ARRAYS.lower()), F.lit(f"/mscorlib/R/{EMPTY_ARRAYS}.html")), F.when(a == "", F.lit("/")))
    asked = F.when(listed.isNull() & a.startswith("q="), F.try_url_decode(F.replace(F.substring(a, F.lit(3), F.length(a)), F.lit("+"), F.lit("%2B"))))
    x = df.withColumns({"__listed": listed, "__asked": asked, "__text": decode_comma(a)})
    old = ~c("__text").contains(",") & c("__text").contains("#")
    x = x.withColumn("__parts", F.when(old, F.split("__text", "#")).otherwise(F.split("__text", ",")))
    last = lambda p: F.element_at(p, -1)
    head = lambda p, n: F.slice(p, F.lit(1), F.size(p) - n)
    several = F.size("__parts") > 1
    x = x.withColumn("__special", F.when(several & last("__parts").isin("references", "namespaces"), last("__parts")))
    x = x.withColumn("__left", head(c("__parts"), F.when(c("__special").isNull(), 0).otherwise(1)))
    x = x.withColumn("__place", F.when(several & last("__left").rlike(r"^(?:[0-9]+|[0-9a-f]{16})$"), last("__left")))
    file = decode(F.array_join(head(c("__left"), F.when(c("__place").isNull(), 0).otherwise(1)), ","))
    x = x.withColumn("__file", F.regexp_replace(F.regexp_replace(file, "^/", ""), "/$", ""))
    x = x.withColumn("__top", F.substring_index("__file", "/", 1)).withColumn("__deep", c("__file").contains("/"))
    shown = is_file(c("__file"))
    page = F.concat(F.lit("/"), "__file", F.when(ends_with(c("__file"), ".html"), "").otherwise(".html"), F.coalesce(F.concat(F.lit("#"), safe_line(c("__place"))), F.lit("")))
    overview = F.concat(F.lit("/"), "__top", F.lit("/ProjectExplorer.html"))
    references = F.concat(F.lit("/"), "__top", F.lit("/R/"), F.coalesce("__place", F.lit("")), F.lit(".html"))
    beside = F.when(c("__deep"), F.when(c("__special") == "references", references).when(~c("__top").isin(*LOOSE), overview))
    whole = c("__special").isNull() & c("__place").isNull()
    bare = F.when(~c("__deep") & whole, overview).when(~c("__deep") & (c("__special") == "namespaces"), F.concat(F.lit("/"), "__top", F.lit("/namespaces.html")))
    free = c("__listed").isNull() & c("__asked").isNull()
    out = x.withColumns({
        "content": F.when(free & shown, page),
        "navigation": F.coalesce("__listed", F.when(free, F.when(shown, beside).otherwise(bare))),
        "search": c("__asked"),
    })
    return out.drop(*(n for n in out.columns if n.startswith("__")))
