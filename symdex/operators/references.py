"""The reference fact table: grouping, counting, headers, occurrences, and facts about declarations.

References: kind, to_id, from_assembly, file, line, col_start, col_end, and line_text and to_name where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reference kinds in the order of their numbers, with the header of their list.
KINDS = (
    ("DerivedType", "{0} type{1} derived from {2}"),
    ("InterfaceInheritance", "{0} interface{1} inheriting from {2}"),
    ("InterfaceImplementation", "{0} implementation{1} of {2}"),
    ("Override", "{0} override{1} of {2}"),
    ("InterfaceMemberImplementation", "{0} implementation{1} of {2}"),
    ("Instantiation", "{0} instantiation{1} of {2}"),
    ("Write", "{0} write{1} to {2}"),
    ("Read", "{0} read{1} of {2}"),
    ("Reference", "{0} reference{1} to {2}"),
    ("GuidUsage", "{0} usage{1} of Guid {2}"),
    ("EmptyArrayAllocation", "{0} allocation{1} of empty arrays"),
    ("MSBuildPropertyAssignment", "{0} assignment{1} to MSBuild property {2}"),
    ("MSBuildPropertyUsage", "{0} usage{1} of MSBuild property {2}"),
    ("MSBuildItemAssignment", "{0} assignment{1} to MSBuild item {2}"),
    ("MSBuildItemUsage", "{0} usage{1} of MSBuild item {2}"),
    ("MSBuildTargetDeclaration", "{0} declaration{1} of MSBuild target {2}"),
    ("MSBuildTargetUsage", "{0} usage{1} of MSBuild target {2}"),
    ("MSBuildTaskDeclaration", "{0} import{1} of MSBuild task {2}"),
    ("MSBuildTaskUsage", "{0} call{1} to MSBuild task {2}"),
)
# Names that don't name a symbol.
UNNAMED = ("this", "base", "var", "UsingTask", "[")


def group_references(refs: DataFrame) -> DataFrame:
    """One row per (to_id, kind, assembly, file, line) with its occurrences as sorted (start, end)."""
    spans = F.array_sort(F.collect_list(F.struct("col_start", "col_end")))
    return refs.groupBy("to_id", "kind", "from_assembly", "file", "line").agg(F.count("*").alias("n"), spans.alias("spans"))


def count_references(refs: DataFrame) -> DataFrame:
    """Counts by kind, by kind and assembly, and by kind, assembly and file; level is 2, 1 and 0 for these."""
    return refs.rollup("kind", "from_assembly", "file").agg(F.grouping_id().alias("g"), F.count("*").alias("n")).where("g < 7").withColumn("level", F.when(F.col("g") == 3, 2).when(F.col("g") == 1, 1).otherwise(0)).drop("g")


def header(kind: Column, n: Column, name: Column) -> Column:
    """Text above the references of a kind."""
    template = F.get(F.array(*(F.lit(t) for _, t in KINDS)), kind)
    out = F.replace(template, F.lit("{0}"), n.cast("string"))
    out = F.replace(out, F.lit("{1}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
    return F.replace(out, F.lit("{2}"), F.coalesce(name, F.lit("")))


def referenced_name(refs: DataFrame) -> DataFrame:
    """(to_id, name): the first target name that names a symbol."""
    return refs.where(~F.col("to_name").isin(*UNNAMED)).groupBy("to_id").agg(F.min_by("to_name", "seq").alias("name"))


def merge_occurrences(text: Column, spans: Column) -> Column:
    """A line with each of its sorted, disjoint spans emphasised."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        low, high = F.greatest(s["start"], a["at"]), F.least(s["end"], F.length(text))
        cut = lambda x, y: F.substring(text, x + 1, F.greatest(y - x, F.lit(0)))
        grown = F.struct(high.alias("at"), F.concat(a["out"], cut(a["at"], low), F.lit("<i>"), cut(low, high), F.lit("</i>")).alias("out"))
        return F.when(high > low, grown).otherwise(a)

    return F.aggregate(F.array_sort(spans), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def unreferenced(declarations: DataFrame, refs: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Declarations with a place that nothing refers to; members of ``kept`` (ids with base or interface links) are referenced."""
    used = refs.select("to_id")
    if kept is not None:
        used = used.unionByName(kept.select(F.col("id").alias("to_id")))
    return declarations.where("offset <> 0").join(used.distinct(), F.col("id") == F.col("to_id"), "left_anti")


def base_members(members: DataFrame, declarations: DataFrame) -> DataFrame:
    """Base members with their names where they are declared; unresolved ones stay."""
    d = declarations.select(F.col("assembly").alias("base_assembly"), F.col("id").alias("base_id"), F.col("name").alias("base_name"))
    return members.join(d, ["base_assembly", "base_id"], "left")


def declared(symbols: DataFrame) -> DataFrame:
    """Symbols for the list: no locals, parameters, type parameters or constructors; the first of an id wins."""
    own = symbols.where(~F.col("kind").isin("Local", "Parameter", "TypeParameter") & ~F.col("name").isin(".ctor", ".cctor"))
    return own.groupBy("assembly", "id").agg(F.min_by("name", "seq").alias("name"))


def declaration_map(locations: DataFrame) -> DataFrame:
    """(id, place, file, offset): the places of each id in order, one row each."""
    from .numbering import within

    return within(locations.select("id", "file", "offset"), ["id"], ["file", "offset"], "place").select("id", "place", "file", "offset")


def partial_types(locations: DataFrame) -> DataFrame:
    """Locations of ids that have several, numbered by path; the first one is the anchor."""
    from .numbering import within

    placed = within(locations, ["id"], ["file", "offset"], "place", "last")
    return placed.where("place > 1 or not last").withColumn("anchor", F.col("place") == 1).drop("last")


def redirect_map(locations: DataFrame) -> DataFrame:
    """(id, bucket, short, target): first character, next seven, and the file's number or the page of a partial type."""
    files = numbered(locations.select("file").distinct(), ["file"]).withColumnRenamed("n", "file_index")
    n = locations.groupBy("id").agg(F.count("*").alias("k"), F.min("file").alias("file")).join(files, "file")
    target = F.when(F.col("k") == 1, F.col("file_index").cast("string")).otherwise(F.concat(F.lit("P/"), "id"))
    return n.select("id", F.substring("id", 1, 1).alias("bucket"), F.substring("id", 2, 7).alias("short"), target.alias("target"))


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Dense numbers from 0 in a total order, without bringing all rows together.

    Rows are sorted by ranges; each range is numbered by itself, and the ranges' sizes, of which there are as many as shuffle
    partitions, give the offsets.
    """
    from symdex.operators.numbering import dense

    return dense(df, order, name)


def line_annotations(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """(file, line, glyphs): distinct notes of every line up to the last, joined in order."""
    found = notes.groupBy("file", "line").agg(F.array_join(F.array_sort(F.collect_set("glyph")), "").alias("glyphs"))
    every = lines.groupBy("file").agg(F.max("line").alias("last")).select("file", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("line"))
    return every.join(found, ["file", "line"], "left").withColumn("glyphs", F.coalesce("glyphs", F.lit("")))


def blame(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """Lines that a hunk starts at (its start is the line before), with the first such hunk."""
    h = hunks.select("file", (F.col("hunk_start") + 1).alias("line"), "author", "seq")
    first = h.groupBy("file", "line").agg(F.min_by("author", "seq").alias("author"))
    return lines.join(first, ["file", "line"])


def git_blame(hunks: DataFrame) -> DataFrame:
    """(file, line, note, within): author and address of every line of the hunks, and its place in its hunk.

    hunks: file, first (the first line), more (lines after it), author, mail.  Lines count from 1; where hunks overlap, the one that starts last
    holds, and of these the greatest author and address.
    """
    each = hunks.select("file", F.explode(F.expr("sequence(first, first + more)")).alias("line"), F.struct("first", "author", "mail").alias("x"))
    best = each.where("line > 0").groupBy("file", "line").agg(F.max("x").alias("x"))
    return best.select("file", "line", F.concat("x.author", F.lit(" <"), "x.mail", F.lit(">")).alias("note"), (F.col("line") - F.col("x.first")).alias("within"))


def reference_kind(base_list: Column, target_interface: Column, source_interface: Column, written: Column, kind: Column) -> Column:
    """Kind number of a reference from facts about its place."""
    base = F.when(~target_interface, F.lit(0)).when(source_interface, F.lit(1)).otherwise(F.lit(2))
    return F.when(written, F.lit(6)).when(base_list, base).otherwise(kind)


def constructor_references(refs: DataFrame) -> DataFrame:
    """Each use of a constructor also as an instantiation of its type."""
    is_ctor = F.col("to_name") == ".ctor"
    pair = F.array(F.struct("to_id", "kind"), F.struct(F.col("type_id").alias("to_id"), F.lit(5).alias("kind")))
    one = F.array(F.struct("to_id", "kind"))
    return refs.withColumn("x", F.explode(F.when(is_ctor, pair).otherwise(one))).select("seq", "x.to_id", "x.kind")


def hyperlink_target(link: DataFrame) -> DataFrame:
    """target of (from_assembly, to_assembly, id, file, locations, in_solution, server): file, page, other assembly or server; null for none."""
    c = F.col
    own = F.when(c("locations") > 1, F.concat(F.lit("P/"), "id")).otherwise(F.concat("file", F.lit(".html#"), "id"))
    other = F.concat(F.lit("/"), "to_assembly", F.lit("/A.html#"), "id")
    far = F.concat(F.lit("@"), c("server").cast("string"), F.lit("@"), "to_assembly", F.lit("/A.html#"), "id")
    return link.withColumn("target", F.when(c("from_assembly") == c("to_assembly"), own).when(c("in_solution"), other).when(c("server") >= 0, far))


def external_filter(links: DataFrame) -> DataFrame:
    """References to symbols of other servers aren't recorded."""
    return links.where(F.coalesce(F.col("server"), F.lit(-1)) == -1)
