"""Intervals over texts: gaps, cuts, overlaps, islands and classes.

Spans: doc, seq (input order), start, length, class, and semantic where two analyses are combined.  Every operator
works within a document; no range join is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes that carry no mark, and the class that each other one maps to.
IGNORED = ("operator", "operator - overloaded", "number", "punctuation", "preprocessor text", "xml literal - text")
IDENTIFIERS = (
    "identifier", "field name", "enum member name", "constant name", "local name", "parameter name", "method name", "extension method name", "property name",
    "event name", "namespace name", "label name",
)
TYPE_NAMES = (
    "class name", "struct name", "interface name", "enum name", "delegate name", "record name", "record class name", "record struct name", "module name",
    "type parameter name",
)
COMMENTS = (
    "xml doc comment - delimiter", "xml doc comment - name", "xml doc comment - text", "xml doc comment - comment", "xml doc comment - entity reference",
    "xml doc comment - attribute name", "xml doc comment - attribute quotes", "xml doc comment - attribute value", "xml doc comment - cdata section",
    "xml literal - comment", "comment",
)
XML_LITERALS = {
    "xml literal - delimiter": "xld",
    "xml literal - name": "xln",
    "xml literal - attribute name": "xlan",
    "xml literal - attribute quotes": "xlaq",
    "xml literal - attribute value": "xlav",
    "xml literal - entity reference": "xler",
    "xml literal - cdata section": "xlcs",
    "xml literal - processing instruction": "xlpi",
    "xml literal - embedded expression": "xlee",
}
MARKS = (
    {"keyword": "k", "keyword - control": "k", "preprocessor keyword": "prep", "string": "s", "string - verbatim": "s", "excluded code": "e"}
    | dict.fromkeys(IDENTIFIERS, "i")
    | dict.fromkeys(TYPE_NAMES, "t")
    | dict.fromkeys(COMMENTS, "c")
    | XML_LITERALS
)
UNKNOWN = "unknownClassification"
# How a span's class is taken, by the class and for words that may stand for a symbol; and the class that a symbol's kind adds.
WORDS_FOR_SYMBOLS = ("this", "base", "var", "New", "new", "[", "partial", "Partial")
CLASS_RULES = (("punctuation", "none", "none"), ("s", "own", "own"), (UNKNOWN, "own", "own"), ("k", "own", "own"), ("i", "symbol", "symbol"), ("t", "symbol", "symbol"))
KIND_CLASSES = {"Namespace": "n", "Field": "field", "Property": "property", "Method": "method", "Constructor": "constructor", "Alias": "t", "NamedType": "t"}
# Keywords that stay apart.
APART = ("this", "base", "var", "New", "new", "Partial", "partial")


def map_class(spans: DataFrame) -> DataFrame:
    """Marks for classes; spans without a mark go, unknown classes get one of their own."""
    from symdex.functions.symbols import pick

    c = F.col("class")
    kept = spans.where(c.isNotNull() & ~c.isin(*IGNORED))
    return kept.withColumn("class", F.when(c == "k", c).otherwise(pick(c, MARKS, UNKNOWN)))


def filter_class(spans: DataFrame) -> DataFrame:
    c = F.col("class")
    return spans.where(~c.isin("static symbol", "string - escape character") & ~c.startswith("regex"))


def fill_gaps(spans: DataFrame, documents: DataFrame, *kept: str) -> DataFrame:
    """(doc, start, length, class) with a span of no class for every part between spans and before the end; further columns of spans are kept, null in gaps.

    A gap lies after the end of the span before, not after the furthest end; overlaps leave none.  A document's end goes along as its last
    row, so all is done in one pass over the spans of a document.
    """
    c = F.col
    none = [F.lit(None).cast(spans.schema[k].dataType).alias(k) for k in kept]
    marks = documents.select("doc", c("n").alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("ends"), *none)
    own = spans.select("doc", "start", "length", "class", "seq", F.lit(False).alias("ends"), *kept).unionByName(marks)
    last = F.lag(c("start") + c("length"), 1, 0).over(Window.partitionBy("doc").orderBy("ends", "start", "seq"))
    part = lambda start, length, kind, more: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), kind.alias("class"), *more)
    gap = F.when(c("start") > c("last"), part(c("last"), c("start") - c("last"), F.lit(None).cast("string"), none))
    both = F.array(F.when(~c("ends"), part(c("start"), c("length"), c("class"), map(c, kept))), gap)
    return own.withColumn("last", last).select("doc", F.explode(both).alias("x")).where("x is not null").select("doc", "x.*")


def with_lines(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans with the line that each starts in: line (its number from 0, as ``text.line_number`` counts), line_start and line_length (as ``text.line_from_position``).

    documents: doc, text; spans of documents without a text go.  Lines go along as rows before the spans that start in them, so lines and spans of a
    document take one pass each.
    """
    c = F.col
    pieces = F.split("text", r"(?<=[\r\n])", -1)  # each with what ends it
    closed = lambda x: F.when(x.endswith("\n") | x.endswith("\r"), 1).otherwise(0)
    counts = lambda x, i, all_: F.when(x.endswith("\n") | (x.endswith("\r") & (F.get(all_, i + 1) == "\r")), 1).otherwise(0)
    of = F.transform(F.array(pieces), lambda a: F.transform(a, lambda x, i: F.struct(F.length(x).cast("long").alias("n"), closed(x).alias("closed"), counts(x, i, a).alias("counts"))))
    before = Window.partitionBy("doc").orderBy("i")
    lines = documents.select("doc", F.posexplode_outer(F.get(of, F.lit(0))).alias("i", "x")).select("doc", "i", "x.*")
    place = F.struct((F.sum("counts").over(before) - c("counts")).alias("line"), (F.sum("n").over(before) - c("n")).alias("line_start"), (c("n") - c("closed")).alias("line_length"))
    lines = lines.select("doc", F.when(c("i").isNotNull(), place).alias("place"))
    names = [k for k in spans.columns if k != "doc"]
    own = spans.withColumns({"start": c("start").cast("long"), "place": F.lit(None).cast(lines.schema["place"].dataType)})
    both = own.unionByName(lines.withColumn("start", c("place.line_start")), allowMissingColumns=True)
    held = F.last("place", ignorenulls=True).over(Window.partitionBy("doc").orderBy("start", c("place").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held", held).where(c("place").isNull() & c("held").isNotNull()).select("doc", *names, "held.*")


def drop_repeats(spans: DataFrame) -> DataFrame:
    """Spans other than the one before them in order."""
    w = Window.partitionBy("doc").orderBy("start", "seq")
    before = F.lag(F.struct("start", "length")).over(w)
    return spans.withColumn("b", before).where(F.col("b").isNull() | (F.col("b.start") != F.col("start")) | (F.col("b.length") != F.col("length"))).drop("b")


def fill_gaps_dedup(spans: DataFrame, documents: DataFrame) -> DataFrame:
    return fill_gaps(drop_repeats(spans), documents)


def concat_ranges(syntactic: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both analyses, each marked."""
    return syntactic.withColumn("semantic", F.lit(False)).unionByName(semantic.withColumn("semantic", F.lit(True)))


def distinct_points(spans: DataFrame) -> DataFrame:
    """Distinct starts and ends of a document's spans."""
    return spans.select("doc", F.explode(F.array(F.col("start"), F.col("start") + F.col("length"))).alias("point")).distinct()


def split_intervals(spans: DataFrame) -> DataFrame:
    """Each span cut at every start or end of others that falls inside it; pieces that were cut are no longer semantic.

    seq names a span within its document.  Points are numbered within a document.  A span learns the numbers of its start and end, and the numbers
    from one to the other are its points; it knows the places of the outer ones, and each inner one is an outer one of another span.  So the work
    grows with the pieces, and spans that are dealt by document are neither shuffled nor joined.
    """
    c = F.col
    by_point = Window.partitionBy("doc").orderBy("point")
    each = spans.select("doc", "seq", "class", "semantic", F.explode(F.array(c("start").cast("long"), (c("start") + c("length")).cast("long"))).alias("point"))
    ranked = each.withColumn("i", F.dense_rank().over(by_point))
    ends = [f(k).alias(name) for k, names in (("i", ("first", "last")), ("point", ("start", "end"))) for f, name in zip((F.min, F.max), names, strict=True)]
    numbered = ranked.groupBy("doc", "seq", "class", "semantic").agg(*ends)
    points = numbered.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("known", F.when(c("i") == c("first"), c("start")).when(c("i") == c("last"), c("end")))
    by_number = Window.partitionBy("doc").orderBy("i")
    pieces = points.withColumns({"point": F.max("known").over(by_number.rangeBetween(0, 0)), "next": F.max("known").over(by_number.rangeBetween(1, 1))}).where("i < last")
    length, whole = c("next") - c("point"), c("last") - c("first") == 1
    return pieces.select("doc", "seq", (c("i") - c("first")).alias("piece"), c("point").alias("start"), length.alias("length"), "class", (c("semantic") & whole).alias("semantic"))


def _better(a: Column, b: Column) -> Column:
    """Which of two spans with one start stays: syntax against semantics, then comments against others."""
    kind = lambda keep, other: F.when((keep["class"] == "text") & other["class"].isNotNull(), other["class"]).otherwise(keep["class"])
    merged = lambda keep, sem: F.struct(keep["order"].alias("order"), keep["length"].alias("length"), sem["class"].alias("class"), keep["semantic"].alias("semantic"))
    plain = lambda keep, other: F.struct(keep["order"].alias("order"), keep["length"].alias("length"), kind(keep, other).alias("class"), keep["semantic"].alias("semantic"))
    comment = lambda x: x["class"] == "comment"
    by_class = F.when(comment(b), plain(a, b)).otherwise(plain(b, a))
    return F.when(a["semantic"] & ~b["semantic"], merged(b, a)).when(b["semantic"] & ~a["semantic"], merged(a, b)).otherwise(by_class)


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """One span for each start, folded over those that share it in input order."""
    item = F.struct(F.struct("seq", F.coalesce("piece", F.lit(0)).alias("piece")).alias("order"), F.col("length").cast("int").alias("length"), "class", "semantic")
    runs = spans.groupBy("doc", "start").agg(F.array_sort(F.collect_list(item)).alias("run"))
    best = F.aggregate(F.slice("run", 2, 1 << 30), F.get("run", F.lit(0)), _better)
    return runs.withColumn("b", best).select("doc", F.col("b.order.seq").alias("seq"), "start", F.col("b.length").alias("length"), F.col("b.class").alias("class"))


def prepare_ranges(syntactic: DataFrame, semantic: DataFrame, documents: DataFrame) -> DataFrame:
    """Both analyses of a text as one list of spans without overlaps or gaps."""
    both = concat_ranges(syntactic, semantic.withColumn("seq", F.col("seq") + (1 << 30))).where("length > 0")
    return fill_gaps(resolve_overlaps(split_intervals(both)), documents)


def merge_islands(spans: DataFrame) -> DataFrame:
    """Neighbouring keywords become one span from the first start to the last end."""
    w = Window.partitionBy("doc").orderBy("start", "seq")
    merges = (F.col("class") == "keyword") & ~F.col("text").isin(*APART)
    new = ~(F.col("m") & F.coalesce(F.lag("m").over(w), F.lit(False)))
    s = spans.withColumn("m", merges).withColumn("new", F.when(new, 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    out = s.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max_by(F.col("start") + F.col("length"), F.struct("start", "seq")).alias("end"), F.min_by("class", F.struct("start", "seq")).alias("class"))
    return out.select("doc", "start", (F.col("end") - F.col("start")).alias("length"), "class")


def local_ids(occurrences: DataFrame) -> DataFrame:
    """(doc, symbol, local_id): numbers in order of first appearance."""
    first = occurrences.groupBy("doc", "symbol").agg(F.min("position").alias("position"))
    return first.withColumn("local_id", F.row_number().over(Window.partitionBy("doc").orderBy("position")) - 1).drop("position")


def highlight_class(locals_: DataFrame) -> DataFrame:
    return locals_.withColumn("css", F.format_string("r%d r", F.col("local_id")))


def css_classes(spans: DataFrame) -> DataFrame:
    """spans with ``css``: the class of each, and behind it that of the symbol it stands for.

    spans: class, text, kind (of the symbol, null for none) and more.  Which spans stand for symbols is a relation by class (``CLASS_RULES``, by default
    a class holds but for a few words), what a symbol adds is one by kind; both are joined.  Spans without a class, and punctuation, have none.
    """
    c, spark = F.col, spans.sparkSession
    rules = spark.createDataFrame([*CLASS_RULES], "__class string, __plain string, __word string")
    kinds = spark.createDataFrame([*KIND_CLASSES.items()], "__kind string, __adds string")
    out = spans.join(F.broadcast(rules), c("class") == c("__class"), "left").join(F.broadcast(kinds), c("kind") == c("__kind"), "left")
    rule = F.when(c("text").isin(*WORDS_FOR_SYMBOLS), F.coalesce("__word", F.lit("symbol"))).otherwise(F.coalesce("__plain", F.lit("own")))
    own = F.when((c("text") == "this") & (c("kind") == "Parameter"), "own").otherwise(rule)
    css = F.when(c("class").isNull() | (rule == "none"), None).when(own == "symbol", F.concat_ws(" ", F.nullif("class", F.lit("")), "__adds")).otherwise(c("class"))
    return out.withColumn("css", css).drop("__class", "__plain", "__word", "__kind", "__adds")


def html_chunks(pieces: DataFrame, documents: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(doc, chunk, html): pages of texts with their spans marked, in chunks of ``chunk`` letters of text, so that no page is ever one value.

    pieces: doc, start, length, class, without gaps or overlaps; documents: doc, text.  A span that goes on in the next chunk is opened in its first and closed
    in its last, so the chunks of a text, one after the other, are its page.  An empty text has no chunk.
    """
    from symdex.functions.text import html_escape

    c = F.col
    last = F.greatest(F.floor((F.length("text") - 1) / chunk), F.lit(0))
    own = pieces.where("length > 0").withColumn("end", c("start") + c("length"))
    own = own.withColumn("chunk", F.explode(F.sequence(F.floor(c("start") / chunk), F.floor((c("end") - 1) / chunk))))
    low, high = F.greatest("start", c("chunk") * chunk), F.least("end", (c("chunk") + 1) * chunk)
    part = F.struct((low - c("chunk") * chunk).cast("int").alias("at"), (high - low).cast("int").alias("n"), "class", (low == c("start")).alias("opens"), (high == c("end")).alias("closes"))
    # a chunk's pieces are one row before they meet their text, and documents stay where they are dealt
    listed = own.select("doc", "chunk", part.alias("part")).groupBy("doc", "chunk").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    body = F.substring(c("text"), (c("chunk") * chunk + 1).cast("int"), F.lit(chunk))

    def marked(x: Column, when: str, mark: Column | str) -> Column:
        return F.when(x["class"].isNotNull() & x[when], mark).otherwise("")

    def page(body: Column) -> Column:
        one = lambda x: F.concat(marked(x, "opens", F.concat(F.lit('<span class="'), x["class"], F.lit('">'))), html_escape(F.substring(body, x["at"] + 1, x["n"])), marked(x, "closes", F.lit("</span>")))
        return F.array_join(F.transform("parts", one), "")

    return listed.join(documents.select("doc", "text").hint("merge"), "doc").where(c("chunk") <= last).select("doc", "chunk", F.get(F.transform(F.array(body), page), F.lit(0)).alias("html"))
