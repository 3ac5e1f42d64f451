"""Facts of build files, scripts, XML and declarations as reference rows.

Parsers and compilers stay outside, but for the marks of XML; their nodes, ranges and declarations are the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions import expressions
from symdex.functions.ids import symbol_id
from symdex.functions.symbols import SCRIPT_GLYPHS, pick
from symdex.functions.text import escape_semicolons, html_escape, html_escape_offsets, split_semicolons, strip_quotes_loose

# Numbers of reference kinds.
OVERRIDE, IMPLEMENTATION, INSTANTIATION, REFERENCE, EMPTY_ARRAY = 3, 4, 5, 8, 10
PROPERTY, PROPERTY_USE, ITEM, ITEM_USE, TARGET, TARGET_USE, TASK, TASK_USE = 11, 12, 13, 14, 15, 16, 17, 18
# Items that aren't recorded, characters that no plain name has, attributes that list targets, and the lists' assemblies.
UNLISTED = ("Compile", "Reference")
COMPLEX = r"[$:\[\]]"
TARGET_LISTS = ("DependsOnTargets", "BeforeTargets", "AfterTargets")
ASSEMBLIES = {11: "MSBuildProperties", 12: "MSBuildProperties", 13: "MSBuildItems", 14: "MSBuildItems", 15: "MSBuildTargets", 16: "MSBuildTargets", 17: "MSBuildTasks", 18: "MSBuildTasks"}
# Marks of XML and script classes.
XML_MARKS = {
    "XmlAttributeName": "xan", "XmlAttributeValue": "xav", "XmlCDataSection": "xcs", "XmlComment": "c", "XmlDelimiter": "xd", "XmlEntityReference": "xer",
    "XmlName": "xn", "XmlProcessingInstruction": "xpi",
}
SCRIPT_MARKS = {
    "keyword": "k", "comment": "c", "string": "s", "class name": "t", "enum name": "t", "interface name": "t", "type alias name": "t",
    "type parameter name": "t", "module name": "t",
}
#: Characters of an XML file beyond which it isn't classified.
LARGE_XML = 1_000_000
#: Letters of the blocks that its text is cut into.
BLOCK = 64
# What a text is cut into (comments, character data and instructions go on to their end; tags, with ">" in quotes or, where quotes stay open, without;
# references; text), and what is in a tag behind its name (= and a value, a value, white space, a name).
_ENTITY = "&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z_:][A-Za-z0-9._:-]*);"
_OPENS = r"<(?:/?(?:[A-Za-z_:]|[^\x00-\x7F])|!)"
XML_TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)"
    rf"""|{_OPENS}(?:[^<>"']++|"[^<"]*+"|'[^<']*+')*+>|{_OPENS}[^<>]*+>|{_ENTITY}|[^<&]++|[<&]"""
)
XML_IN_TAG = r"""=[ \t\r\n]*+(?:"[^"]*+"?|'[^']*+'?|[^ \t\r\n"'=]++)?|"[^"]*+"?|'[^']*+'?|[ \t\r\n]++|[^ \t\r\n"'=]++"""
XML_VALUE = rf"{_ENTITY}|(?:[^&]++|&(?!{_ENTITY[1:]}))++"


def build_references(nodes: DataFrame) -> DataFrame:
    """(file, line, kind, name, to_assembly) of properties, items, targets and tasks in build files (``buildfiles.NODES``).

    Properties inside assembly names aren't expanded, as that takes an evaluated project.
    """
    c = F.col
    e, p, a, v = c("element"), c("parent"), c("attribute"), c("value")
    number, none = lambda n: F.lit(n), F.lit(None).cast("string")
    attribute = lambda name: F.try_element_at(c("attributes"), F.lit(name))
    has = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    row = lambda kind, name, assembly=none: F.struct(kind.alias("kind"), name.alias("name"), assembly.alias("assembly"))

    task = attribute("TaskName")
    declares = F.when((e == "UsingTask") & task.isNotNull(), number(TASK)).when(p == "PropertyGroup", number(PROPERTY)).when((p == "ItemGroup") & ~e.isin(*UNLISTED), number(ITEM))
    declares = declares.when((p == "Target") & ~e.isin("ItemGroup", "PropertyGroup"), number(TASK_USE))
    element = row(declares, F.when(declares == TASK, F.substring_index(task, ".", -1)).otherwise(e))

    path, given = attribute("AssemblyFile"), attribute("AssemblyName")
    assembly = F.when(has(path), F.regexp_extract(path, r"([^\\/]*?)(?:\.[^.\\/]*)?$", 1)).when(has(given), F.substring_index(given, ",", 1))
    plain = ~v.contains("%")
    direct = F.when((e == "Output") & (a == "ItemName") & plain, number(ITEM)).when((e == "Output") & (a == "PropertyName") & plain, number(PROPERTY)).when((e == "Target") & (a == "Name"), number(TARGET))
    direct = F.when(c("kind") == "attribute", direct.when((e == "UsingTask") & (a == "TaskName") & assembly.isNotNull(), number(INSTANTIATION)))
    named = row(direct, F.when(direct == INSTANTIATION, symbol_id(F.concat(F.lit("T:"), v))).otherwise(v), F.when(direct == INSTANTIATION, assembly))

    listed = ((e == "Target") & a.isin(*TARGET_LISTS)) | ((e == "CallTarget") & (a == "Targets")) | ((c("kind") == "text") & e.endswith("DependsOn") & (p == "PropertyGroup"))

    def of_piece(x: Column) -> Column:
        n = F.length(x)
        inner = F.substring(x, F.lit(3), n - 3)
        is_property = x.startswith("$(") & x.endswith(")") & (n > 3)
        is_item = x.startswith("@(") & x.rlike(r"[),-]\z") & ~x.contains("%") & (n > 3)
        targets = F.transform(F.filter(split_semicolons(x), lambda t: t != ";"), lambda t: row(number(TARGET_USE), t))
        uses = F.when(is_property, F.array(row(number(PROPERTY_USE), F.substring_index(inner, ".", 1)))).when(is_item, F.array(row(number(ITEM_USE), inner)))
        return F.coalesce(uses, F.when(F.coalesce(listed, F.lit(False)), targets), F.array().cast("array<struct<kind: int, name: string, assembly: string>>"))

    # every node is parsed and looked at once
    cut = nodes.withColumn("pieces", expressions.split_expressions(F.when((c("kind") != "element") & direct.isNull(), v)))
    refs = F.when(c("kind") == "element", F.array(element)).when(direct.isNotNull(), F.array(named)).otherwise(F.flatten(F.transform("pieces", of_piece)))
    every = cut.select("file", "line", F.explode(refs).alias("r")).select("file", "line", "r.kind", F.regexp_replace("r.name", r"^\s+|\s+$", "").alias("name"), "r.assembly")
    simple = ~c("name").rlike(COMPLEX) | ~c("kind").isin(PROPERTY, PROPERTY_USE, ITEM, ITEM_USE)
    return every.where(c("kind").isNotNull() & (c("name") != "") & simple).select("file", "line", "kind", "name", F.coalesce("assembly", pick(c("kind"), ASSEMBLIES, None)).alias("to_assembly"))


def _local(kind: Column) -> Column:
    return F.coalesce(kind.isin("variable", "parameter"), F.lit(False))


def script_declarations(ranges: DataFrame) -> DataFrame:
    """(file, seq, name, id, kind, description, glyph) of symbols that scripts declare; variables and parameters stay in their file.

    ranges: file, seq, definition_id, definition_kind, search_string, full_name, hyperlinks (symbol_id, ...), text, line_number, column, line_text.
    Names have more than two characters and neither semicolon nor line break.
    """
    c = F.col
    name = strip_quotes_loose(c("search_string"))
    own = ranges.where((F.coalesce("definition_id", F.lit("")) != "") & ~_local(c("definition_kind")) & (F.length("search_string") > 2)).withColumn("name", name)
    own = own.where((F.length("name") > 2) & ~c("name").contains(";") & ~c("name").contains("\n"))
    return own.select("file", "seq", "name", symbol_id(c("definition_id")).alias("id"), c("definition_kind").alias("kind"), escape_semicolons(c("full_name")).alias("description"), pick(c("definition_kind"), SCRIPT_GLYPHS, 195).alias("glyph"))


def script_references(ranges: DataFrame) -> DataFrame:
    """(file, seq, to_symbol, to_name, line, line_text, col_start, col_end) of the first link of each range.

    Links to symbols that the file has met as a variable or parameter before are left out.
    """
    c = F.col
    link = F.get("hyperlinks", F.lit(0))["symbol_id"]
    target = F.when(F.coalesce("definition_id", F.lit("")) != "", c("definition_id")).otherwise(link)
    local = ranges.where(_local(c("definition_kind"))).select("file", "seq", symbol_id(target).alias("id")).where("id is not null").groupBy("file", "id").agg(F.min("seq").alias("since"))
    linked = ranges.where(~_local(c("definition_kind")) & (F.size("hyperlinks") > 0)).withColumn("to_symbol", symbol_id(link))
    kept = linked.join(local.withColumnsRenamed({"file": "f", "id": "i"}), (c("file") == c("f")) & (c("to_symbol") == c("i")) & (c("since") <= c("seq")), "left_anti")
    place = html_escape_offsets(c("line_text"), c("column"), c("column") + F.length("text"))
    out = kept.withColumn("x", place)
    return out.select("file", "seq", "to_symbol", c("text").alias("to_name"), (c("line_number") + 1).alias("line"), c("x.html").alias("line_text"), c("x.new_start").alias("col_start"), c("x.new_end").alias("col_end"))


def xml_class(kind: Column) -> Column:
    """Mark of an XML class, null for none."""
    return pick(kind, XML_MARKS, None)


def script_class(kind: Column) -> Column:
    return pick(kind, SCRIPT_MARKS, None)


def _in_tag(x: Column) -> Column:
    """What a piece of a tag behind its name consists of, as (n, class)."""
    at = lambda n, kind: F.struct(n.cast("int").alias("n"), F.lit(kind).cast("string").alias("class"))
    parts = lambda v: F.transform(F.regexp_extract_all(v, F.lit(XML_VALUE), F.lit(0)), lambda y: F.when(y.rlike(rf"\A{_ENTITY}\z"), at(F.length(y), "XmlEntityReference")).otherwise(at(F.length(y), "XmlAttributeValue")))

    def value(lead: Column, v: Column) -> Column:
        n, quoted = F.length(v), v.startswith('"') | v.startswith("'")
        shut = quoted & (n > 1) & (F.substring(v, F.lit(1), F.lit(1)) == F.right(v, F.lit(1)))
        first, last = F.when(quoted, 1).otherwise(0), F.when(shut, 1).otherwise(0)
        inner = F.substring(v, first + 1, n - first - last)
        return F.concat(lead, F.array(at(first, "XmlAttributeQuotes")), parts(inner), F.array(at(last, "XmlAttributeQuotes")))

    given = F.ltrim(F.substring(x, F.lit(2), F.length(x)), F.lit(" \t\r\n"))
    assigned = value(F.array(at(F.lit(1), "XmlDelimiter"), at(F.length(x) - 1 - F.length(given), None)), given)
    plain = F.array(F.when(x.rlike(r"\A[ \t\r\n]"), at(F.length(x), None)).otherwise(at(F.length(x), "XmlAttributeName")))
    nothing = F.array().cast("array<struct<n: int, class: string>>")
    return F.when(x.startswith("="), assigned).when(x.rlike("""\\A["']"""), value(nothing, x)).otherwise(plain)


def xml_spans(documents: DataFrame) -> DataFrame:
    """(doc, seq, start, length, class): the classified parts of XML texts, without overlaps; text, white space and what can't be read have no class.

    documents: doc, text.  Tags and declarations have delimiters, a name, and names, quotes and values of attributes; comments, character data and instructions
    without an end go on to the end of the text.
    """
    from pyspark.sql import Window

    c, w = F.col, r" \t\r\n"
    t, n = c("token"), F.length("token")
    each = documents.select("doc", F.posexplode_outer(F.regexp_extract_all("text", F.lit(XML_TOKEN), F.lit(0))).alias("i", "token"))
    kind = F.when(t.startswith("<!--"), "XmlComment").when(t.startswith("<![CDATA["), "XmlCDataSection").when(t.rlike(rf"\A<\?xml(?:[{w}]|\?>)"), "declaration").when(t.startswith("<?"), "XmlProcessingInstruction")
    each = each.withColumn("kind", kind.when(t.startswith("<") & (n > 1), "tag").when(t.startswith("&") & (n > 1), "XmlEntityReference"))
    kind, has = c("kind"), lambda *x: c("kind").isin(*x)
    opens = F.when(kind == "XmlComment", 4).when(kind == "XmlCDataSection", 9).when(has("declaration", "XmlProcessingInstruction") | t.startswith("</") | t.startswith("<!"), 2).when(kind == "tag", 1).otherwise(0)
    named = F.when(has("tag", "declaration", "XmlProcessingInstruction"), F.length(F.regexp_extract("token", rf"""\A<[/!?]?([^{w}/<>"'=?]*)""", 1))).otherwise(0)
    shut = F.when(kind == "XmlComment", F.when(t.endswith("-->") & (n >= 7), 3)).when(kind == "XmlCDataSection", F.when(t.endswith("]]>"), 3)).when(has("declaration", "XmlProcessingInstruction"), F.when(t.endswith("?>") & (n >= 4), 2))
    each = each.withColumns({"opens": opens, "named": named, "shut": F.coalesce(shut.when(kind == "tag", F.when(t.endswith("/>") & (n > opens + named + 1), 2).otherwise(1)), F.lit(0))})
    at = lambda size, of: F.struct(size.cast("int").alias("n"), of.cast("string").alias("class"))
    size, delimiter = n - c("opens") - c("named") - c("shut"), F.lit("XmlDelimiter")
    inner = F.flatten(F.transform(F.regexp_extract_all(F.substring("token", c("opens") + c("named") + 1, size), F.lit(XML_IN_TAG), F.lit(0)), _in_tag))
    each = each.withColumn("inner", F.when(has("tag", "declaration") & (size > 0), inner))
    ends = at(c("opens"), delimiter), at(c("named"), F.lit("XmlName")), at(c("shut"), delimiter)
    marked = F.when(kind.isNull(), F.array(at(n, kind))).when(c("inner").isNotNull(), F.concat(F.array(*ends[:2]), "inner", F.array(ends[2]))).otherwise(F.array(*ends[:2], at(size, kind), ends[2]))
    # what is exploded is a column by then, so it is made in one go with the others
    parts = each.withColumn("parts", marked).select("doc", "i", F.posexplode_outer("parts").alias("j", "x")).select("doc", "i", "j", c("x.n").cast("long").alias("length"), "x.class").where("length > 0")
    start = F.sum("length").over(Window.partitionBy("doc").orderBy("i", "j")) - c("length")
    return parts.withColumn("start", start).where("class is not null").select("doc", c("start").alias("seq"), "start", "length", "class")


def xml_ranges(spans: DataFrame, documents: DataFrame, large: int | None = LARGE_XML) -> DataFrame:
    """(doc, start, length, class, line, line_start, line_length): classified spans of XML files with their lines, and the gaps between them, which have neither.

    spans: doc, seq, start, length, class, without overlaps.  documents: doc, text.  A text of more than ``large`` letters has no ranges; None for no such limit.
    A span's column is its start less that of its line.
    """
    from .spans import fill_gaps, with_lines

    text = F.col("text") if large is None else F.when(F.length("text") <= large, F.col("text"))
    own = documents.select("doc", text.alias("text"))
    return fill_gaps(with_lines(spans, own), own.select("doc", F.length("text").alias("n")), "line", "line_start", "line_length")


def xml_marked(ranges: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, html, ranges): the text of each XML file with its ranges marked, and the classified ones as start:length:line:column:line_length:class; a text without
    ranges is escaped as a whole.

    ranges: as ``xml_ranges`` has them.  documents: doc, text.  As a slice of a text counts its characters from the start, a text is cut into ``BLOCK`` letters each
    first, and a range takes its blocks.  A text goes along with its ranges as a row, so neither is joined.
    """
    c = F.col
    block, ends = lambda at: F.floor(at / BLOCK).cast("int"), c("start") + F.greatest("length", F.lit(1)) - 1
    mark, place = xml_class(c("class")), F.concat_ws(":", "start", "length", "line", c("start") - c("line_start"), "line_length", "class")
    of = {
        "start": c("start"), "first": block(c("start")), "last": block(ends), "at": (c("start") % BLOCK + 1).cast("int"), "n": c("length").cast("int"),
        "opens": F.coalesce(F.concat(F.lit('<span class="'), mark, F.lit('">')), F.lit("")), "closes": F.when(mark.isNull(), "").otherwise("</span>"), "place": F.when(c("class").isNotNull(), place),
    }
    rows = ranges.select("doc", F.struct(*(x.alias(k) for k, x in of.items())).alias("range"), F.lit(None).cast("string").alias("text")).unionByName(documents.select("doc", "text"), allowMissingColumns=True)
    # ranges of documents that aren't there go with their null count
    listed = rows.groupBy("doc").agg(F.sort_array(F.collect_list("range")).alias("ranges"), F.max("text").alias("text"), F.count(F.when(c("range").isNull(), 1)).alias("there")).where("there > 0")

    def page(blocks: Column) -> Column:
        def cut(x: Column) -> Column:
            held = F.when(x["first"] == x["last"], F.get(blocks, x["first"])).otherwise(F.array_join(F.slice(blocks, x["first"] + 1, x["last"] - x["first"] + 1), ""))
            return F.concat(x["opens"], F.coalesce(html_escape(F.substring(held, x["at"], x["n"])), F.lit("")), x["closes"])

        return F.array_join(F.transform("ranges", cut), "")

    text = F.coalesce("text", F.lit(""))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    marked = F.get(F.transform(F.array(blocks), page), F.lit(0))
    return listed.select("doc", F.when(F.size("ranges") == 0, html_escape(text)).otherwise(marked).alias("html"), F.array_join("ranges.place", ",").alias("ranges"))


def xml_pages(spans: DataFrame, documents: DataFrame, large: int | None = LARGE_XML) -> DataFrame:
    """(doc, html): the text of each XML file with its classified spans marked; a large one is escaped as a whole.

    spans: doc, seq, start, length, class, without overlaps.  documents: doc, text.  Lines are attached, gaps are filled and pages made, in this order.
    """
    return xml_marked(xml_ranges(spans, documents, large), documents).select("doc", "html")


def with_implicit_constructors(declared: DataFrame) -> DataFrame:
    """(id, file, offset): declarations, and for types with an implicit instance constructor also that one, at offset 0.

    declared: id, file, offset, constructor_id (null for none).
    """
    both = F.array_compact(F.array(F.struct("id", "offset"), F.when(F.col("constructor_id").isNotNull(), F.struct(F.col("constructor_id").alias("id"), F.lit(0).cast("long").alias("offset")))))
    return declared.select("file", F.explode(both).alias("x")).select("x.id", "file", "x.offset")


def member_references(members: DataFrame) -> DataFrame:
    """(member_id, kind, to_assembly, to_id): declared members as references to what they override and implement.

    Only instance methods, properties and events have such.  members: member_id, member_kind, is_static, overridden and implemented,
    arrays of (assembly, id); of the overridden only the first counts.  The rows are base and interface links as well.
    """
    own = members.where(F.col("member_kind").isin("Method", "Property", "Event") & ~F.col("is_static"))
    tagged = lambda x, kind: F.transform(x, lambda m: F.struct(F.lit(kind).alias("kind"), m["assembly"].alias("to_assembly"), m["id"].alias("to_id")))
    empty = F.array().cast("array<struct<assembly: string, id: string>>")
    overridden, implemented = (F.coalesce(name, empty) for name in ("overridden", "implemented"))
    each = F.concat(tagged(F.slice(overridden, 1, 1), OVERRIDE), tagged(implemented, IMPLEMENTATION))
    return own.select("member_id", F.explode(each).alias("x")).select("member_id", "x.*")


def empty_arrays(creations: DataFrame) -> DataFrame:
    """Array creations that make no element, as references to the pseudo symbol of empty arrays.

    creations: file, line, ranks (specifiers of the type), sizes (expressions of the first), size (its constant value, null for none), elements
    (of the initialiser, null without one).  One rank and size; the size is the constant 0, or left out before an empty initialiser.
    """
    c = F.col
    one = (c("ranks") == 1) & (c("sizes") == 1)
    none = (c("size") == 0) | (c("size").isNull() & c("omitted") & (c("elements") == 0))
    return creations.where(one & F.coalesce(none, F.lit(False))).select("file", "line", F.lit(EMPTY_ARRAY).alias("kind"), F.lit("mscorlib").alias("to_assembly"), F.lit("EmptyArrayAllocation").alias("to_id"))
