"""Build files and solutions as rows."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "file string, place long, line long, kind string, parent string, element string, attribute string, value string, attributes map<string, string>"


def nodes(file: str, xml: str) -> list[tuple]:
    """Elements, attributes and texts of one file, as far as it is well formed; line: of the element's start, or of a text's end."""
    out: list[tuple] = []
    above: list[str | None] = [None]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.ordered_attributes = True

    def add(kind: str, parent: str | None, element: str | None, attribute: str | None, value: str | None, attributes: dict) -> None:
        out.append((file, len(out), parser.CurrentLineNumber, kind, parent, element, attribute, value, attributes))

    def start(name: str, flat: list[str]) -> None:
        attributes = dict(zip(flat[::2], flat[1::2], strict=True))
        add("element", above[-1], name, None, None, attributes)
        for key, value in attributes.items():
            add("attribute", above[-1], name, key, value, attributes)
        above.append(name)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: above.pop()
    parser.CharacterDataHandler = lambda text: add("text", above[-2] if len(above) > 1 else None, above[-1], None, text, {})
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return out


def xml_nodes(files: DataFrame) -> DataFrame:
    """Rows of ``NODES`` for each file (file, text), parsed in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODES.replace("map<string, string>", "map").split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                rows += nodes(file, text or "")
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return files.select("file", "text").mapInPandas(run, NODES)


def scan_solution(lines: DataFrame) -> DataFrame:
    """(file, name, path, id, kind) of the projects that solutions list; folders, which have no file of their own, are left out.

    lines: file, value.
    """
    part = lambda i: F.regexp_extract("value", r'^Project\("\{([^}]*)\}"\) = "([^"]*)", "([^"]*)", "\{([^}]*)\}"', i)
    out = lines.select("file", part(2).alias("name"), part(3).alias("path"), F.upper(part(4)).alias("id"), F.upper(part(1)).alias("kind"))
    return out.where(F.col("path").contains(".") & (F.col("id") != ""))


def scan_list(lines: DataFrame) -> DataFrame:
    """(value) of a list file: one project a line, without outer spaces and quotes; empty lines are left out."""
    v = F.trim("value")
    bare = F.when((F.length(v) > 1) & v.startswith('"') & v.endswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return lines.select(bare.alias("value")).where("value <> ''")


# What names an assembly, where the root namespace stands for it, and the namespace of old project files.
NAME = r"(?U)<(?:Module)?AssemblyName>([\w.$()\-]+)</(?:Module)?AssemblyName>"
ROOT_NAMESPACE = r"(?U)<RootNamespace>([\w.]+)</RootNamespace>"
BUILD_NAMESPACE = "http://schemas.microsoft.com/developer/msbuild/2003"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def properties(text: Column) -> Column:
    """Assignments of a build file in order, as structs (name, value); comments are left out and conditions count as met."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    groups = F.regexp_extract_all(bare, F.lit(r"(?s)<PropertyGroup(?:\s[^>]*)?>(.*?)</PropertyGroup>"), F.lit(1))
    one = r"<([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>([^<]*)</\1\s*>"

    def of(group: Column) -> Column:
        names, values = (F.regexp_extract_all(group, F.lit(one), F.lit(i)) for i in (1, 2))
        return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))

    return F.flatten(F.transform(groups, of))


def expanded(value: Column, known: Column) -> Column:
    """A value with each ``$(name)`` replaced by what is known of it, nothing if that is nothing; known: upper-cased name -> value."""
    parts = F.split(value, r"\$\(")

    def grow(out: Column, part: Column) -> Column:
        name = F.upper(F.substring_index(part, ")", 1))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when(part.contains(")"), F.concat(out, F.coalesce(F.try_element_at(known, name), F.lit("")), rest)).otherwise(F.concat(out, F.lit("$("), part))

    return F.aggregate(F.slice(parts, 2, 1 << 30), F.element_at(parts, 1), grow)


def evaluated(text: Column, given: Column) -> Column:
    """All properties of a build file, upper-cased name -> value: assignments take effect one after the other, so the last one of a name holds, and what a value
    names is what it is at that point.  Properties that name each other end there too.  given: map of the properties known before."""

    def assign(known: Column, x: Column) -> Column:
        name = F.upper(x["name"])
        return F.map_concat(F.map_filter(known, lambda k, v: k != name), F.create_map(name, expanded(x["value"], known)))

    return F.aggregate(properties(text), given, assign)


def assembly_names(files: DataFrame) -> DataFrame:
    """(file, name, way) of project files and program images.  files: file (a path), text.

    In order: the name that a pattern finds (``pattern``), through the root namespace if it refers to that; in a file of the old namespace, the last element
    that names the assembly, if it holds no reference (``element``); the evaluated property (``property``); the name of the file (``file``).
    """
    c = F.col
    text = F.coalesce("text", F.lit(""))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^\\/]*)\z", 1), r"\.[^.]*\z", "")
    image = F.lower("file").rlike(r"\.(dll|exe)\z")
    found = F.nullif(F.regexp_extract(text, NAME, 1), F.lit(""))
    root = F.nullif(F.regexp_extract(text, ROOT_NAMESPACE, 1), F.lit(""))
    pattern = F.when(found == "$(RootNamespace)", F.coalesce(root, found)).otherwise(found)
    named = F.filter(properties(text), lambda x: x["name"] == "AssemblyName")
    last = F.element_at(F.transform(named, lambda x: x["value"]), -1)
    for mark, letter in _ENTITIES.items():
        last = F.replace(last, F.lit(mark), F.lit(letter))
    element = F.when(text.contains(f'"{BUILD_NAMESPACE}"') & (F.size(named) > 0) & ~last.contains("$"), last)
    given = F.create_map(F.lit("MSBUILDPROJECTNAME"), c("stem"))
    value = F.nullif(F.try_element_at(evaluated(text, given), F.lit("ASSEMBLYNAME")), F.lit(""))
    out = files.withColumns({"stem": stem, "pattern": F.when(~image, pattern), "element": F.when(~image, element)})
    out = out.withColumn("property", F.when(~image & c("pattern").isNull() & c("element").isNull(), value))
    way = F.when(c("pattern").isNotNull(), "pattern").when(c("element").isNotNull(), "element").when(c("property").isNotNull(), "property").otherwise("file")
    return out.select("file", F.coalesce("pattern", "element", "property", "stem").alias("name"), way.alias("way"))


# Types of items whose files are indexed.
ITEMS = ("Resource", "Page", "EmbeddedResource", "TypeScriptCompile")


def project_items(nodes: DataFrame) -> DataFrame:
    """(file, item_type, include) of the items of build files whose files are indexed.  nodes: rows of ``xml_nodes``."""
    c = F.col
    own = nodes.where((c("kind") == "element") & (c("parent") == "ItemGroup") & c("element").isin(*ITEMS))
    return own.select("file", c("element").alias("item_type"), c("attributes")["Include"].alias("include")).where("include <> ''")


def scan_solution_xml(nodes: DataFrame) -> DataFrame:
    """(file, path) of the projects that solutions in XML list, in folders or not.  nodes: rows of ``xml_nodes``."""
    c = F.col
    own = nodes.where((c("kind") == "element") & (c("element") == "Project") & c("parent").isin("Solution", "Folder"))
    return own.select("file", c("attributes")["Path"].alias("path")).where("path <> ''")


def member_comments(parts: DataFrame) -> DataFrame:
    """(file, member, xml): the documentation of each member, of several the last.  parts: file, place (order of the parts of a file), text."""
    found = F.regexp_extract_all("text", F.lit(r'(?s)<member\s+name="[^"]*"[^>]*>.*?</member>'), F.lit(0))
    each = parts.select("file", "place", F.posexplode(found).alias("i", "xml")).withColumn("member", F.regexp_extract("xml", r'name="([^"]*)"', 1))
    return each.groupBy("file", "member").agg(F.max_by("xml", F.struct("place", "i")).alias("xml"))
