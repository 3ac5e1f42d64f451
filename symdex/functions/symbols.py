"""Kinds, ranks and icons of symbols."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_case

# Words of the query language that name a kind of symbol.
KINDS = ("assembly", "type", "class", "struct", "interface", "enum", "delegate", "method", "property", "event", "field", "file", "MSBuildProperty", "MSBuildItem", "MSBuildTarget", "MSBuildTask")
TYPES = ("class", "struct", "interface", "enum", "delegate")
# Icon numbers, from and to inclusive, of each kind.
GLYPHS = (
    (0, 5, "class"), (6, 11, "field"), (24, 29, "field"), (42, 47, "field"), (12, 17, "delegate"), (18, 23, "enum"), (30, 35, "event"), (48, 53, "interface"),
    (72, 83, "method"), (220, 221, "method"), (224, 224, "method"), (102, 107, "property"), (108, 113, "struct"), (195, 196, "file"), (227, 228, "file"),
)
# Words for an icon group in the client.
GLYPH_WORDS = {
    0: "class", 6: "constant", 12: "delegate", 18: "enum", 24: "enum member", 30: "event", 36: "exception", 42: "field", 48: "interface", 54: "macro", 60: "map",
    66: "map item", 72: "method", 78: "overload", 84: "module", 90: "namespace", 96: "operator", 102: "property", 108: "struct", 114: "type parameter", 150: "module",
}
# Icon groups of declared symbols, and the place of an accessibility in a group of six; groups without accessibility have only public icons.
GLYPH_GROUPS = {
    "class": 0, "constant": 6, "delegate": 12, "enum": 18, "enum member": 24, "event": 30, "field": 42, "interface": 48, "method": 72, "module": 84, "namespace": 90,
    "operator": 96, "property": 102, "struct": 108, "type parameter": 126, "local": 138, "parameter": 138, "range variable": 138, "intrinsic": 150, "label": 150, "extension method": 220,
}
GLYPH_ITEMS = {"internal": 2, "protected": 3, "private": 4}
EXTENSION_METHOD_ITEMS = {"internal": 1, "protected": 3, "private": 4}
PUBLIC_ONLY = ("enum member", "namespace", "operator", "type parameter", "local", "parameter", "range variable", "intrinsic", "label")
EXTENSION_GLYPHS = {".cs": 196, ".vb": 195, ".ts": 228}
# Icon numbers of script symbols.
SCRIPT_GLYPHS = {
    "variable": 42, "function": 72, "parameter": 42, "interface": 48, "property": 102, "method": 72, "type parameter": 114, "module": 150, "class": 0,
    "constructor": 72, "enum": 18, "enum member": 24, "import": 6, "get accessor": 72, "set accessor": 72,
}


def pick(key: Column, table: dict, default) -> Column:
    """Value of a small constant table."""
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key], F.lit(default))


def kind_rank(kind: Column) -> Column:
    return F.when(kind.isin(*TYPES), 1).when(kind == "field", 3).when(kind == "file", 4).otherwise(2)


def glyph_to_kind(glyph: Column) -> Column:
    out = F.lit("symbol")
    for low, high, kind in GLYPHS:
        out = F.when(glyph.between(low, high), kind).otherwise(out)
    return out


def glyph_number(kind: Column, accessibility: Column) -> Column:
    """Icon of a declared symbol: its group and, where the group tells them apart, its accessibility; null for unknown kinds, public for unknown accessibilities."""
    item = F.when(kind.isin(*PUBLIC_ONLY), 0).when(kind == "extension method", pick(accessibility, EXTENSION_METHOD_ITEMS, 0)).otherwise(pick(accessibility, GLYPH_ITEMS, 0))
    return pick(kind, GLYPH_GROUPS, None) + item


def glyph_keyword(glyph: Column) -> Column:
    """The word for the icon's group of six."""
    return pick(glyph - F.pmod(glyph, F.lit(6)), GLYPH_WORDS, "symbol")


def glyph_for_extension(path: Column) -> Column:
    return pick(F.lower(F.regexp_extract(path, r"\.[^.\\/]*$", 0)), EXTENSION_GLYPHS, 227)


def glyph_for_script_kind(kind: Column) -> Column:
    return pick(kind, SCRIPT_GLYPHS, 195)


def match_level(name: Column, term: Column) -> Column:
    """1 equal, 2 equal without case, 3 prefix, 4 prefix without case, 5 inside, 7 otherwise."""
    a, b = fold_case(name), fold_case(term)
    return F.when(name == term, 1).when(a == b, 2).when(name.startswith(term), 3).when(a.startswith(b), 4).when(name.contains(term), 5).otherwise(7)


def weight(level: Column, rank: Column) -> Column:
    return level * 10 + rank


def symbol_name(name: Column, type_name: Column, symbol_id: Column) -> Column:
    """Name of a reference's target: a constructor carries its type, an unknown symbol its id."""
    return F.when(name == ".ctor", F.concat(type_name, F.lit(" .ctor"))).otherwise(F.coalesce(name, symbol_id))


def url(assembly: Column, symbol_id: Column) -> Column:
    return F.concat(F.lit("/"), assembly, F.lit("/A.html#"), symbol_id)
