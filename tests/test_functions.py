"""Text, path and span functions on small cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from symdex.functions import expressions, ids, paths, text
from symdex.operators import spans, trees


def one(spark, column, **values):
    names = list(values)
    kinds = {int: "int", str: "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{n}` {kinds[type(values[n])]}" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# Lines end with LF or CR LF, and with a CR before another CR or the end.
LINES = [("", []), ("word", [4]), ("one\ntwo\n", [4, 4, 0]), ("one\r\ntwo", [5, 3]), ("one\r", [4, 0]), ("one\r\r\n", [4, 2, 0]), ("\n\rone", [1, 4]), ("\rone", [4]), ("\n\n\n", [1, 1, 1, 0])]


@pytest.mark.parametrize(("t", "want"), LINES)
def test_line_lengths(spark, t, want):
    assert one(spark, text.line_lengths(F.col("t")), t=t) == want


def test_long_line(spark):
    assert one(spark, text.line_lengths(F.col("t")), t="x" * 200_000 + "\n") == [200_001, 0]


EXPRESSIONS = [
    ("", []), ("plain text", ["plain text"]), ("$(Open", ["$(Open"]), ("(x)", ["(x)"]), ("$(F())", ["$(F())"]), ("pre $(F(1)) post", ["pre ", "$(F(1))", " post"]),
    ("x$(One)y$(Two)z", ["x", "$(One)", "y", "$(Two)", "z"]), ("x$(One$(Two))", ["x", "$(One", "$(Two)", ")"]), ("@(Files->d)", ["@(Files-", ">d)"]), ("@(Files,d)", ["@(Files,", "d)"]),
    ("$(One)@(Files)z", ["$(One)", "@(Files)", "z"]), ("$(One.Length)", ["$(One.Length)"]), ("$One)", ["$One)"]), ("@One)$", ["@One)$"]),
]


@pytest.mark.parametrize(("t", "want"), EXPRESSIONS)
def test_expressions(t, want):
    assert expressions.pieces(t) == want


SEMICOLONS = [("", []), ("one", ["one"]), ("one;", ["one", ";"]), ("one;;\ttwo", ["one", ";", ";", "\t", "two"]), (" \n ", [" \n "]), ("; one two", [";", " ", "one", " ", "two"])]


@pytest.mark.parametrize(("t", "want"), SEMICOLONS)
def test_semicolons(spark, t, want):
    assert one(spark, text.split_semicolons(F.col("t")), t=t) == want


RELATIVE = [
    (r"d:\x\yz\p\q.c", r"d:\x\y\r\s.c", r"..\..\yz\p\q.c"), (r"d:\x\one.c", r"d:\x\two.c", "one.c"), (r"d:\x\p\one.c", r"d:\x\two.c", r"p\one.c"), (r"d:\one.c", r"d:\x\p\two.c", r"..\..\one.c"),
    (r"d:\lib\first\A.page", r"d:\lib\second\p\q\two.c", r"..\..\..\first\A.page"), (r"d:\lib", r"d:\lib\second\two.c", "..\\"),
]


@pytest.mark.parametrize(("a", "b", "want"), RELATIVE)
def test_relative(spark, a, b, want):
    assert one(spark, paths.relative_to_file(F.col("a"), F.col("b")), a=a, b=b) == want


def test_cone(spark):
    for path in (r"d:\one.c", r"d:\x\one.c"):
        assert one(spark, paths.path_in_cone(F.col("a"), F.col("b")), a=r"d:\x\y", b=path) == r"d:\x\y\one.c"


def test_ids(spark):
    h = ids.symbol_id(F.col("x"))
    for name in ("T:Acme.Net.HttpListener", "M:Acme.Net.HttpListener.#ctor", ""):
        digest = hashlib.md5(name.replace("#ctor", "ctor").encode()).hexdigest()[:16]
        assert one(spark, h, x=name) == digest
        assert int(one(spark, ids.hex_to_number(h), x=name)) == int.from_bytes(bytes.fromhex(digest), "little")
        assert one(spark, ids.number_to_hex(ids.hex_to_number(h)), x=name) == digest
    assert one(spark, ids.hex_to_number(F.col("x")), x="xyz") is None


def test_escape_offsets(spark):
    r = one(spark, text.html_escape_offsets(F.col("t"), F.lit(4), F.lit(9)), t="  a & \"b\" c ")
    assert (r["html"], r["new_start"], r["new_end"]) == ("a &amp; &quot;b&quot; c", 2, 21)


def test_url_encode(spark):
    assert one(spark, text.url_encode(F.col("t")), t="a b+é中(x)") == "a+b%2b%u00e9%u4e2d(x)"
    assert one(spark, text.url_encode(F.col("t")), t="😀") == "%ud83d%ude00"


def test_unique_prefix(spark):
    def slow(values):
        size = len(values[0])
        if len(set(values)) < len(values):
            return size
        n = 1
        while len({v[:n] for v in values}) < len(values) and n < size:
            n += 1
        return min(n, size)

    rng = random.Random(2)
    cases = [["river", "rivet"], ["q"], ["tea", "tea"], ["", "z"]] + [["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))] for _ in range(15)]
    for values in cases:
        df = spark.createDataFrame(list(enumerate(values)), "seq int, value string")
        assert trees.min_unique_prefix(df).first()["n"] == slow(values), values


def span_rows(spark, rows):
    return spark.createDataFrame(rows, "doc int, seq int, start int, length int, class string")


def test_prepare_ranges(spark):
    docs = spark.createDataFrame([(1, 12), (2, 4)], "doc int, n int")
    syntactic, semantic = span_rows(spark, [(1, 0, 1, 4, "p"), (2, 0, 0, 2, "x")]), span_rows(spark, [(1, 0, 7, 3, "q"), (2, 0, 0, 2, "y")])
    out = {(r["doc"], r["start"], r["length"], r["class"]) for r in spans.prepare_ranges(syntactic, semantic, docs).collect()}
    assert out == {(1, 0, 1, None), (1, 1, 4, "p"), (1, 5, 2, None), (1, 7, 3, "q"), (1, 10, 2, None), (2, 0, 2, "y"), (2, 2, 2, None)}


def test_gaps_of_nothing(spark):
    docs = spark.createDataFrame([(1, 3), (2, 0)], "doc int, n int")
    assert [tuple(r) for r in spans.fill_gaps(span_rows(spark, []), docs).collect()] == [(1, 0, 3, None)]


# Icons of a group of six go by accessibility; extension methods have numbers of their own, and some groups have public icons only.
ICONS = [
    ("class", "public", 0), ("class", "private", 4), ("method", "internal", 74), ("property", "protected", 105), ("enum member", "private", 24), ("extension method", "public", 220),
    ("extension method", "internal", 221), ("extension method", "private", 224), ("type parameter", "private", 126), ("struct", None, 108), ("field", "other", 42), ("nothing", "public", None), (None, "private", None),
]


@pytest.mark.parametrize(("kind", "access", "want"), ICONS)
def test_icons(spark, kind, access, want):
    from symdex.functions import symbols

    row = spark.createDataFrame([(kind, access)], "k string, a string")
    assert row.select(symbols.glyph_number(F.col("k"), F.col("a")).alias("x")).first()["x"] == want
