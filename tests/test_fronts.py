"""Codec, addresses and build files beyond what the tables show."""

import random

import pytest
from pyspark.sql import functions as F

from symdex.functions import huffman, routes
from symdex.operators import frontends, spans, trees
from symdex.sources import buildfiles, legacy


def test_codec():
    rng = random.Random(3)
    texts = ["", "a", "ab", "~ ~", "x" * 99] + ["".join(chr(rng.randint(32, 126)) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    frequencies: dict = {}
    for t in texts:
        for pair in huffman.pairs_of(t):
            frequencies[pair] = frequencies.get(pair, 0) + 1
    tree = huffman.Tree.of(frequencies)
    again = huffman.Tree.from_bytes(tree.to_bytes())
    assert again.bits == tree.bits
    for t in [*texts, "é", "tab\t"]:
        assert again.uncompress(tree.compress(t)) == t
    assert tree.compress("é") == b"\xff\xc3\xa9"


def test_codec_bits():
    """Left is 0, right is 1, the first bit is 0, and bits fill bytes from the lowest."""
    tree = huffman.Tree((((ord("a"), ord("b")), (127, 127)), (ord("c"), 127)))
    assert tree.to_bytes() == b"ab\x7f\x7f\xffc\x7f\xff"
    assert tree.compress("abc") == bytes([0b01000]) and tree.compress("ab") == bytes([0b10000])
    only = huffman.Tree.of({(ord("q"), 127): 5})
    assert only.uncompress(only.compress("q")) == "q"


def test_codec_of_a_column(spark):
    texts = ["one", "two", None, "drei!", "vier", "ü"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, value string")
    tree = huffman.build(df)
    packed = df.select("k", huffman.compress(tree, F.col("value")).alias("data"))
    assert [r[1] for r in packed.select("k", huffman.uncompress(tree, F.col("data"))).orderBy("k").collect()] == texts


@pytest.mark.parametrize(
    ("anchor", "want"),
    [("", (None, "/", None)), ("q=a%20b+c", (None, None, "a b+c")), ("Lib/x.CS", ("/Lib/x.CS.html", "/Lib/ProjectExplorer.html", None)), ("x.cs", ("/x.cs.html", None, None)), ("Lib/readme.txt", (None, None, None)),
     ("Lib,5", (None, None, None)), ("TypeScriptFiles/a.ts,7", ("/TypeScriptFiles/a.ts.html#l7", None, None)), ("Lib,namespaces", (None, "/Lib/namespaces.html", None)), ("Lib/a,b.cs", ("/Lib/a,b.cs.html", "/Lib/ProjectExplorer.html", None))],
)
def test_routes(spark, anchor, want):
    assert tuple(routes.routes(spark.createDataFrame([(anchor,)], "anchor string")).select("content", "navigation", "search").first()) == want


def test_broken_build_file(spark):
    files = spark.createDataFrame([("a", "<P><PropertyGroup><X>1</X></P>"), ("b", None), ("c", "<P><ItemGroup><Compile/><Y/></ItemGroup></P>")], "file string, text string")
    got = {tuple(r) for r in frontends.build_references(buildfiles.xml_nodes(files)).select("file", "kind", "name").collect()}
    assert got == {("a", 11, "X"), ("c", 13, "Y")}


def test_large_xml_is_not_classified(spark):
    docs = spark.createDataFrame([(1, "<a>"), (2, "<abcdef>"), (3, None)], "doc long, text string")
    own = spark.createDataFrame([(1, 0, 0, 1, "XmlDelimiter"), (2, 0, 0, 1, "XmlDelimiter")], "doc long, seq int, start int, length int, class string")
    got = {r["doc"]: r["html"] for r in frontends.xml_pages(own, docs, large=5).collect()}
    assert got == {1: '<span class="xd">&lt;</span>a&gt;', 2: "&lt;abcdef&gt;", 3: ""}


def test_parts_of_xml_are_classified(spark):
    """Comments, data, instructions, names, quotes, values and references are told apart; nothing is taken for a tag that isn't one."""
    text = "<?xml version='1.0'?><!-- a <b> --><r:x  k=\"1>2&lt;&z\" v = w/><![CDATA[<c>]]><?go on?>1 < 2 & 3 &#x41;</r:x\n><d e=\"f><!--<g>"
    d, n, a, q, v, e = "XmlDelimiter", "XmlName", "XmlAttributeName", "XmlAttributeQuotes", "XmlAttributeValue", "XmlEntityReference"
    want = [("<?", d), ("xml", n), ("version", a), ("=", d), ("'", q), ("1.0", v), ("'", q), ("?>", d), ("<!--", d), (" a <b> ", "XmlComment"), ("-->", d)]
    want += [("<", d), ("r:x", n), ("k", a), ("=", d), ('"', q), ("1>2", v), ("&lt;", e), ("&z", v), ('"', q), ("v", a), ("=", d), ("w", v), ("/>", d)]
    want += [("<![CDATA[", d), ("<c>", "XmlCDataSection"), ("]]>", d), ("<?", d), ("go", n), (" on", "XmlProcessingInstruction"), ("?>", d), ("&#x41;", e)]
    want += [("</", d), ("r:x", n), (">", d), ("<", d), ("d", n), ("e", a), ("=", d), ('"', q), ("f", v), (">", d), ("<!--", d), ("<g>", "XmlComment")]
    found = frontends.xml_spans(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a<b")], "doc long, text string")).orderBy("start").collect()
    assert [(text[r["start"] : r["start"] + r["length"]], r["class"]) for r in found] == want


def test_ranges_of_xml_have_lines_and_columns(spark):
    """As a scan letter by letter finds them: a lone CR ends no counted line, but what is before it isn't in the line of what follows; gaps have no line."""
    text = "\r<a>\r\n<b c='\r1\n'/>\r\r<é>x\n\n</é><!--\n--></a>\r"
    starts = [i for i, x in enumerate(text) if x == "<"] + [text.index("c="), text.index("\r1"), text.index("\n-->")]
    number = lambda p: sum(text[i] == "\n" or (text[i] == "\r" and text[i + 1] == "\r") for i in range(p))
    begin = lambda p: max((i + 1 for i in range(p) if text[i] in "\r\n"), default=0)
    size = lambda p: next((i for i in range(p, len(text)) if text[i] in "\r\n"), len(text)) - begin(p)
    own = spark.createDataFrame([(1, i, s, 1, "XmlDelimiter") for i, s in enumerate(sorted(starts))] + [(2, 0, 0, 1, "XmlName"), (9, 0, 0, 1, "XmlName")], "doc long, seq int, start int, length int, class string")
    found = frontends.xml_ranges(own, spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in found if r["class"]) == [(s, 1, "XmlDelimiter", number(s), begin(s), size(s)) for s in sorted(starts)]
    assert {r["doc"] for r in found} == {1, 3} and all(r["line"] is None and r["line_start"] is None for r in found if not r["class"])
    assert sorted(i for r in found if r["doc"] == 1 for i in range(r["start"], r["start"] + r["length"])) == list(range(len(text)))


def test_xml_pipeline_of_long_and_odd_pages(spark, tmp_path):
    """A page of more than a million letters is marked like any other, by its SQL too; each page has a row."""
    from symdex.plans import registry

    duckdb = pytest.importorskip("duckdb")

    body = "é &amp; " * 150_000
    pages = [(1, f"<p id='a'>{body}<br/>\r\n</p>"), (2, None), (3, ""), (None, "<a>\nb"), (5, "<!DOCTYPE x \"y\"><a <b c=\"&d\" 'e>\r<?f"), (6, "<!-- ad 0 -->\n\r&copy; <a href=/x/>")]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(path)
    got = {r["doc"]: (r["html"], r["ranges"]) for r in registry.queries()["xml_pipeline"](spark, str(tmp_path)).select("doc", "html", "ranges").collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert got == {doc: (html, ranges) for doc, html, ranges in db.sql("SELECT doc, html, ranges FROM (" + registry.oracle_sql()["xml_pipeline"] + ")").fetchall()}
    assert len(got) == len(pages) and got[2] == got[3] == ("", "")
    assert got[1][0].startswith('<span class="xd">&lt;</span><span class="xn">p</span> <span class="xan">id</span><span class="xd">=</span>&#39;<span class="xav">a</span>&#39;')
    assert got[1][1].endswith(f"{len(pages[0][1]) - 1}:1:1:3:4:XmlDelimiter")
    assert got[6][0] == (
        '<span class="xd">&lt;!--</span><span class="c"> ad 0 </span><span class="xd">--&gt;</span>\n \r<span class="xer">&amp;copy;</span> '
        '<span class="xd">&lt;</span><span class="xn">a</span> <span class="xan">href</span><span class="xd">=</span><span class="xav">/x</span><span class="xd">/&gt;</span>'
    )


def test_lists_in_parts_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "list")
    legacy.write_lines(spark.range(1000).repartition(7).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("value")), path)
    assert [int(r["value"]) for r in legacy.folder_lines(spark, path).orderBy("line").collect()] == list(range(999, -1, -1))


def test_pieces_of_a_long_text(spark):
    """Pieces are as many as points; nothing grows with the square of a document."""
    own = spark.range(20_000).select(F.lit(1).alias("doc"), F.col("id").alias("seq"), F.col("id").alias("start"), F.lit(2).alias("length"), F.lit("x").alias("class"), F.lit(True).alias("semantic"))
    assert spans.split_intervals(own).count() == 40_000 - 0


@pytest.mark.parametrize(("values", "want"), [(["river", "rivet"], 5), (["oak"], 1), ([], 0), (["tea", "tea", "xyz"], 3), (["", "z"], 0), (["stem1", "stem2", "q"], 5)])
def test_min_unique_prefix(spark, values, want):
    assert trees.min_unique_prefix(spark.createDataFrame(list(enumerate(values)), "seq int, value string")).first()["n"] == want
