"""The query language and search on single symbols."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from symdex.functions import querylang
from symdex.operators import search

LISTENER = ("HttpListener", "Acme.Net.Core", "lib\\net\\core\\Net.Core.csproj", "Acme.Net.HttpListener", 0)
SKIP = ("Skip", "Acme.Query", "lib\\query\\Query.csproj", "Acme.Query.Pipeline.Skip<T>(int count)", 72)
FOUND = {
    LISTENER: ["HttpL", "httplistener", '"HttpListener"', "HttpL listen", "HttpL class", "HttpL type", "HttpL struct class", "HttpL net\\core", "HttpL lib Net.Core", "HttpL acme.net",
               "Acme.Net.HttpL", "Net.HttpListener", "Acme.Net.get_HttpL", "set_HttpLis", "remove_Http", "Acme.Net.add_HttpListener"],
    SKIP: ["Skip", "skip method", "Pipeline.Skip", "Acme.Query.Pipeline.Sk", "Skip Acme.Query", "Skip query\\Query"],
}
MISSED = ["HttpL struct", "HttpL other\\dir", "HttpL Acme.Io", "Listener", '"HttpL"', "HttpL zebra", "Acme.Io.HttpL"]


def found(spark, symbol, texts):
    name, assembly, project, description, glyph = symbol
    symbols = spark.createDataFrame([(0, name, name.upper(), 0, glyph, description)], "pos long, name string, name_key string, assembly_number int, glyph int, description string")
    assemblies = spark.createDataFrame([(0, assembly, project)], "pos int, assembly_name string, project_path string")
    queries = querylang.parsed(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))
    return {texts[r["query_id"]] for r in search.find_symbols(symbols, assemblies, queries).select("query_id").collect()}


def test_one_query_like_many(spark):
    name, assembly, project, description, glyph = LISTENER
    symbols = spark.createDataFrame([(0, name, name.upper(), 0, glyph, description)], "pos long, name string, name_key string, assembly_number int, glyph int, description string")
    assemblies = spark.createDataFrame([(0, assembly, project)], "pos int, assembly_name string, project_path string")
    for text, n in (("Acme.Net.get_HttpL", 1), ("HttpL zebra", 0), ("ab", 0), ('"HttpListener"', 1), ('"Http"', 0)):
        assert search.search(symbols, assemblies, text).count() == n


def test_found(spark):
    for symbol, texts in FOUND.items():
        assert found(spark, symbol, texts) == set(texts)


def test_missed(spark):
    assert found(spark, LISTENER, MISSED) == set()


def reference_tokens(text):
    out, i = [], 0
    while i < len(text):
        if text[i] == " ":
            i += 1
        elif text[i] == '"':
            end = text.find('"', i + 1)
            end = len(text) if end < 0 else end + 1
            out.append(text[i:end])
            i = end
        else:
            end = min(x for x in (text.find(" ", i), text.find('"', i), len(text)) if x >= 0)
            out.append(text[i:end])
            i = end
    return out


def test_tokens(spark):
    texts = ["".join(x) for n in range(7) for x in itertools.product('a "', repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", querylang.tokens(F.col("t")).alias("x"))
    for r in df.collect():
        assert r["x"] == reference_tokens(r["t"]), r["t"]


@pytest.mark.parametrize(
    ("names", "word", "want"),
    [(["lake", "lamp", "Lamp", "land", "late"], "lamp", ["lamp", "Lamp"]), (["oak", "owl"], "oat", []), (["Ab", "aB", "ab", "a_"], "AB", ["Ab", "aB", "ab"]), ([], "a", []), (["x", "y"], "", ["x", "y"])],
)
def test_prefix(spark, names, word, want):
    df = spark.createDataFrame([(i, n, n.upper()) for i, n in enumerate(names)], "pos long, name string, name_key string")
    assert [r["name"] for r in search.prefix_search(df, word).orderBy("pos").collect()] == want


def test_prefix_reaches_the_scan(spark, tmp_path):
    names = [f"{a}{i}" for i in range(50) for a in random.Random(1).sample("abc", 3)]
    spark.createDataFrame([(n, n.upper()) for n in names], "name string, name_key string").write.parquet(str(tmp_path / "x"))
    plan = search.prefix_search(spark.read.parquet(str(tmp_path / "x")), "a1")._jdf.queryExecution().toString()
    assert "StringStartsWith(name_key,A1)" in plan


def test_truncated_before_ranking(spark):
    rows = [(i, "ab" if i > 100 else "abc", "AB" if i > 100 else "ABC", 0, 0, "n.x") for i in range(150)]
    symbols = spark.createDataFrame(rows, "pos long, name string, name_key string, assembly_number int, glyph int, description string")
    hits = search.search(symbols.withColumn("name", F.when(F.col("pos") > 100, "abc").otherwise(F.col("name"))), spark.createDataFrame([(0, "a", None)], "pos int, assembly_name string, project_path string"), "abc")
    assert hits.count() == 100
    assert hits.agg(F.max("pos")).first()[0] == 99


def test_empty_and_null_queries(spark):
    q = spark.createDataFrame([(0, None), (1, ""), (2, "ab"), (3, "x" * 261)], "query_id long, query string")
    assert querylang.parsed(q).count() == 0


def test_empty_cores_meet_the_symbols_that_pass(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    symbols = spark.createDataFrame([(i, f"n{i}", f"N{i}", 0, 0 if i % 2 else 72, "A.n") for i in range(6)], "pos long, name string, name_key string, assembly_number int, glyph int, description string")
    assemblies = spark.createDataFrame([(0, "Lib", None)], "pos int, assembly_name string, project_path string")
    kinds = [[], ["class"], ["class"], [], ["enum"], []]
    cores = ["", "n1", "", "", "", "n"]
    rows = [(i, 0, core, False, k, [], ["LIB"] if i == 3 else [], None, []) for i, (core, k) in enumerate(zip(cores, kinds, strict=True))]
    queries = spark.createDataFrame(rows, "query_id long, reading int, core string, verbatim boolean, kinds array<string>, paths array<string>, words array<string>, namespace string, dotted array<string>")
    got = sorted((r["query_id"], r["pos"]) for r in search.find_symbols(symbols, assemblies, queries).collect())
    assert got == sorted([(0, p) for p in range(6)] + [(1, 1)] + [(2, p) for p in (1, 3, 5)] + [(3, p) for p in range(6)] + [(5, p) for p in range(6)])
    assert {r["query_id"]: r["potential"] for r in search.potential_raw(symbols, queries).collect()} == {0: 6, 1: 1, 2: 6, 3: 6, 4: 6, 5: 6}


def test_first_mapping_of_a_path(spark):
    from symdex.operators import graph

    rules = spark.createDataFrame([(0, "c:\\Src\\a", "x/"), (1, "C:\\src", "y/"), (2, "ß", "z/"), (3, "c:\\src\\A", "never/"), (4, None, "n")], "place int, key string, value string")
    paths = ["C:\\SRC\\ab.cs", "c:\\src\\b.cs", "c:\\src\\obj\\b.cs", "d", "ßé", None, "", "d"]
    got = [(r["path"], r["server_path"]) for r in graph.match_server_path(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()]
    want = {"C:\\SRC\\ab.cs": "x/b.cs", "c:\\src\\b.cs": "y/\\b.cs", "ßé": "z/é"}
    assert sorted(got, key=repr) == sorted(((p, want.get(p)) for p in paths), key=repr)


def test_serving_table_is_written_once(spark, tmp_path):
    from symdex.plans import binding

    data = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(data):
        pytest.skip("no tables")
    first, again = binding.symbols(spark, data).inputFiles(), binding.symbols(spark, data).inputFiles()
    assert sorted(first) == sorted(again)
    plan = search.prefix_search(binding.symbols(spark, data), "cold")._jdf.queryExecution().toString()
    assert "StringStartsWith(name_key,COLD)" in plan and "Exchange" not in plan


def test_cut_of_a_search(spark):
    """The cut is a top-k of each partition, whether a filter asks for assemblies or not, and both ways give the same rows."""
    rows = [(i, f"Name{i:04d}", f"NAME{i:04d}", i % 3, 0 if i % 2 else 72, "A.n") for i in range(400)]
    symbols = spark.createDataFrame(rows, "pos long, name string, name_key string, assembly_number int, glyph int, description string").repartition(4)
    assemblies = spark.createDataFrame([(i, f"lib{i}", f"src\\p{i}") for i in range(2)], "pos int, assembly_name string, project_path string")
    plain, filtered, kind = (search.search(symbols, assemblies, q) for q in ("name", "name lib1", "name class"))
    for df in (plain, filtered, kind):
        assert "TakeOrderedAndProject" in df._jdf.queryExecution().toString()
    assert [(r["pos"], r["assembly_name"]) for r in plain.orderBy("pos").collect()] == [(i, f"lib{i % 3}" if i % 3 < 2 else None) for i in range(100)]
    assert sorted(r["pos"] for r in filtered.where("core = 'name'").collect()) == [i for i in range(400) if i % 3 == 1][:100]
    assert sorted(r["pos"] for r in kind.collect()) == [i for i in range(400) if i % 2][:100]
