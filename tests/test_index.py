"""Places of prefix ranges, versions, incremental facts, chains, trees and names of assemblies against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from symdex.operators import chains, positions, spans, trees
from symdex.sources import buildfiles, legacy, snapshots, storage


def names(spark, values):
    """A serving table: pos and name_key in the order of UTF-8 bytes."""
    keys = sorted((v.upper() for v in values), key=str.encode)
    return spark.createDataFrame(list(enumerate(keys)), "pos long, name_key string"), keys


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_bounds(spark, block):
    rng = random.Random(6)
    values = ["".join(rng.choice("abé~Z中\U0001f600") for _ in range(rng.randint(0, 5))) for _ in range(120)] + ["hot"] * 60
    table, keys = names(spark, values)
    words = {v[: rng.randint(0, 6)] for v in values} | {"", "zzz", "\U0010ffff", "ho", "hot", "hotter", "A"}

    def want(word):
        w = word.upper().encode()
        low = sum(k.encode() < w for k in keys)
        return low, low + sum(k.encode().startswith(w) for k in keys) - 1

    got = {r["word"]: (r["low"], r["high"]) for r in positions.bounds(table, spark.createDataFrame([(w,) for w in [*words, None]], "word string")).collect()}
    assert got == {w: want(w) for w in words}
    fence = positions.fences(table, block=block)
    for word in ("hot", "A", "", "zzz"):
        assert positions.bounds_of(table, fence, word, block=block) == want(word)
    low, high = want("hot")
    assert [r["name_key"] for r in positions.slice_of(table, low, high).collect()] == ["HOT"] * 60


def test_bounds_of_nothing(spark):
    table, _ = names(spark, [])
    assert positions.bounds_of(table, positions.fences(table), "x") == (0, -1)
    assert positions.bounds(table, spark.createDataFrame([("x",)], "word string")).collect()[0][1:] == (0, -1)


def test_chains_and_cycles(spark):
    rng = random.Random(7)
    links = {i: (rng.choice([None, *range(300)]) if i % 9 else i + 1000) for i in range(300)} | {400 + i: 401 + i for i in range(70)} | {470: None, 500: 501, 501: 500, 502: 502}
    weight = {i: rng.randint(0, 3) for i in links}

    def want(i):
        seen, total = set(), 0
        while links.get(i) is not None:
            if i in seen:
                return None, None
            seen.add(i)
            total += weight[i]
            i = links[i]
        return i, total

    rows = spark.createDataFrame([(i, n, weight[i]) for i, n in links.items()], "id long, next long, weight long")
    got = {r["id"]: (r["end"], r["total"]) for r in chains.ends(rows.repartition(3)).collect()}
    assert {i: got[i] for i in links} == {i: want(i) for i in links} and want(400) != (None, None) and got[500] == (None, None)
    assert chains.ends(rows.where("false")).count() == 0


def test_depth_and_forwarding(spark):
    rows = [("N", None, "namespace"), ("N.M", "N", "namespace"), ("C", "N.M", "class"), ("D", "C", "class"), ("m", "D", "method"), ("lost", "nowhere", "class"), ("self", "self", "class"), ("C", "N.M", "class"), (None, "C", "method"), ("below", "self", "method"), ("k", "lost", None)]
    got = {r["id"]: r["depth"] for r in chains.symbol_depth(spark.createDataFrame(rows, "id string, parent string, kind string")).collect()}
    assert got == {"N": 0, "N.M": 0, "C": 0, "D": 1, "m": 2, "lost": 0, "self": None, "below": None, "k": 1}
    moves = spark.createDataFrame([("a", "T", "b"), ("b", "T", "c"), ("c", "T", "d"), ("x", "U", "y"), ("y", "U", "x"), ("a", "V", None)], "assembly string, type string, to_assembly string")
    refs = spark.createDataFrame([(1, "a", "T"), (2, "c", "T"), (3, "d", "T"), (4, "x", "U"), (5, "a", "V"), (6, "b", "U")], "n int, assembly string, type string")
    assert {r["n"]: r["resolved"] for r in chains.forwarded(refs, moves).collect()} == {1: "d", 2: "d", 3: "d", 4: None, 5: "a", 6: "b"}


def test_versions_are_seen_as_a_whole(spark):
    root = storage.fresh(spark, "versions")
    assert snapshots.load(spark, root) == {}
    a, b = spark.range(3), spark.range(5).withColumn("x", F.lit("y"))
    assert snapshots.publish(spark, root, {"b": b, "a": a}) == 1
    broken = spark.range(1).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(spark, root, {"a": spark.range(99), "b": broken})
    now = snapshots.load(spark, root)
    assert list(now) == ["b", "a"] and now["a"].count() == 3 and now["b"].count() == 5 and now["b"].columns == ["id", "x"]
    assert snapshots.publish(spark, root, {"a": spark.range(7)}) == 2
    assert list(snapshots.load(spark, root)) == ["a"] and snapshots.load(spark, root, 1)["b"].count() == 5
    assert snapshots.retire(spark, root, keep=1) == [1] and snapshots.versions(spark, root) == [2]
    assert snapshots.load(spark, root)["a"].count() == 7


@pytest.fixture
def small_parts(spark):
    """Partitions stay apart however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_over_parts_give_what_one_run_gives(spark, small_parts):
    rows = [(p, f"t{i % 3}", i % 5, i) for p in ("p1", "p2", "p 3") for i in range(40)] + [("hot", "t0", 1, i) for i in range(3000)]
    facts = spark.createDataFrame(rows, "from_assembly string, to_assembly string, to_id int, seq int")
    one, many = storage.fresh(spark, "one"), storage.fresh(spark, "many")
    legacy.append_references(facts, one)
    legacy.append_references(facts.where("from_assembly = 'p1'").withColumn("seq", F.lit(-1)), many)
    legacy.append_references(facts.where("from_assembly in ('p2', 'hot')"), many)
    for _ in range(2):
        legacy.append_references(facts.where("from_assembly in ('p1', 'p 3')"), many)
    read = lambda path: sorted(map(tuple, spark.read.parquet(path).select("from_assembly", "to_assembly", "to_id", "seq").collect()))
    assert read(one) == read(many) == sorted(rows)
    assert len([f for f in spark.read.parquet(one).where("project = 'hot'").inputFiles() if "project=hot" in f]) > 1
    legacy.forget_projects(spark, many, ["p2"])
    assert {r[0] for r in read(many)} == {"p1", "p 3", "hot"}
    target = storage.fresh(spark, "targets")
    legacy.write_references(spark.read.parquet(many), target)
    assert len([f for f in spark.read.parquet(target).inputFiles() if "to_assembly=t0" in f]) > 1 and spark.read.parquet(target).count() == len(rows) - 40


def test_namespace_tree(spark):
    types = [("A.B", "T", "1", 1), ("A.B", "t", "2", 2), ("A.b.T", "Inner", "3", 3), ("", "Free", "4", 4), ("A", "Z", "5", 5), ("A", "B", "6", 6), ("a..C", "Q", "7", 7)]
    got = [tuple(r) for r in trees.namespace_tree(spark.createDataFrame(types, "namespace string, name string, id string, seq int")).orderBy("place").collect()]
    # the type B falls on the namespace B, and the namespace T on the type T
    assert got == [(0, 1, 7, "A", None), (1, 2, 3, "B", "6"), (2, 3, 2, "{T", "2"), (3, 4, 1, "{Inner", "3"), (4, 2, 2, "C", None), (5, 3, 1, "{Q", "7"), (6, 2, 1, "{Z", "5"), (7, 1, 1, "{Free", "4")]


def test_solution_explorer(spark):
    projects = spark.createDataFrame([("p", ["Src", "x"]), ("Q", ["src"]), ("a", [])], "project string, folders array<string>")
    docs = spark.createDataFrame([("p", ["b.cs"]), ("p", ["F", "a.cs"]), ("p", ["f", "A.cs"]), ("none", ["z"]), ("Q", [])], "project string, path array<string>")
    got = [(r["depth"], r["size"], r["kind"], r["name"]) for r in trees.solution_explorer(projects, docs).orderBy("place").collect()]
    assert got == [
        (1, 8, "folder", "Src"), (2, 6, "folder", "x"), (3, 5, "project", "p"), (4, 3, "folder", "F"), (5, 1, "document", "A.cs"), (5, 1, "document", "a.cs"), (4, 1, "document", "b.cs"), (2, 1, "project", "Q"), (1, 1, "project", "a"),
    ]


def test_names_of_assemblies(spark):
    old = f'<Project xmlns="{buildfiles.BUILD_NAMESPACE}"><PropertyGroup>'
    files = {
        "/a/one.csproj": "<AssemblyName>Für.x-1</AssemblyName>", "/a/two.csproj": "<ModuleAssemblyName>$(RootNamespace)</ModuleAssemblyName>", "/a/three.csproj": old + "<AssemblyName C='1'>a &amp; b</AssemblyName></PropertyGroup>",
        "/a/four.csproj": "<PropertyGroup><AssemblyName C='1'>a b</AssemblyName></PropertyGroup>", "/a/five.x.csproj": "<PropertyGroup><X>1</X><X>$(x)2</X><AssemblyName C=''>$(X) $(y)$(</AssemblyName><X>3</X></PropertyGroup>",
        "/a/six.csproj": "<PropertyGroup><A>$(B)</A><B>$(A)</B><AssemblyName C='1'>$(A)</AssemblyName></PropertyGroup>", "C:\\b\\seven.EXE": None, "eight": "", "/a/nine.csproj": "<PropertyGroup><AssemblyName C='1'>$(MSBuildProjectName).dll</AssemblyName></PropertyGroup>",
    }
    got = {r["file"]: (r["name"], r["way"]) for r in buildfiles.assembly_names(spark.createDataFrame(list(files.items()), "file string, text string")).collect()}
    assert got == {
        "/a/one.csproj": ("Für.x-1", "pattern"), "/a/two.csproj": ("$(RootNamespace)", "pattern"), "/a/three.csproj": ("a & b", "element"), "/a/four.csproj": ("a b", "property"), "/a/five.x.csproj": ("12 $(", "property"),
        "/a/six.csproj": ("six", "file"), "C:\\b\\seven.EXE": ("seven", "file"), "eight": ("eight", "file"), "/a/nine.csproj": ("nine.dll", "property"),
    }


def test_ranges_of_two_analyses(spark):
    of = lambda rows: spark.createDataFrame([(1, i, s, n, k) for i, (s, n, k) in enumerate(rows)], "doc int, seq int, start int, length int, class string")
    doc = spark.createDataFrame([(1, 12)], "doc int, n int")
    got = spans.prepare_ranges(of([(2, 3, "a")]), of([(6, 2, "b")]), doc).orderBy("start").collect()
    assert [(r["start"], r["length"]) for r in got] == [(0, 2), (2, 3), (5, 1), (6, 2), (8, 4)]
    nested = spans.prepare_ranges(of([(0, 6, "outer"), (1, 2, "comment"), (0, 3, "first")]), of([(4, 4, "later"), (9, 1, "own")]), doc).orderBy("start").collect()
    assert [(r["start"], r["length"], r["class"]) for r in nested] == [(0, 1, "first"), (1, 2, "first"), (3, 1, "outer"), (4, 2, "later"), (6, 2, "later"), (8, 1, None), (9, 1, "own"), (10, 2, None)]


def test_chunks_of_pages(spark):
    rng = random.Random(9)
    texts, pieces = [], []
    for doc in range(12):
        text = "".join(rng.choice("ab<>&\"'\n é\U0001f600") for _ in range(rng.choice([1, 5, 16, 17, 60])))
        texts.append((doc, text))
        at = 0
        while at < len(text):
            n = min(rng.randint(1, 40), len(text) - at)
            pieces.append((doc, at, n, rng.choice([None, "k", "t"])))
            at += n
    texts.append((99, ""))

    def escaped(t):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            t = t.replace(a, b)
        return t

    body = dict(texts)
    want = {d: "".join((f'<span class="{k}">' if k else "") + escaped(body[d][s : s + n]) + ("</span>" if k else "") for e, s, n, k in pieces if e == d) for d, _ in texts if d != 99}
    rows = spans.html_chunks(spark.createDataFrame(pieces, "doc int, start int, length int, class string"), spark.createDataFrame(texts, "doc int, text string"), 16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["chunk"])):
        got[r["doc"]] = got.get(r["doc"], "") + r["html"]
    assert got == want and len(rows) > len(texts)


def test_classes_of_symbols(spark):
    rows = [("i", "x", "Method"), ("t", "x", None), ("k", "this", "NamedType"), (None, "x", "Field"), ("punctuation", "this", "Parameter"), ("c", "new", "Constructor"), ("c", "x", "Constructor"), ("s", "base", "Field"), ("c", "this", "Parameter"), ("i", "x", "Label"), ("", "var", "Alias")]
    got = [r["css"] for r in spans.css_classes(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, class string, text string, kind string")).orderBy("n").collect()]
    assert got == ["i method", "t", "k", None, None, "c constructor", "c", "s", "c", "i", "t"]


def test_lists_of_servers(spark, tmp_path):
    import http.server
    import threading

    from symdex.sources import federation

    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "Assemblies.txt").write_text("﻿One;1;2\r\nTWO;3\r\n\r\nstraße\r\n", encoding="utf-8")
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "part-1").write_text("b\n")
    (tmp_path / "parts" / "part-0").write_text("a;0\nA;1\n")
    handler = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None, "__init__": lambda self, *a, **k: http.server.SimpleHTTPRequestHandler.__init__(self, *a, directory=str(tmp_path / "web"), **k)})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        found = federation.scan(spark, [base, str(tmp_path / "parts"), f"{base}/none", str(tmp_path / "nowhere"), f"file://{tmp_path}/web/Assemblies.txt"]).cache()
        assert sorted((r["server"], r["assembly_key"]) for r in federation.keys(found).collect()) == [(0, "ONE"), (0, "STRAßE"), (0, "TWO"), (1, "A"), (1, "B"), (4, "ONE"), (4, "STRAßE"), (4, "TWO")]
        assert sorted(r["server"] for r in found.where("note is not null").collect()) == [2, 3]
    finally:
        server.shutdown()
    assert federation.scan(spark, []).count() == 0


def test_case_is_folded_letter_by_letter(spark):
    from symdex.functions import text

    words = ["straße", "ﬁx", "Ärger", "ıſ", "ǆ", "ΣΑΣς", "\U00010428", "x1_"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold_case("w")).collect()]
    assert got == [text.folded(w) for w in words] == ["STRAßE", "ﬁX", "ÄRGER", "ıſ", "Ǆ", "ΣΑΣΣ", "\U00010400", "X1_"]


def test_settings_and_documentation(spark):
    from symdex.operators import graph, plugins

    lines = ["a:x=1", "a:x=2", "a:y=p:q=r", "b:only", "none", ":k=v"]
    got = {r["plugin"]: r["settings"] for r in plugins.config_groups(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")).collect()}
    assert got == {"a": {"x": "2", "y": "p:q=r"}, "b": {"only": ""}, "": {"k": "v"}}
    parts = [(1, 0, '<doc><member name="M:a">first</member>\n<member\nname="T:b" x="1"><p/></member>'), (1, 1, '<member name="M:a">second</member></doc>'), (2, 0, None), (2, 1, "<member>")]
    comments = buildfiles.member_comments(spark.createDataFrame(parts, "file int, place int, text string")).collect()
    assert {(r["file"], r["member"]): r["xml"].split(">")[1].split("<")[0] for r in comments} == {(1, "M:a"): "second", (1, "T:b"): ""}
    pages = ["MSBuildFiles\\a\\x.targets.html", "TypeScriptFiles\\y.ts.HTML", "Acme\\z.cs.html", "MSBuildFiles\\a\\x.txt", "MSBuildFiles", "TypeScriptFiles\\"]
    loose = graph.loose_files(spark.createDataFrame([(p,) for p in pages], "path string")).collect()
    assert sorted(map(tuple, loose)) == [("MSBuildFiles", "x.targets", "MSBuildFiles\\a\\x.targets"), ("TypeScriptFiles", "y.ts", "TypeScriptFiles\\y.ts")]


def test_numbers_within_groups_that_span_ranges(spark, small_parts):
    from symdex.operators import numbering

    rows = [("hot", i * 7 % 5000) for i in range(5000)] + [(g, i) for g in ("a", "z") for i in range(5)] + [(None, i) for i in range(3000)] + [(f"one{i}", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(4)
    got = sorted((r["g"] or "", r["x"], r["n"]) for r in numbering.within(df, ["g"], ["x"], "n").collect())
    assert got == sorted((g or "", x, x + 1) for g, x in rows)
    ends = numbering.within(df, ["g"], ["x"], "n", "last").where("last").select("g", "n").collect()
    sizes = {"hot": 5000, None: 3000, "a": 5, "z": 5} | {f"one{i}": 1 for i in range(50)}
    assert len(ends) == len(sizes) and dict(map(tuple, ends)) == sizes
    assert numbering.within(df.where("false"), ["g"], ["x"], "n", "last").count() == 0


def test_partial_types_of_a_hot_id(spark, small_parts):
    from symdex.operators import references

    rows = [("hot", f"f{i:05d}", i) for i in range(4000)] + [("two", "a", 1), ("two", "b", 2), ("one", "a", 3), (None, "a", 4), (None, "b", 4)]
    got = references.partial_types(spark.createDataFrame(rows, "id string, file string, offset int").repartition(4)).collect()
    assert sorted((r["id"] or "", r["file"], r["place"], r["anchor"]) for r in got) == sorted([("hot", f"f{i:05d}", i + 1, i == 0) for i in range(4000)] + [(x, f, n, n == 1) for x in ("two", "") for f, n in (("a", 1), ("b", 2))])
