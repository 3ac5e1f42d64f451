"""Queries over texts and tables that go on past where a short sample of them would end."""

import html
import re

import pytest

from symdex.plans import registry

LONG = "plain; text " * 60 + "déjà <vu> & 'more';"
TEXTS = {0: LONG, 1: "x" * 500, 2: "abcd", 3: "short & <b>", 4: "abcdefghijklmn", 5: ""}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(TEXTS.items()), "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    return d


def escaped(t):
    return html.escape(t).replace("&#x27;", "&#39;")


def offsets(t):
    t = t.strip(" ")
    return escaped(t), len(escaped(t[:5])), len(escaped(t[:30]))


WHOLE = {
    "is_ascii": lambda t: (bool(re.fullmatch("[ -~]*", t)),),
    "bytes_to_hex": lambda t: (t.encode().hex(),),
    "hex_to_bytes": lambda t: (t,),
    "html_escape_offsets": offsets,
    "escape_semicolons": lambda t: (t.translate(str.maketrans(";\r\n", ":  ")),),
    "split_semicolons": lambda t: ("|".join(re.findall(r"[ \t\r\n]+|;|[^; \t\r\n]+", t)),),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_texts(spark, texts, name):
    got = {r[0]: tuple(r)[1:] for r in registry.queries()[name](spark, texts).collect()}
    assert got == {k: WHOLE[name](t) for k, t in TEXTS.items()}


TURNS = {7001: "word of This, the longest Wörter. " * 30 + "end", 8002: "ab", 9003: "x" * 613, 9004: "", 9005: "and  this this and de\nla Ende."}
WORDS = ("the", "of", "and", "this", "de", "der", "la", "que", "in", "is", "that")


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame([(k // 1000, k % 1000, "user", t) for k, t in TURNS.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def cut_spans(doc, t):
    """(start, seq, length, class) of words, parts inside long ones, first letters of some, and spans into the next word, in order."""
    words, out, at = t.split(" "), [], 0
    for i, w in enumerate(words):
        n, half = len(w), len(w) // 2
        kind = "keyword" if w in WORDS else "class name" if re.match("[A-ZÀ-Þ]", w) else "comment" if w[-1:] in (".", ",") else "odd"
        if w:
            out.append((at, i * 4, n, kind))
        if n >= 6:
            out.append((at + 1, i * 4 + 1, 3, "number" if i % 2 else "comment"))
        if n >= 4 and i % 3 == 0:
            out.append((at, i * 4 + 2, 2, "string"))
        if w and i + 1 < len(words) and words[i + 1] and i % 4 == 1:
            out.append((at + half, i * 4 + 3, n - half + 2, "keyword"))
        at += n + 1
    return sorted(out)


def gaps(t, spans):
    """spans: (start, length, class) in order."""
    out, last = list(spans), 0
    for s, n, _ in spans:
        if s > last:
            out.append((last, s - last, None))
        last = s + n
    return out + [(last, len(t) + 9 - last, None)] * (len(t) + 9 > last)


def plain(doc, t):
    return [(s, n, k) for s, _, n, k in cut_spans(doc, t)]


def points(doc, t):
    return sorted({p for s, _, n, _ in cut_spans(doc, t) for p in (s, s + n)})


def pieces(doc, t):
    """(seq, start, length, class, whole): every span cut at all points in it."""
    for s, i, n, k in cut_spans(doc, t):
        cuts = [p for p in points(doc, t) if s <= p <= s + n]
        yield from ((i, a, b - a, k, len(cuts) == 2) for a, b in zip(cuts, cuts[1:]))


def resolved(doc, t):
    starts = {}
    for p in sorted(pieces(doc, t)):
        starts.setdefault(p[1], []).append(p)
    keep = ([p for p in g if p[3] != "comment"] or g[:1] for g in starts.values())
    return [p[-1][1:4] for p in keep]


def prepared(doc, t):
    """Names of classes come a second time as types: a whole piece of them gives its class to what stands there, a cut one takes its place."""
    out = {}
    for _, a, n, k, _ in sorted(pieces(doc, t)):
        if a not in out or k != "comment":
            out[a] = (n, k)
    for _, a, n, k, whole in sorted(pieces(doc, t)):
        if k == "class name":
            out[a] = (n, "type")
    return gaps(t, sorted((a, n, k) for a, (n, k) in out.items()))


def islands(doc, t):
    out, joined = [], False
    for s, _, n, k in cut_spans(doc, t):
        word = k == "keyword" and t[s : s + n] != "this"
        out.append([out.pop()[0] if word and joined else s, s + n])
        joined = word
    return [(a, b - a) for a, b in out]


def first_seen(doc, t):
    return {k: i for i, k in enumerate(dict.fromkeys(t[s : s + n] for s, _, n, k in cut_spans(doc, t) if k in ("odd", "class name")))}


MARK = {"keyword": "k", "comment": "c", "class name": "t", "string": "s", "odd": "unknownClassification"}
SPANS = {
    "fill_gaps": lambda d, t: gaps(t, plain(d, t)),
    "fill_gaps_dedup": lambda d, t: gaps(t, plain(d, t)),
    "concat_ranges": lambda d, t: [(s, m) for s, _, _, k in cut_spans(d, t) for m in [False] + [True] * (k == "comment")],
    "distinct_points": lambda d, t: [(p,) for p in points(d, t)],
    "split_intervals": lambda d, t: [p[:3] for p in pieces(d, t)],
    "resolve_overlaps": resolved,
    "prepare_ranges": prepared,
    "merge_islands": islands,
    "map_classification": lambda d, t: [(s, MARK[k]) for s, _, _, k in cut_spans(d, t) if k in MARK],
    "filter_classification": lambda d, t: [(s,) for s, _, _, k in cut_spans(d, t) if k in ("class name", "number", "string")],
    "local_ids": lambda d, t: list(first_seen(d, t).items()),
    "highlight_spans": lambda d, t: [(k, f"r{i} r") for k, i in first_seen(d, t).items()],
}


def test_texts_have_spans_of_all_kinds():
    each = [x for d, t in TURNS.items() for x in cut_spans(d, t)]
    starts = [(d, s) for d, t in TURNS.items() for s, *_ in cut_spans(d, t)]
    assert {k for *_, k in each} == {*MARK, "number"} and len(set(starts)) < len(starts)
    assert any(a[0] < b[0] and b[0] + b[2] < a[0] + a[2] for d, t in TURNS.items() for a, b in zip(cut_spans(d, t), cut_spans(d, t)[1:]))
    assert any("this" in t.split(" ") for t in TURNS.values())


def test_occurrences_of_whole_texts(spark, turns):
    got = {r["conv_id"] * 1000 + r["turn"]: r["line"] for r in registry.queries()["merge_occurrences"](spark, turns).collect()}
    assert got == {k: re.sub("([a-z]+)", r"<i>\1</i>", t) for k, t in TURNS.items()}


@pytest.mark.parametrize("name", sorted(SPANS))
def test_spans_of_whole_texts(spark, turns, name):
    got = [tuple(r) for r in registry.queries()[name](spark, turns).collect()]
    want = [(doc, *x) for doc, t in TURNS.items() for x in SPANS[name](doc, t)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Two suppliers, parts 1 to 19, and references that are nearly all late."""
    d = str(tmp_path_factory.mktemp("late"))
    rows = [(o, p, s, f"{1995 + o % 7}-0{1 + o % 9}-03") for o, p, s in LATE]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, day string")
    more = "1 AS l_linenumber, 1D AS l_quantity, 'N' AS l_returnflag, 'O' AS l_linestatus, CAST(day AS timestamp_ntz) AS l_shipdate"
    li.selectExpr("l_orderkey", "l_partkey", "l_suppkey", *more.split(", ")).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(0,), (1,)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    spark.range(1, 20).selectExpr("id AS p_partkey", "concat('n', id) AS p_name").write.parquet(f"{d}/part.parquet")
    return d


LATE = [(0, 1, 0), (3, 2, 1), (8, 5, 1), (60, 5, 0), (61, 7, 0), (12, 9, 1)]
USED = {p for _, p, _ in LATE}
EDGES = {(s, p % 2) for _, p, s in LATE}
FACTS = {
    "anti_unreferenced": [(p,) for p in range(1, 20) if p % 10 and p not in USED],
    "base_impl_stub_files": [(p,) for p in range(1, 20) if p % 10 and p % 6 and p not in USED],
    "referencing_count": [(a, sum(t == a for _, t in EDGES)) for a in {t for _, t in EDGES}],
    "file_references": [e for e in EDGES if e[0] != e[1]],
    "join_impl_members": [(str(p), str(s), str(s + 90 * (o % 10)), f"n{s}" if o % 10 == 0 and s % 4 else None) for o, p, s in LATE],
}


@pytest.mark.parametrize("name", sorted(FACTS))
def test_references_of_all_dates(spark, late, name):
    got = [tuple(r) for r in registry.queries()[name](spark, late).collect()]
    assert sorted(got, key=repr) == sorted(FACTS[name], key=repr)


def test_declarations_of_all_dates(spark, late):
    got = registry.queries()["scan_declaration_map"](spark, late)
    assert got.count() == len({(p, o % 50) for o, p, _ in LATE})


def test_invocations_of_all_orders(spark, tmp_path):
    spark.range(890, 911).selectExpr("id AS o_orderkey", "concat('p', id) AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in registry.queries()["scan_invocations"](spark, str(tmp_path)).orderBy("record").collect()]
    assert got == [(i, *(f"p{890 + 3 * i + j}" for j in range(3))) for i in range(7)]


def test_whole_index_is_returned(spark, tmp_path):
    spark.range(5).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(40).selectExpr("id AS p_partkey", "concat(IF(id % 2 = 0, 'cold ', 'warm '), id) AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["key"]: r["name"] for r in registry.queries()["sink_symbol_index"](spark, str(tmp_path)).collect()}
    names = {i: f"{('cold', 'warm')[i % 2]}{i}" for i in range(40)}
    assert got == {i: n.upper() if i % 3 == 0 else n for i, n in names.items()}
