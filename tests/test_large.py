"""Queries over tables so large, or so odd, that cuts, short keys and slow paths show."""

import os

import pytest

from symdex.plans import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def beside(folder, **tables):
    """The smallest tables, with others in the place of some."""
    for name in os.listdir(SMALL):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_append_results_beyond_the_cut(spark, tmp_path):
    parts = spark.range(1, 251).selectExpr("id AS p_partkey", "'cold ring' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    found = registry.queries()["append_results"](spark, beside(tmp_path, part=parts)).collect()
    assert sorted(tuple(r) for r in found) == [(k, 2) for k in range(1, 251)]


def test_redirect_client_of_ids_that_begin_alike(spark, tmp_path):
    """The ids of 13914 and 135365 share their first eight digits."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(1)
    keys = spark.createDataFrame([(13914, 1), (135365, 2), (135365, 3)], "l_partkey long, l_orderkey long")
    lines = lines.drop(*keys.columns).crossJoin(keys)
    parts = spark.read.parquet(f"{SMALL}/part.parquet").limit(1).selectExpr("135365L AS p_partkey", "* EXCEPT (p_partkey)")
    found = registry.queries()["redirect_client"](spark, beside(tmp_path, lineitem=lines, part=parts)).collect()
    assert [r["target"] for r in found] == [f"P/{r['id']}" for r in found] and len(found) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["split_intervals", "resolve_overlaps", "prepare_ranges", "fill_gaps_dedup", "distinct_points", "merge_islands", "concat_ranges"])
def test_spans_stay_where_their_texts_are_dealt(spark, name):
    """Neither spans nor pieces are shuffled, joined or broadcast, so no part of them grows with the table."""
    p = plan(registry.queries()[name](spark, SMALL))
    assert "Join" not in p and "Broadcast" not in p
    assert p.count("Exchange") == p.count("REPARTITION_BY_NUM") > 0


def test_pieces_of_nested_empty_and_far_spans(spark):
    from symdex.operators import spans as sp

    rows = [(1, 0, 0, 10), (1, 1, 2, 0), (1, 2, 4, 3), (1, 3, 4, 3), (1, 4, 20, 5), (2, 0, 2, 2)]
    found = sp.split_intervals(spark.createDataFrame([(*r, "c", True) for r in rows], "doc long, seq long, start long, length long, class string, semantic boolean"))
    ends = {d: sorted({p for e, _, s, n in rows if e == d for p in (s, s + n)}) for d in (1, 2)}
    want = {(d, q, i, a, b - a) for d, q, s, n in rows for i, (a, b) in enumerate((a, b) for a, b in zip(ends[d], ends[d][1:]) if s <= a and b <= s + n)}
    assert {tuple(r)[:5] for r in found.collect()} == want
    assert {(r["doc"], r["seq"]) for r in found.where("semantic").collect()} == {(1, 2), (1, 3), (1, 4), (2, 0)}


def test_chunks_of_pages_meet_their_text_once(spark):
    """Pieces become one row a chunk before they meet their text, which is never broadcast, and documents stay where they are dealt."""
    from symdex.operators import spans as sp

    docs = spark.createDataFrame([(1, "ab<de" * 3), (2, "")], "doc long, text string").repartition(4, "doc")
    pieces = spark.createDataFrame([(1, 0, 4, None), (1, 4, 9, "k"), (1, 13, 2, "i"), (1, 40, 2, "x")], "doc long, start long, length long, class string").repartition(4, "doc")
    found = sp.html_chunks(pieces, docs, 6)
    p = plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 'ab&lt;d<span class="k">ea'), (1, 1, "b&lt;deab"), (1, 2, '&lt;</span><span class="i">de</span>')]
    assert "Broadcast" not in p and p.count("Exchange") == p.count("REPARTITION_BY_NUM") == 2


def test_interpret_short_rows_are_dealt(spark):
    for name in ("interpret_names", "interpret_accessor", "msbuild_refs", "project_items", "scan_slnx"):
        p = plan(registry.queries()[name](spark, SMALL))
        assert p.count("Exchange") == p.count("REPARTITION_BY_NUM") == 1, name


def test_merge_occurrences_shuffles_texts_only(spark):
    p = plan(registry.queries()["merge_occurrences"](spark, SMALL))
    assert p.count("Exchange") == p.count("REPARTITION_BY_NUM") and "Broadcast" not in p


def test_xml_pipeline_runs_without_python(spark):
    p = plan(registry.queries()["xml_pipeline"](spark, SMALL))
    assert "Python" not in p and "Pandas" not in p and "Broadcast" not in p
    assert p.count("Exchange") == p.count("REPARTITION_BY_NUM") > 0


def test_xml_pages_of_spans_over_blocks(spark):
    from symdex.operators import frontends as fe

    text = "é<b>" * 700
    spans = [(1, 0, 0, 3, "XmlName"), (1, 1, 511, 2, "XmlName"), (1, 2, 1000, 1500, "XmlComment"), (1, 3, 2799, 1, "XmlName")]
    found = fe.xml_pages(spark.createDataFrame(spans, "doc long, seq long, start long, length long, class string"), spark.createDataFrame([(1, text), (2, ""), (3, "a&b")], "doc long, text string"))
    safe = lambda t: t.replace("<", "&lt;").replace(">", "&gt;")
    want, at = "", 0
    for _, _, s, n, k in spans:
        want, at = want + safe(text[at:s]) + f'<span class="{fe.XML_MARKS[k]}">{safe(text[s : s + n])}</span>', s + n
    assert dict(map(tuple, found.collect())) == {1: want, 2: "", 3: "a&amp;b"}


def test_line_of_a_long_text(spark):
    """A line of a million letters takes no time that grows with its square."""
    import time

    from pyspark.sql import functions as F

    from symdex.functions import text

    df = spark.createDataFrame([("ab\r\n" + "x" * 1_000_000 + "\ry", 900_000), ("ab\ncd", 1), ("a\rbc\nd", 3), ("", 0)], "t string, p int")
    began = time.time()
    got = [tuple(r["l"]) for r in df.select(text.line_from_position(F.col("t"), F.col("p")).alias("l")).collect()]
    assert got == [(4, 1_000_000), (0, 2), (2, 2), (0, 0)] and time.time() - began < 30


def test_namespace_tree_with_crowded_nodes(spark):
    from symdex.operators import trees

    rows = [(ns, f"T{i}", str(i), i) for i, ns in enumerate(["a", "A.b", "a.B.c", "", "a.b", "x.y"] * 5)] + [("a.T0", "in", "q", 99)]
    types = spark.createDataFrame(rows, "namespace string, name string, id string, seq long")
    tree = [sorted(map(tuple, trees.namespace_tree(types, crowd).collect())) for crowd in (1, 8, 50_000)]
    assert tree[0] == tree[1] == tree[2] and len(tree[0]) == 30 + 5 + 1 + 0
