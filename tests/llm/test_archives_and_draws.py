"""Web archives, importance resampling and periodic runs against brute force on small, awkward tables."""

import gzip
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symdex.llm import importance, periodic, warc
from symdex.llm.support import shared_dir

SCHEMA = "doc_id long, text string, row string, own double, copy string, score string, rank string, place int, bucket string"


def documents(spark, rows):
    """A table with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", -1.0, "y", "z", "r", -1, "b") for r in rows], SCHEMA)


def key(rows):
    return sorted(map(tuple, rows), key=repr)


PAGES = [
    (1, "http://a/ü x%20y\r\nX-Evil: 1", "<p>" + "é" * 60), (2, None, "<p>" + "é" * 60), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 100), (9, "u", "x" * 100),
    (8, "u", "x" * 100), (8, "u", "x" * 100), (7, "u", "x" * 100), (None, "u", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "line\r\n\r\nline\x00" * 400_000), (13, "v", "line\r\n\r\nline\x00" * 400_000),
    (-4, "u", "x" * 101), (14, "u", "WARC/1.1\r\n\r\n" * 20), (None, None, None),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "other", -1) for i, u, h in rows], "page_id long, url string, html string, digest string, first int")


def archive(spark, rows, name):
    path = f"{shared_dir(spark)}/{name}-{random.random()}"
    warc.write(pages(spark, rows).repartition(3), path)
    return path


def test_warc(spark):
    got = warc.report(pages(spark, PAGES).repartition(3), f"{shared_dir(spark)}/w-{random.random()}")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert key(got.collect()) == key(warc.brute_force([(i, h) for i, _, h in PAGES]))
    assert warc.report(pages(spark, []), f"{shared_dir(spark)}/w-{random.random()}").count() == 0


def test_warc_round_trip_and_plain_gzip(spark):
    path = archive(spark, PAGES, "round")
    back = warc.read(spark, path).collect()
    want = {(i, h or "") for i, _, h in PAGES}
    assert {(r["page_id"], r["payload"].decode()) for r in back if r["record_type"] == "response"} <= want
    assert {r["url"] for r in back if r["page_id"] == 1} == {PAGES[0][1]} and {r["url"] for r in back if r["page_id"] == 2} == {None}
    assert all(r["problem"] is None for r in back) and len(back) == len(PAGES)
    for r in spark.read.format("binaryFile").load(path).where("path like '%part-%'").collect():
        data = bytes(r["content"])
        whole = gzip.decompress(data)  # any gzip reader takes it
        assert whole.count(b"WARC-Record-ID:") == sum(x["file"] == r["path"] for x in back)
        for x in back:
            if x["file"] == r["path"]:
                assert zlib.decompressobj(31).decompress(data[x["offset"] :]).startswith(b"WARC/1.1\r\n")


def test_warc_file_sizes_and_large_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_BYTES", 1000)
    monkeypatch.setattr(warc, "RUNS", 2)
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(900))) for i in range(60)] + [(100, "u", "q" * (17 << 20)), (101, "u", "tail")]
    path = archive(spark, rows, "sizes")
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).where("path like '%part-%'").collect()]
    assert len(files) > 10
    back = warc.read(spark, path, payload=False).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in back) == sorted((i, len(h)) for i, _, h in rows) and {r["payload"] for r in back} == {None}


def test_damaged_records_are_reported_and_passed_over():
    parts = [warc.member(i, "u", b"payload %d" % i, __import__("hashlib").sha256(b"payload %d" % i).hexdigest(), None) for i in range(5)]
    ok = list(warc.records(b"".join(parts)))
    assert [r["page_id"] for r in ok] == list(range(5)) and not any(r["problem"] for r in ok)
    bent = bytearray(b"".join(parts))
    bent[len(parts[0]) + 60] ^= 0xFF
    got = list(warc.records(bytes(bent)))
    assert {r.get("page_id") for r in got if not r["problem"]} >= {0, 2, 3, 4} and any(r["problem"] for r in got)
    assert [r["problem"] for r in warc.records(b"".join(parts)[:-5])] == [None] * 4 + ["cut member"]
    assert [r["problem"] for r in warc.records(b"no gzip at all")] == ["damaged member"] and not list(warc.records(b""))
    z = lambda x: gzip.compress(x)
    plain = zlib.decompressobj(31).decompress(parts[0])
    wrong = [plain.replace(b"payload 0", b"payload 9"), plain[:-4], plain.replace(b"Content-Length", b"Content-Size"), plain.replace(b"urn:page:0", b"urn:page:zero"), b"junk"]
    assert [r["problem"] for r in warc.records(b"".join(map(z, wrong)))] == ["wrong block digest", "wrong length", "no header", "no record id", "no header"]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ÉTÉ", "中文", "A1", "it's", "x-y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.choice([1, 5, 19, 20, 21, 80]))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "... --"), (None, say(40)), (None, None), (103, rows[5][1]), (5, rows[5][1]), (5, say(30)), (104, say(9000)), (105, "z" * 70_000 + " " + "y" * 65 + " end"), (106, say(20).upper())]
    return rows + [(-1, say(25)), (107, " " * 70_000), (108, "a" * 64 + " " + "b" * 63 + " c")]


@pytest.mark.parametrize("chunk", [50, 1 << 16])
def test_importance(spark, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    rows, target = texts(), ["w1 w2 w3 w1 w2", None, "", "ÉTÉ w7 " * 300, "w9"]
    bench = spark.createDataFrame([(t, "clash") for t in target], "text string, own string")
    got = importance.report(documents(spark, rows).repartition(3), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert key(got.collect()) == key(importance.brute_force(rows, target))
    drawn = importance.drawn(documents(spark, rows), bench)
    assert {r["doc_id"] for r in drawn.select("doc_id").collect()} == {r[0] for r in importance.brute_force(rows, target) if r[4]}


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.report(documents(spark, []), none).count() == 0
    rows = texts()
    assert key(importance.report(documents(spark, rows), none).collect()) == key(importance.brute_force(rows, []))
    same = [(7, "one two " * 15)] * 9
    assert sorted(r["rank"] or 0 for r in importance.report(documents(spark, same), none).collect()) == [0] * 7 + [1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=12))
def test_crc_of_words_and_pairs(items):
    data = np.frombuffer("".join(items).encode(), np.uint8)
    size = np.array([len(x.encode()) for x in items], np.int64)
    end = np.cumsum(size)
    start = end - size
    crc = importance.word_crcs(data, start, end)
    assert crc.tolist() == [zlib.crc32(x.encode()) for x in items]
    pair = importance.joined_crcs(crc[:-1], crc[1:], data, start[1:], end[1:])
    assert pair.tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(items, items[1:], strict=False)]


def check_runs(words):
    code = np.unique(np.array([str(w) for w in words], dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, np.int64)
    own = periodic.mix(code.astype(np.uint64) + np.uint64(99))
    got = sorted(periodic.runs_of(code, own))
    assert got == periodic.brute_runs(list(words))
    if got:
        doc, n = np.zeros(len(code), np.int64), len(code)
        assert periodic.suspects(own, doc, n - np.arange(n), np.arange(n), 1)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90))
def test_runs_of_two_words(words):
    check_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 6), st.integers(0, 10)), max_size=6))
def test_runs_of_repeated_pieces(pieces):
    words = []
    for piece, times, rest in pieces:
        words += piece * times + piece[:rest]
    check_runs(words[:400])


def test_runs_of_famous_words():
    a, b = "a", "ab"
    for _ in range(11):
        a, b = b, b + a
    check_runs(b)
    check_runs("a" * 3000)
    check_runs("ab" * 700 + "c" + "ab" * 700)
    check_runs([bin(i).count("1") % 2 for i in range(300)])


def test_periodic_runs(spark):
    rng = random.Random(4)
    say = lambda n, k=50: " ".join(rng.choice(["Ab", "ab", "é", "w,", *map(str, range(k))]) for _ in range(n))
    rows = [(i, say(rng.choice([1, 2, 11, 12, 30, 200]))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b"), (None, "x y " * 9), (None, None), (203, "la " * 500), (204, "la " * 500), (204, "la " * 500), (205, say(5000)), (206, (say(40) + "\n") * 5 + say(3)), (-7, "a b\x0cc " * 6)]
    rows += [(300 + i, say(20) + " " + " ".join([say(q)] * t) + " " + say(9)) for i, (q, t) in enumerate([(1, 12), (1, 11), (5, 3), (6, 2), (6, 3), (7, 2), (31, 2), (30, 3), (15, 4), (64, 2)])]
    got = periodic.report(documents(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert key(got.collect()) == key(periodic.brute_force(rows))
    assert periodic.report(documents(spark, [])).count() == 0
    full = {r["doc_id"]: r for r in periodic.found(documents(spark, rows[-10:])).collect()}
    assert [tuple(x) for x in full[305]["runs"]] and len(full[305]["collapsed"].split()) < len(rows[-5][1].split())
    assert full[301]["collapsed"] == " ".join(rows[-9][1].split()) or full[301]["runs"]
