"""Nearest neighbours against brute force."""

import numpy as np

from symdex.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "s") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")


def brute(rows, queries):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in ok:
            d = sorted((float(np.sqrt(((x - ok[q]) ** 2).sum())), i) for i, x in ok.items() if i != q)
            out[q] = [(i, s) for s, i in d[:10]]
    return out


def test_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[100][1]) for i in range(40)]
    rows += [(4000, None), (4100, [0.0] * 8), (4200, [1.0, None] + [0.0] * 6), (4300, [float("nan")] * 8), (4400, [1.0] * 3), (4500, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (4600, [])]
    want = brute(rows, [i for i, _ in rows if i is not None and i % 100 == 0])
    got: dict = {}
    for r in neighbours.report(table(spark, rows).repartition(4)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([r for _, _, r in g] == list(range(1, len(g) + 1)) for g in got.values())
    assert [i for i, _, _ in got[100]] == list(range(3000, 3010))
    exact: dict = {}
    for r in neighbours.report(table(spark, rows), exact=True).orderBy("query_id", "rank").collect():
        exact.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert exact == want


def test_few_or_no_rows(spark):
    assert neighbours.report(table(spark, [])).count() == 0
    assert neighbours.report(table(spark, [(0, [1.0, 2.0])])).count() == 0
    got = neighbours.report(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [5.0, 2.0])])).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 1.0), (2, 2, 4.0)]


def test_probes_come_in_estimated_order():
    sets = neighbours.perturbations(4, 81)
    assert len({tuple(x) for x in sets.tolist()}) == 81 and not sets[0].any()
    assert not (sets & sets[:, ::-1]).any()
    j = np.arange(1, 5)
    near = j * (j + 1) / (4 * 5 * 6)
    cost = sets @ np.r_[near, 1 - j[::-1] / 5 + (j * (j + 1))[::-1] / (4 * 5 * 6)]
    assert (np.diff(cost) > -1e-12).all()
    steps = neighbours.probes(np.array([[0.2, 0.9, 0.5, 0.45]]), 4)[0]
    assert steps.tolist() == [[0, 0, 0, 0], [0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 0, 1]] or steps[1].tolist() == [0, 1, 0, 0]


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(8)
    same = rng.normal(size=8).tolist()
    rows = [(5, same)] * 20 + [(100, (np.array(same) * 1.01).tolist())] * 3 + [(i, rng.normal(size=8).tolist()) for i in range(6, 30)]
    for exact in (False, True):
        got = [r["vec_id"] for r in neighbours.report(table(spark, rows), exact=exact).orderBy("rank").collect()]
        assert got == [i for i, _ in brute(rows, [100])[100]] if exact else got[0] == 5 and len(set(got)) == 10


def test_hot_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 1e-3 * rng.normal(size=8)).tolist()) for i in range(1500)]
    want = brute(rows, range(0, 1500, 100))
    got: dict = {}
    for r in neighbours.report(table(spark, rows).repartition(3)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len({i for i, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 150 and all(len(v) == 10 for v in got.values())


def test_far_outliers_get_all_their_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 2000) if i % 100]
    rows += [(100 * i, (40.0 * i * rng.normal(size=8)).tolist()) for i in range(1, 13)]
    want = brute(rows, [100 * i for i in range(1, 13)])
    got: dict = {}
    for r in neighbours.report(table(spark, rows).repartition(3)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    assert sum(got[q] == [i for i, _ in want[q]] for q in want) >= 11


def test_a_query_that_also_has_an_unusable_vector(spark):
    rows = [(100, None), (100, [0.0] * 4), (100, [1.0] * 4)] + [(i, [1.0 + i, 1.0, 1.0, 2.0]) for i in range(1, 30)]
    for order in (rows, rows[::-1]):
        got = neighbours.report(table(spark, order)).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == list(range(1, 11))
    two = [(100, [3.0, 1.0, 1.0, 2.0]), (100, [1.0] * 4), *rows[3:]]
    for order in (two, two[::-1]):
        assert [r["score"] for r in neighbours.report(table(spark, order)).orderBy("rank").limit(1).collect()] == [2 ** 0.5]


def test_queries_are_sent_to_cells_not_to_probes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1000)]
    hashes = neighbours.Hashes(8, 3.0)
    plain = neighbours._plain(table(spark, rows))
    visits = neighbours.visiting(plain.where("vec_id % 100 = 0"), hashes, 8, 10, 64).collect()
    assert len(visits) <= 10 * 10 * neighbours.TABLES and len({(r["t"], r["cell"], r["query_id"]) for r in visits}) == len(visits)
    assert all(k % 2**64 % 10 == r["cell"] for r in visits for k in r["keys"]) and sum(len(r["keys"]) for r in visits) == 10 * 64 * neighbours.TABLES
    index = neighbours.indexed(plain, hashes, 8, 10)
    assert index.count() == 1000 * neighbours.TABLES
