"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` hash tables cuts ``FUNCTIONS`` random Gaussian projections into slots of one width.  A query visits, in
each table, its own bucket and then perturbed ones in estimated order of success: the expected squared distance from a place in a slot to its
j-th nearest border is known, so one sequence of perturbation sets serves all queries, each by the order of its own borders.
Candidates of all tables are merged and ranked by exact Euclidean distance.

Slot width and number of probes are fitted on a bounded sample: of the pairs that find its neighbours, the one with the fewest candidates.
Where none does, queries are ranked against all rows.  Every row is indexed; no bucket is capped.

The buckets of a table are dealt into cells of about ``BLOCK_ROWS`` rows by their key.  A row goes to the cell of its bucket, and a query once to each cell where
it visits buckets, with their keys; so its vector is copied for cells, not for probes.  A cell with more than ``BLOCK_ROWS`` rows or ``BLOCK_QUERIES`` queries (a
bucket is never cut off, however large) is dealt into blocks of about that size.  Within a block a query is compared with the rows of the buckets
that it visits, and only its nearest rows leave the block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import discard, in_batches, stored
from .tokens import mix

TABLES = 2
FUNCTIONS = 8
#: Rows of the sample that slot width and probes are fitted on, how many of them ask, and the recall among them.
SAMPLE, ASKING, SAMPLE_RECALL = 3000, 150, 0.95
#: Widths, as multiples of the sample's spread, and probes that the fit looks at.
WIDTHS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
PROBES = (4, 16, 64, 256, 512, 1024)
NEAREST = 10
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Queries that are ranked against all rows at once, where hashing finds too few rows for them.
QUERY_BLOCK = 2048
_ROWS = 1024


def vectors(ids: pa.Array, column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows that take part: an id, the dimension, finite components, not all of them zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    start = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    take = (lengths == dimension) & ~np.asarray(ids.is_null())
    x = flat[start[take][:, None] + np.arange(dimension)[None, :]]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.asarray(ids.filter(pa.array(take)), np.int64)[good], x[good]


@cache
def perturbations(m: int, most: int) -> np.ndarray:
    """Sets of borders (most x 2m, true where in the set) in ascending order of expected cost; the first is empty.

    Borders count from the nearest to the farthest of the 2m; the j-th and the j-th from the end are the two of one slot, so no set has both.
    """
    n = np.arange(1, m + 1, dtype=float)
    near = n * (n + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - n[::-1] / (m + 1) + (n * (n + 1))[::-1] / (4 * (m + 1) * (m + 2))
    cost = np.r_[near, far].tolist()
    out = [()]
    queue = [(cost[0], (0,))]
    while queue and len(out) < most:
        c, chosen = heapq.heappop(queue)
        if all(2 * m - 1 - j not in chosen for j in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(queue, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            if len(chosen) < m:
                heapq.heappush(queue, (c + cost[last + 1], (*chosen, last + 1)))
    sets = np.zeros((len(out), 2 * m), bool)
    for i, chosen in enumerate(out):
        sets[i, list(chosen)] = True
    return sets


def probes(inside: np.ndarray, most: int) -> np.ndarray:
    """Steps (queries x probes x functions) from the own bucket; inside: places in the slots, from 0 to 1, one row a query."""
    q, m = inside.shape
    sets = perturbations(m, most)
    order = np.argsort(np.hstack([inside, 1 - inside]), axis=1, kind="stable")
    out = np.zeros((q, len(sets), m), np.int8)
    for j in range(2 * m):
        has = np.flatnonzero(sets[:, j])
        function, step = order[:, j] % m, np.where(order[:, j] < m, -1, 1).astype(np.int8)
        out[np.arange(q)[:, None], has[None, :], function[:, None]] += step[:, None]
    return out


class Hashes:
    """The tables' hash functions."""

    def __init__(self, dimension: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(TABLES, dimension, FUNCTIONS)) / width
        self.b = rng.random((TABLES, FUNCTIONS))

    def places(self, table: int, x: np.ndarray) -> np.ndarray:
        return x @ self.a[table] + self.b[table]

    @staticmethod
    def keys(slots: np.ndarray) -> np.ndarray:
        """One number for each bucket."""
        out = np.zeros(slots.shape[:-1], np.uint64)
        for i in range(slots.shape[-1]):
            out = mix(out * np.uint64(31) + slots[..., i].astype(np.int64).view(np.uint64) + np.uint64(i + 1))
        return out

    def own(self, table: int, x: np.ndarray) -> np.ndarray:
        """The bucket of each row."""
        return self.keys(np.floor(self.places(table, x)).astype(np.int64))

    def visited(self, table: int, x: np.ndarray, n_probes: int) -> np.ndarray:
        """Buckets of each query (queries x probes), the likeliest first."""
        place = self.places(table, x)
        slot = np.floor(place).astype(np.int64)
        return self.keys(slot[:, None, :] + probes(place - slot, n_probes))


class Block:
    """Queries that are compared with all rows they are given."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norm = ids, x, (x * x).sum(1)


class Nearest:
    """The nearest rows seen so far for each query of a block."""

    def __init__(self, block: Block, k: int = NEAREST):
        self.block, self.k = block, k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.kth = np.full(len(block.ids), np.inf)
        self.waiting, self.n_waiting = [], 0

    def add(self, ids: np.ndarray, x: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Compare rows with the queries ``asking`` (places in the block), or with all."""
        if asking is None:
            asking = np.arange(len(self.block.ids))
        for i in range(0, len(ids), _ROWS):
            self._add(ids[i : i + _ROWS], x[i : i + _ROWS], asking)

    def _add(self, ids: np.ndarray, x: np.ndarray, asking: np.ndarray) -> None:
        b = self.block
        norm = (x * x).sum(1)
        both = b.norm[asking][:, None] + norm[None, :]
        square = both - 2 * (b.x[asking] @ x.T)
        q, r = np.nonzero((square <= np.square(self.kth[asking])[:, None] + 1e-9 * both) & (b.ids[asking][:, None] != ids[None, :]))
        if not len(q):
            return
        q = asking[q]
        score = np.empty(len(q))
        for i in range(0, len(q), 65536):
            part = slice(i, i + 65536)
            score[part] = np.sqrt(np.square(b.x[q[part]] - x[r[part]]).sum(1))
        self.waiting.append((q, score, ids[r]))
        self.n_waiting += len(q)
        if self.n_waiting > 4 * self.k * len(b.ids) + 65536:
            self.settle()

    def settle(self) -> None:
        """Keep the k nearest of each query, of equal rows one."""
        query, score, rows = (np.concatenate(c) for c in zip((self.query, self.score, self.id), *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((rows, score, query))
        query, score, rows = query[order], score[order], rows[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (rows[1:] != rows[:-1])
        query, score, rows = query[new], score[new], rows[new]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.id = query[keep], score[keep], rows[keep]
        full = np.flatnonzero(np.arange(len(query)) - first == self.k - 1)
        self.kth[query[full]] = score[full]


def dimension_of(rows: DataFrame) -> int:
    """The most frequent dimension among all rows, the smaller of equally frequent ones; 0 without any vector."""
    sizes = rows.where("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
    found = sizes.orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def fit(rows: DataFrame, dimension: int) -> tuple[Hashes, int, float] | None:
    """(hashes, probes, share of candidates) from ``SAMPLE`` rows in hash order; None where no number of probes finds enough."""
    t = rows.where(F.size("embedding") == dimension).where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    ids, x = vectors(t["vec_id"], t["embedding"], dimension)
    ids, first = np.unique(ids, return_index=True)
    x = x[first]
    if len(ids) < 2:
        return None
    spread = float(np.sqrt(np.square(x - x.mean(0)).sum(1).mean())) or 1.0
    asking = np.random.default_rng(11).permutation(len(ids))[:ASKING]
    true = Nearest(Block(ids[asking], x[asking]))
    true.add(ids, x)
    true.settle()
    want = (true.query, np.searchsorted(ids, true.id))
    best = None
    for width in WIDTHS:
        hashes = Hashes(dimension, spread * width)
        when = np.full((len(asking), len(ids)), max(PROBES))  # the first probe that meets a row
        for t in range(TABLES):
            own, visited = hashes.own(t, x), hashes.visited(t, x[asking], max(PROBES))
            for i, keys in enumerate(visited):
                order = np.argsort(keys, kind="stable")
                place = np.minimum(np.searchsorted(keys[order], own), len(keys) - 1)
                when[i] = np.minimum(when[i], np.where(keys[order[place]] == own, order[place], max(PROBES)))
        for n in PROBES:
            if (when[want] < n).mean() >= SAMPLE_RECALL:
                share = float((when < n).mean())
                if best is None or share < best[2]:
                    best = (hashes, n, share)
                break
    return best


def indexed(rows: DataFrame, hashes: Hashes, dimension: int, n_cells: int, whole: bool = True) -> DataFrame:
    """(t, cell, key, vec_id, embedding): each row once for each table; whole: with id and vector."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = vectors(batch.column("vec_id"), batch.column("embedding"), dimension)
            for i in range(0, len(ids), _ROWS):
                own, part = ids[i : i + _ROWS], x[i : i + _ROWS]
                for t in range(TABLES):
                    keys = hashes.own(t, part)
                    columns = [pa.array(np.full(len(own), t, np.int32)), pa.array((keys % np.uint64(n_cells)).astype(np.int64))]
                    if whole:
                        columns += [pa.array(keys.view(np.int64)), pa.array(own), _lists(part, kind)]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "cell", "key", "vec_id", "embedding"][: len(columns)])

    return in_batches(rows).mapInArrow(run, "t int, cell long" + (f", key long, vec_id long, embedding array<{kind}>" if whole else ""))


def visiting(asking: DataFrame, hashes: Hashes, dimension: int, n_cells: int, n_probes: int) -> DataFrame:
    """(t, cell, query_id, keys, embedding): each query once for each cell where it visits buckets, with their keys."""
    kind = asking.schema["embedding"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = vectors(batch.column("vec_id"), batch.column("embedding"), dimension)
            step = max(1, 16 * _ROWS // n_probes)
            for i in range(0, len(ids), step):
                part = x[i : i + step]
                for t in range(TABLES):
                    keys = hashes.visited(t, part, n_probes)
                    cell = (keys % np.uint64(n_cells)).astype(np.int64)
                    place = np.repeat(np.arange(len(part)), keys.shape[1])
                    order = np.lexsort((keys.ravel(), cell.ravel(), place))
                    keys, cell, place = keys.ravel()[order], cell.ravel()[order], place[order]
                    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (cell[1:] != cell[:-1])])
                    who = place[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), t, np.int32)), pa.array(cell[first]), pa.array(ids[i : i + step][who]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(keys)].astype(np.int32)), pa.array(keys.view(np.int64))), _lists(part[who], kind)],
                        ["t", "cell", "query_id", "keys", "embedding"],
                    )

    return in_batches(asking).mapInArrow(run, f"t int, cell long, query_id long, keys array<long>, embedding array<{kind}>")


def _lists(x: np.ndarray, kind: str) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float32() if kind == "float" else pa.float64()))


def by_bucket(rows: DataFrame, asking: DataFrame, k: int, dimension: int, hashes: Hashes, n_probes: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query in each block where it visits buckets."""
    c = F.col
    n_cells = max(1, -(-rows.count() // BLOCK_ROWS))
    visits = stored(visiting(asking, hashes, dimension, n_cells, n_probes), "visits")
    count = lambda df, name: df.groupBy("t", "cell").agg(F.count("*").alias(name))
    both = count(indexed(rows, hashes, dimension, n_cells, whole=False), "n_rows").join(count(visits, "n_queries"), ["t", "cell"])
    # written first, so that the joins have shuffles of their own, in which Spark splits a cell of very many rows
    both = stored(both.select(c("t").alias("a"), c("cell").alias("b"), F.ceil(c("n_rows") / BLOCK_ROWS).cast("int").alias("i"), F.ceil(c("n_queries") / BLOCK_QUERIES).cast("int").alias("j")), "cells")

    def dealt(df: DataFrame, who: str, mine: str, other: str) -> DataFrame:
        columns = [x for x in df.columns if x not in ("t", "cell")]
        df = df.join(both.hint("shuffle_hash"), (c("t") == c("a")) & (c("cell") == c("b"))).withColumn("mine", F.pmod(F.xxhash64(who), c(mine)).cast("int"))
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), c(other) - 1))).select("t", "cell", c("mine").alias(mine), c("other").alias(other), *columns)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["keys"].combine_chunks()
        asked = pa.table({"place": pa.array(np.repeat(np.arange(len(right)), np.asarray(keys.value_lengths()))), "key": keys.flatten()}).sort_by("key")
        place, key = np.asarray(asked["place"]), np.asarray(asked["key"])
        best = Nearest(Block(*vectors(right["query_id"], right["embedding"], dimension)), k)
        left = left.sort_by("key")
        ids, x = vectors(left["vec_id"], left["embedding"], dimension)
        own = np.asarray(left["key"])
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            low, high = np.searchsorted(key, own[a], "left"), np.searchsorted(key, own[a], "right")
            if low < high:
                best.add(ids[a:b], x[a:b], place[low:high])
        best.settle()
        return pa.table({"query_id": pa.array(best.block.ids[best.query], pa.int64()), "vec_id": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.float64())})

    blocks = lambda df: df.groupBy("t", "cell", "i", "j")
    index = indexed(rows, hashes, dimension, n_cells)
    found = blocks(dealt(index, "vec_id", "i", "j")).cogroup(blocks(dealt(visits, "query_id", "j", "i"))).applyInArrow(nearest, "query_id long, vec_id long, score double")
    found = stored(found, "found")
    discard(visits, both)
    return found


def by_scan(rows: DataFrame, asking: DataFrame, k: int, dimension: int) -> DataFrame:
    """The same against all rows: queries are broadcast in blocks of ``QUERY_BLOCK``, and each task sends on its nearest rows."""
    spark = rows.sparkSession
    n_blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for i in range(n_blocks):
        t = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).toArrow().combine_chunks()
        ids, x = vectors(t["vec_id"], t["embedding"], dimension)
        if not len(ids):
            continue
        given = spark.sparkContext.broadcast(Block(ids, x))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            best = Nearest(given.value, k)
            for batch in batches:
                best.add(*vectors(batch.column("vec_id"), batch.column("embedding"), dimension))
            best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(given.value.ids[best.query]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])

        found = found.unionByName(in_batches(rows).mapInArrow(run, "query_id long, vec_id long, score double"))
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, asking: DataFrame, k: int = NEAREST, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``asking`` its k nearest of ``rows``, never rows with its own id.

    Both hold vec_id and embedding.  Vectors that are null, of another dimension than most, all zero, or that hold null or non-finite components
    take no part.  Of several usable queries with one id the smallest vector asks; equal rows with one id count once.  Ties go to the smaller vec_id.  Queries
    that meet fewer than k rows in the buckets they visit are ranked against all rows.
    """
    rows, asking = _plain(rows), _plain(asking)
    dimension = dimension_of(rows)
    if not dimension:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    rows, asking = usable(rows, dimension), usable(asking, dimension).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fitted = None if exact else fit(rows, dimension)
    if fitted is None:
        return ranked(by_scan(rows, asking, k, dimension), k)
    hashes, n_probes, _ = fitted
    met = by_bucket(rows, asking, k, dimension, hashes, n_probes)
    near = stored(ranked(met, k), "near")
    discard(met)
    full = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    rest = ranked(by_scan(rows, asking.join(full, "vec_id", "left_anti"), k, dimension), k)
    return near.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest).select("query_id", "rank", "vec_id", "score")


def _plain(df: DataFrame) -> DataFrame:
    kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id is not null")


def usable(rows: DataFrame, dimension: int) -> DataFrame:
    """Rows of the dimension with finite components that aren't all zero."""
    e = F.col("embedding")
    return rows.where((F.size(e) == dimension) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0))


def candidate_share(embeddings: DataFrame) -> tuple[float, int]:
    """(share of the sample's rows that a query is compared with, probes), as fitted; (1, 0) where queries meet all rows."""
    rows = embeddings.select("vec_id", "embedding")
    dimension = dimension_of(rows)
    found = fit(rows, dimension) if dimension else None
    return (found[2], found[1]) if found else (1.0, 0)


def report(embeddings: DataFrame, exact: bool = False) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), exact=exact)
