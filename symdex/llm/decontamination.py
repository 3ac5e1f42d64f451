"""Benchmark decontamination by winnowing.

Benchmark side: every run of 13 words of an item (an item of fewer words is one run) is a window.  From the k-grams of
each window the smallest hash is a fingerprint, so any document that holds the whole window selects the same k-gram.
Document side: the same selection; k-grams whose hash is a fingerprint of the benchmark are hits, and around a hit the
13-word windows are compared by a 128-bit hash.  Short items are compared at their own length, where every k-gram is
selected.

The benchmark's windows are dealt into blocks of at most ``BLOCK_WINDOWS``; only one block at a time is broadcast, and every
block meets all documents.  With one block, documents aren't shuffled at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import arrow_map, stored, with_text
from .tokens import Words, covered, grams, signed, words_of

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: 32 bytes each: one block takes 16 MB at most in a broadcast.
BLOCK_WINDOWS = 500_000


def minima(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-grams that are the smallest of some window of SPAN k-grams, and their hashes.

    All of equally small k-grams are selected, so the choice depends on nothing but the window.
    """
    h = words.hash
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, GRAM)
    n = len(g) - SPAN + 1
    low = g[:n].copy()
    for i in range(1, SPAN):
        np.minimum(low, g[i : i + n], out=low)
    whole = words.left()[:n] >= WINDOW
    low[~whole] = 0
    high = np.zeros(len(g), np.uint64)
    for i in range(SPAN):
        np.maximum(high[i : i + n], low, out=high[i : i + n])
    at = np.flatnonzero(high == g)
    return at, g[at]


class Block:
    """Windows of the benchmark in sorted arrays: hash (two halves), length, and which items hold them."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, length: np.ndarray, item: np.ndarray, prints: np.ndarray):
        order = np.lexsort((item, h2, h1))
        self.h1, self.h2, self.length, self.item = h1[order], h2[order], length[order], item[order]
        self.prints = np.unique(prints)
        self.short = sorted({int(x) for x in np.unique(length) if x < WINDOW})

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows that the block holds: their index in the arguments, once for each item, and the item."""
        lo, hi = np.searchsorted(self.h1, h1), np.searchsorted(self.h1, h1, "right")
        at = np.flatnonzero(hi > lo)
        each = hi[at] - lo[at]
        of = np.repeat(at, each)
        place = np.repeat(lo[at], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        same = self.h2[place] == h2[of]
        return of[same], self.item[place[same]]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, item) of every occurrence of a window of the block in the words."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        h, left = words.hash, words.left()
        if len(self.prints):
            at, g = minima(words)
            place = np.minimum(np.searchsorted(self.prints, g), len(self.prints) - 1)
            at = at[self.prints[place] == g]
            if len(at):
                start = np.unique(at[:, None] - np.arange(SPAN)[None, :])
                start = start[start >= 0]
                start = start[left[start] >= WINDOW]
                of, item = self.find(grams(h, WINDOW, start), grams(h, WINDOW, start, 1))
                out.append((start[of], np.full(len(of), WINDOW), item))
        for n in self.short:
            if len(h) >= n:
                start = np.flatnonzero(left >= n)
                of, item = self.find(grams(h, n, start), grams(h, n, start, 1))
                out.append((start[of], np.full(len(of), n), item))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(benchmark: DataFrame) -> DataFrame:
    """(h1, h2, length, item_id, fingerprints) of every window of every item."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.array(batch.column("item_id").fill_null(-1))
        for i, _, w in words_of(batch.column("text"), "alnum", True):
            n, left, doc = w.counts(), w.left(), w.doc()
            at, g = minima(w)
            start = np.flatnonzero(left >= WINDOW)
            lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + SPAN)
            prints = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hi - lo)].astype(np.int32)), pa.array(signed(g)[_ranges(lo, hi)]))
            h1, h2, item, length = grams(w.hash, WINDOW, start), grams(w.hash, WINDOW, start, 1), ids[i + doc[start]], np.full(len(start), WINDOW)
            yield _windows(h1, h2, length, item, prints)
            for k in range(1, WINDOW):
                own = np.flatnonzero(n == k)
                if len(own):
                    start = w.first[own]
                    yield _windows(grams(w.hash, k, start), grams(w.hash, k, start, 1), np.full(len(own), k), ids[i + own], pa.array([[]] * len(own), pa.list_(pa.int64())))

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return arrow_map(source, each, "h1 long, h2 long, length int, item_id long, prints array<long>")


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _windows(h1, h2, length, item, prints) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(h1)), pa.array(signed(h2)), pa.array(length.astype(np.int32)), pa.array(item.astype(np.int64)), prints],
        ["h1", "h2", "length", "item_id", "prints"],
    )


def blocks(benchmark: DataFrame) -> tuple[int, Iterator[Block]]:
    """(number of blocks, blocks) of the benchmark's distinct windows, ``BLOCK_WINDOWS`` or so at a time."""
    found = stored(windows(benchmark).dropDuplicates(["h1", "h2", "length", "item_id"]), "windows")
    n = max(1, -(-found.count() // BLOCK_WINDOWS))
    return n, _blocks(found, n)


def _blocks(found: DataFrame, n: int) -> Iterator[Block]:
    for k in range(n):
        # by window and item: a window that very many items hold is spread over the blocks
        part = found.where(F.pmod(F.xxhash64("h1", "h2", "item_id"), F.lit(n)) == k) if n > 1 else found
        t = part.toArrow()
        column = lambda name: t[name].combine_chunks().to_numpy()
        prints = t["prints"].combine_chunks()
        prints = np.asarray((pa.concat_arrays(prints.chunks) if isinstance(prints, pa.ChunkedArray) else prints).flatten(), np.int64)
        yield Block(column("h1").view(np.uint64), column("h2").view(np.uint64), column("length"), column("item_id"), prints.view(np.uint64))


#: What a document with hits has besides its columns.
HIT = "n_words long, hit_words array<int>, hit_items array<long>"


def mark(documents: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of documents with n_words, hit_words (word numbers inside windows, ascending) and hit_items.

    documents needs doc_id and text.  A null or empty text has no words.  Repeated rows are marked each by itself.
    """
    spark, names = documents.sparkSession, [*keep]
    n, parts = blocks(benchmark)
    if n > 1:  # rows meet again by what they hold, as doc_id may be null or repeated
        own = ["doc_id", "text"]
        documents = documents.withColumn("__row", F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b")))
        names.append("__row")
    source, text = with_text(documents, names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*names).schema) + ", " + HIT
    marked = None
    for block in parts:
        given = spark.sparkContext.broadcast(block)

        def each(batch: pa.RecordBatch, given=given) -> Iterator[pa.RecordBatch]:
            for i, j, w in words_of(batch.column(text), "alnum", True):
                start, length, item = given.value.hits(w)
                doc = w.doc()
                inside = np.flatnonzero(covered(len(w.start), start, length)) if len(start) else np.zeros(0, np.int64)
                pairs = np.unique(np.stack([doc[start], item]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
                at = np.searchsorted(doc[inside], np.arange(j - i + 1))
                items = np.searchsorted(pairs[0], np.arange(j - i + 1))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in names),
                        pa.array(w.counts().astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((inside - w.first[doc[inside]]).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(items.astype(np.int32)), pa.array(pairs[1].astype(np.int64))),
                    ],
                    [*names, "n_words", "hit_words", "hit_items"],
                )

        one = arrow_map(source, each, schema)
        if marked is None:
            marked = one
        else:  # only documents with hits in a further block are looked up
            more = one.where("size(hit_items) > 0").groupBy("__row").agg(F.max("hit_words").alias("w"), F.max("hit_items").alias("i"))
            marked = marked.join(more, "__row", "left").select(
                *names, "n_words",
                F.expr("array_sort(array_union(hit_words, coalesce(w, array())))").alias("hit_words"),
                F.expr("array_union(hit_items, coalesce(i, array()))").alias("hit_items"),
            )
    return marked.select(*keep, "n_words", "hit_words", "hit_items")


def contaminated(marked: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and the decision: a twentieth of the words or more lie in windows of the benchmark."""
    n = F.size("hit_words").cast("long")
    return marked.withColumns({"n_hit": n, "n_items": F.size("hit_items").cast("long"), "contaminated": (n > 0) & (n * 20 >= F.col("n_words"))})


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of the items found in it, and the decision."""
    out = contaminated(mark(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, ["doc_id"]))
    items = F.expr("sha2(array_join(sort_array(transform(hit_items, x -> cast(x as string))), ','), 256)")
    return out.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def brute_force(texts: dict, items: dict) -> dict:
    """The same by plain Python, for tests: doc -> (n_words, n_hit, n_items, digest, decision)."""
    import re

    def cut(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wanted = {}
    for key, text in items.items():
        w = cut(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + WINDOW]), set()).add(key)
    out = {}
    for key, text in texts.items():
        w, inside, found = cut(text), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if got := wanted.get(tuple(w[i : i + n])):
                    found |= got
                    inside |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[key] = (len(w), len(inside), len(found), digest, len(inside) > 0 and 20 * len(inside) >= len(w))
    return out
