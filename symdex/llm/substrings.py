"""Removal of repeated passages by difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: for any two positions there is a shift of at most 6 that brings both onto it.
So two equal passages of 13 words share a 7-word anchor that starts at a cover position in either document, at the same
place of the passage.  Steps, the same for tables of every size:

1. hash the 7-word anchors at cover positions; those that occur in two documents or more are shared, and a join brings back where;
2. extend: the 13-word windows that hold a shared anchor within their first seven places are compared by a 96-bit hash;
   each that two documents hold gets the smallest of them;
3. remove the words of windows that a smaller document holds.

Every aggregate is merged before its shuffle and written before it is joined, so each join has shuffles of its own, and Spark splits
the windows and anchors that very many documents hold there.  Words are told apart by 64-bit hashes, windows and anchors by
hashes of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import arrow_map, discard, id_and_text, stored
from .tokens import CHUNK_BYTES, Words, buffers, covered, grams, runs, signed

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_IS_COVER = np.isin(np.arange(PERIOD), COVER)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, "space", False)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(batch.column(column))
    for i, j in runs(offsets, most):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def anchors(w: Words) -> np.ndarray:
    """Word positions at which an anchor of a whole window may start."""
    place = np.arange(len(w.start)) - np.repeat(w.first[:-1], w.counts())
    return np.flatnonzero(_IS_COVER[place % PERIOD] & (w.left() >= ANCHOR) & np.repeat(w.counts() >= WINDOW, w.counts()))


def held_twice(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that are sorted by keys and document: where each key starts, and 1 or 2 for its being in one document or more."""
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, (doc[first] != doc[np.r_[first[1:], len(doc)] - 1]) + 1 if len(first) else first


def anchor_rows(documents: DataFrame) -> DataFrame:
    """(h, n): each anchor once for a run of documents, with 2 where two documents of the run or more hold it."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, w in chunks(batch, "text", 4 * CHUNK_BYTES):
            at = anchors(w)
            h = grams(w.hash, ANCHOR, at)
            order = np.argsort(h, kind="stable")
            first, n = held_twice([h[order]], w.doc()[at][order])
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[order][first])), pa.array(n.astype(np.int8))], ["h", "n"])

    return arrow_map(documents, each, "h long, n byte")


def shared_anchors(documents: DataFrame) -> DataFrame:
    """Anchors of two documents or more."""
    return anchor_rows(documents).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def anchor_places(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, ats): where in each document shared anchors start.  Rows that share a doc_id get the places of all of them."""

    def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column("doc_id"), np.int64)
        for i, _, w in chunks(batch, "text"):
            at = anchors(w)
            doc = w.doc()[at]
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams(w.hash, ANCHOR, at))), pa.array(ids[i + doc]), pa.array((at - w.first[doc]).astype(np.int32))], ["h", "id", "at"])

    return arrow_map(documents, places, "h long, id long, at int").join(shared, "h", "left_semi").groupBy("id").agg(F.collect_set("at").alias("ats"))


def window_starts(w: Words, near: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at positions ``near`` within their first seven places."""
    start = np.unique(near[:, None] - np.arange(PERIOD)[None, :])
    start = start[start >= 0]
    return start[w.left()[start] >= WINDOW]


def listed(w: Words, lists: pa.Array) -> np.ndarray:
    """Positions in the word arrays of places that are listed for each document; those beyond its words are of another row with its id."""
    n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    doc, place = np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten(), np.int64)
    own = place < w.counts()[doc]
    return w.first[doc[own]] + place[own]


def windows(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row, place) of every window near a shared anchor, with 96 bits of hash."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = np.asarray(batch.column("doc_id"), np.int64), np.asarray(batch.column("row"), np.int64)
        for i, j, w in chunks(batch, "text"):
            start = window_starts(w, listed(w, batch.column("ats").slice(i, j - i)))
            h2 = (grams(w.hash, WINDOW, start, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            doc = w.doc()[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(grams(w.hash, WINDOW, start))), pa.array(h2), pa.array(ids[i + doc]), pa.array(rows[i + doc]), pa.array((start - w.first[doc]).astype(np.int32))],
                ["h1", "h2", "doc_id", "row", "place"],
            )

    near = documents.join(places.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("doc_id", "row", "text", "ats")
    return arrow_map(near, each, "h1 long, h2 int, doc_id long, row long, place int")


def removed_places(documents: DataFrame) -> DataFrame:
    """(id, of, places): starts of the windows of the row ``of`` that also start in a document with a smaller id."""
    shared = stored(shared_anchors(documents), "anchors")
    places = stored(anchor_places(documents, shared), "places")
    discard(shared)
    found = stored(windows(documents, places), "windows")
    discard(places)
    owners = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    owners = stored(owners.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "low"), "owners")
    repeated = found.join(owners, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).where("doc_id > low")
    gone = stored(repeated.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("of")).agg(F.collect_set("place").alias("places")), "gone")
    discard(found, owners)
    return gone


def deduplicated(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space.

    A word is removed where a run of 13 words that covers it also starts in a document with a smaller doc_id, judged on
    the input.  A null or empty text has no words.  Rows that share a doc_id are judged each by its own text; none of them is
    smaller than another, so they don't remove each other's words.  Rows without doc_id keep all their words.
    """
    documents = id_and_text(documents).withColumn("row", F.xxhash64("text"))
    places = removed_places(documents.where("doc_id is not null"))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, w in chunks(batch, "text"):
            start = listed(w, batch.column("places").slice(i, j - i))
            gone = covered(len(w.start), start, WINDOW) if len(start) else np.zeros(len(w.start), bool)
            counts = w.counts()
            total = np.r_[0, np.cumsum(gone)]
            removed = total[w.first[1:]] - total[w.first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), _kept(w, ~gone)],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = documents.join(places.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("of")), "left")
    return arrow_map(joined.select("doc_id", "text", "places"), each, "doc_id long, n_words long, n_removed long, kept string")


def _kept(w: Words, stay: np.ndarray) -> pa.Array:
    """The staying words of each document joined by one space, as a string column."""
    lo, hi = w.start[stay], w.end[stay]
    size = hi - lo
    doc = w.doc()[stay]
    n_docs = len(w.first) - 1
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    wide = size + ~last
    out = np.full(int(wide.sum()), 0x20, np.uint8)
    to = np.cumsum(wide) - wide
    index = np.repeat(lo - to, size)
    place = np.arange(int(size.sum())) + np.repeat(to - (np.cumsum(size) - size), size)
    out[place] = w.data[place + index]
    ends = np.zeros(n_docs + 1, np.int64)
    np.add.at(ends, doc + 1, wide)
    return pa.Array.from_buffers(pa.string(), n_docs, [None, pa.py_buffer(np.cumsum(ends).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of documents, as ``deduplicated`` has them."""
    return deduplicated(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict) -> dict:
    """The same by plain Python, for tests: doc -> (n_words, n_removed, digest)."""
    import re

    cut = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    least: dict = {}
    for k, w in cut.items():
        for i in range(len(w) - WINDOW + 1):
            x = tuple(w[i : i + WINDOW])
            least[x] = min(k, least.get(x, k))
    out = {}
    for k, w in cut.items():
        gone = {j for i in range(len(w) - WINDOW + 1) if least[tuple(w[i : i + WINDOW])] < k for j in range(i, i + WINDOW)}
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out
