"""Resampling of documents by their likeness to a target, over hashed word n-grams.

Features are runs of 1 to ``GRAM`` consecutive words, and a feature's bucket is the crc32 of its bytes modulo ``BUCKETS``.  Counts of all source texts and of
all target texts give each bucket a gain; a document's weight is the floored mean of its features' gains.  Weight plus a Gumbel number that
depends on doc_id alone is the score, and the highest scores among documents of ``LEAST_WORDS`` words are drawn.

A text of more than ``CHUNK`` bytes is split at word boundaries.  A chunk owns the features that start in its own words and carries the GRAM - 1 words
behind them, so each feature is counted once; chunks are dealt evenly over the tasks, and their counts and gains are summed by document.  What is
broadcast are the gains, one number for each bucket.

Defined cases: a null or empty text has no features, weight 0 and no place; rows that share a doc_id are judged each by itself and rank behind each other;
a row without doc_id has no score and no place; an empty table gives an empty result, and an empty target lets gains follow the source alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.operators.numbering import dense

from .support import id_and_text, in_batches, stored
from .tokens import buffers, gathered, runs, string_array

GRAM, BUCKETS = 2, 10_000
#: Bytes of a text that are looked at as one chunk.
CHUNK = 1 << 16
#: Documents of fewer words aren't drawn; so many percent of the others are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Words of more bytes are hashed one by one.
_LONG = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _byte_table() -> np.ndarray:
    """crc of each byte, by the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_T = _byte_table()


def _behind() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a crc becomes when n zero bytes follow."""
    out = np.empty((_LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(_LONG):
        out[n + 1] = _T[out[n] & np.uint32(0xFF)] ^ (out[n] >> np.uint32(8))
    return out


_BEHIND = _behind()


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of each word, all words a byte at a time."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    s, n = start[order], size[order]
    state = np.full(len(s), 0xFFFFFFFF, np.uint32)
    edge = np.searchsorted(-np.minimum(n, _LONG + 1), -np.arange(1, _LONG + 1), "right")  # how many words have so many bytes
    for j, k in enumerate(edge.tolist()):
        if not k:
            break
        state[:k] = _T[(state[:k] ^ data[s[:k] + j]) & np.uint32(0xFF)] ^ (state[:k] >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def joined_crcs(left: np.ndarray, right: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each left text, a space and a word, from their crcs; start, end: the word's bytes."""
    state = ~left
    state = ~(_T[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)))
    size = end - start
    n = np.minimum(size, _LONG)
    out = right.copy()
    for k in range(4):
        out ^= _BEHIND[n, k, (state >> np.uint32(8 * k)) & np.uint32(0xFF)]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(state[i]))
    return out


class Features:
    """Features of a run of texts: bucket and text of each one, and the number of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None):
        """own: how many words of each text its features may start in; all where it isn't given."""
        data = _LOWER[data]
        inside = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(self.start, offsets)
        counts = np.diff(first)
        self.n_words = counts if own is None else own
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(self.start)) - first[:-1][doc]
        starts = np.ones(len(doc), bool) if own is None else place < own[doc]
        left = counts[doc] - place
        word = word_crcs(data, self.start, self.end)
        buckets, docs = [], []
        crc = word
        for n in range(1, GRAM + 1):
            at = np.flatnonzero(starts & (left >= n))
            if n > 1:
                whole = np.flatnonzero(left >= n)
                grown = np.zeros(len(doc), np.uint32)
                last = whole + n - 1
                grown[whole] = joined_crcs(crc[whole], word[last], data, self.start[last], self.end[last])
                crc = grown
            buckets.append(crc[at] % np.uint32(BUCKETS))
            docs.append(doc[at])
        self.bucket, self.doc = np.concatenate(buckets).astype(np.int64), np.concatenate(docs)

    def counts(self) -> np.ndarray:
        return np.bincount(self.bucket, minlength=BUCKETS)

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of features, sum of their gains) of each text."""
        n = len(self.n_words)
        total = np.zeros(n, np.int64)
        np.add.at(total, self.doc, gains[self.bucket])
        return np.bincount(self.doc, minlength=n), total


def chunks(long: DataFrame) -> DataFrame:
    """(row, doc_id, chunk, text, own): long texts in chunks of about ``CHUNK`` bytes, the same words in the same order.

    own: the words that are the chunk's own; up to GRAM - 1 words of the next chunks follow them.  A word is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                inside = _WORD[_LOWER[own]]
                step = np.diff(np.r_[False, inside, False].astype(np.int8))
                start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                cut = np.unique(np.searchsorted(start, np.arange(0, len(own), CHUNK)))
                cut = np.r_[cut[cut < len(start)], len(start)]
                low, high = cut[:-1], cut[1:]
                if not len(low):  # a text without words keeps one chunk
                    low = high = np.zeros(1, np.int64)
                    a = b = np.zeros(1, np.int64)
                else:
                    a, b = start[low], end[np.minimum(high + GRAM - 1, len(start)) - 1]
                k = len(low)
                for j in range(0, k, 64):
                    part = slice(j, j + 64)
                    m = len(low[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("row")[i].as_py()] * m, pa.int64()), pa.array([batch.column("doc_id")[i].as_py()] * m, pa.int64()), pa.array(np.arange(j, j + m), pa.int64()), string_array(gathered(own, a[part], b[part]), b[part] - a[part]), pa.array(high[part] - low[part], pa.int64())],
                        ["row", "doc_id", "chunk", "text", "own"],
                    )

    rows = in_batches(long.withColumn("row", F.monotonically_increasing_id())).mapInArrow(run, "row long, doc_id long, chunk long, text string, own long")
    return rows.repartition("row", "chunk")


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Features]]:
    data, offsets = buffers(batch.column("text"))
    own = np.asarray(batch.column("own"), np.int64) if "own" in batch.schema.names else None
    for i, j in runs(offsets):
        yield i, j, Features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], None if own is None else own[i:j])


def counted(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, f in _features(batch):
                total += f.counts()
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    return in_batches(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def weighed(texts: DataFrame, gains: np.ndarray) -> DataFrame:
    """The ids of texts with n_words, n_features and gain (the sum over features)."""
    keys = [c for c in ("row", "doc_id") if c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, f in _features(batch):
                n, total = f.sums(gains)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keys), pa.array(f.n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], [*keys, "n_words", "n_features", "gain"])

    return in_batches(texts).mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "n_words", "n_features", "gain"]))


def gains_of(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Gain of each bucket from the counts of both sides."""
    total_s, total_t = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (total_s + BUCKETS) / ((source.get(b, 0) + 1) * (total_t + BUCKETS)))) for b in range(BUCKETS)], np.int64)


def split(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts of one chunk, chunks of the others, written)."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return texts.where(size <= CHUNK), stored(chunks(texts.where(size > CHUNK)), "chunks")


def luck(doc_id: Column) -> Column:
    """A Gumbel number in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of documents."""
    short, long = split(id_and_text(documents))
    wanted, wanted_long = split(target.select(F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("doc_id")))
    count = lambda *sides: {r["bucket"]: r["n"] for r in counted(sides[0]).unionByName(counted(sides[1])).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    gains = gains_of(count(short, long), count(wanted, wanted_long))
    of_long = weighed(long, gains).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    rows = weighed(short, gains).unionByName(of_long.drop("row"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"))


def report(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of documents; rank is null where a document isn't drawn."""
    scored = weights(documents, target).withColumn("score", F.col("weight") + luck(F.col("doc_id")))
    scored = stored(scored, "scored").withColumn("copy", F.monotonically_increasing_id())
    able = scored.where(f"n_words >= {LEAST_WORDS} and doc_id is not null")
    draw = able.count() * PERCENT // 100
    placed = dense(able, [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("copy")], "place")
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(f"n_words < {LEAST_WORDS} or doc_id is null").select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(rest)


def drawn(documents: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn rows of documents, all their columns; documents that share an id are drawn together if one of them is."""
    ids = report(documents, target).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return documents.join(ids, F.col("doc_id") == F.col("__drawn"), "left_semi")


def brute_force(documents: list[tuple], target: list[str | None]) -> list[tuple]:
    """The same rows by plain Python, for tests."""

    def features(text: str | None) -> tuple[int, list[int]]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % BUCKETS for n in range(1, GRAM + 1) for i in range(len(w) - n + 1)]

    own = [(d, *features(t)) for d, t in documents]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gains = gains_of(s, t).tolist()
    rows = []
    for d, n, f in own:
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{SEED}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= LEAST_WORDS and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for i, r in enumerate(able[: PERCENT * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]
