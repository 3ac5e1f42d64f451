"""Document likelihood under a subword lattice.

A word is a lattice of all its segmentations into pieces of an existing vocabulary.  The vocabulary's own scores weight the pieces first;
expected piece counts over the training words (forward and backward sums) then give the weights of the model.  The score
of a document is the log10 probability of its words, each summed over all segmentations by a forward recursion in log space, and of its end.

Words are merged before any shuffle: a run of documents (``RUN_BYTES`` of text) lists each distinct word once, and so a frequent
word reaches the shuffle once for each run.  Word statistics return to the runs by a join on the word, and a run's rows, bounded by
its text, are brought together to score its documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, fold, id_and_text, in_batches, stored
from .tokens import Words, buffers, gathered, mix, powers, runs, string_array

#: Bytes of text of one run of documents, and of one look at them.
RUN_BYTES, LOOK_BYTES = 16 << 20, 1 << 20
#: Rounds of expected counts, and what each piece has besides them.
ROUNDS, SMOOTH = 1, 0.1
#: Pieces beyond so many bytes are looked up only where their beginning of that length is one of a longer piece.
SHORT = 12
#: Words of up to so many bytes are taken together; longer ones one by one.
TOGETHER = 64
SPACE = "▁".encode()
_BASE = 0x9E3779B97F4A7C15

RUN = "run long, place int, word string, n long, docs binary"


def packed(doc_ids: pa.Array, held: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """Documents of a run: ids, folds, numbers of words, and the place of each word in the run's list."""
    ids = np.asarray(doc_ids.fill_null(0), np.int64)
    parts = [np.array([len(ids)], "<i8"), ids.astype("<i8"), np.asarray(doc_ids.is_valid(), np.uint8), held.astype(np.uint8), lengths.astype("<u4"), codes.astype("<u4")]
    return zlib.compress(b"".join(x.tobytes() for x in parts), 1)


def unpacked(docs: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(docs)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, at = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n
    known, held = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, n, at + n)
    lengths = np.frombuffer(raw, "<u4", n, at + 2 * n).astype(np.int64)
    return pa.array(ids, pa.int64(), mask=known == 0), held == 1, lengths, np.frombuffer(raw, "<u4", -1, at + 6 * n)


def word_runs(documents: DataFrame) -> DataFrame:
    """For each run of documents its distinct words (place, word, n: occurrences in training documents), and one row with docs.

    That row's n is the number of the run's training documents.
    """

    def one(ids: pa.Array, held: np.ndarray, data: np.ndarray, offsets: np.ndarray, number: int) -> pa.RecordBatch:
        hashes, first, texts, sizes, lengths = [], [], [], [], []
        for i, j in runs(offsets, LOOK_BYTES):
            part = data[offsets[i] : offsets[j]]
            w = Words(part, offsets[i : j + 1] - offsets[i], "space", True)
            u, at = np.unique(w.hash, return_index=True)
            low = part.copy()
            low[(low >= 0x41) & (low <= 0x5A)] += 0x20
            first.append(u)
            texts.append(gathered(low, w.start[at], w.end[at]))
            sizes.append(w.end[at] - w.start[at])
            hashes.append(w.hash)
            lengths.append(w.counts())
        h, n = np.concatenate(hashes), np.concatenate(lengths)
        known, at = np.unique(np.concatenate(first), return_index=True)
        size = np.concatenate(sizes)
        end = np.cumsum(size)
        words = string_array(gathered(np.concatenate(texts), (end - size)[at], end[at]), size[at])
        code = np.searchsorted(known, h)
        counts = np.bincount(code, np.repeat(~held, n), len(known)).astype(np.int64)
        m = len(known)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m + 1, number)),
                pa.array(np.arange(m + 1, dtype=np.int32), mask=np.arange(m + 1) == m),
                pa.concat_arrays([words, pa.nulls(1, pa.string())]),
                pa.array(np.r_[counts, np.count_nonzero(~held)]),
                pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([packed(ids, held, n, code)], pa.binary())]),
            ],
            [x.split()[0] for x in RUN.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            held = np.asarray(batch.column("held_out").fill_null(False))
            for a, b in runs(offsets, RUN_BYTES):
                yield one(batch.column("doc_id").slice(a, b - a), held[a:b], data, offsets[a : b + 1], number)
                number += 1

    source = id_and_text(documents).withColumn("held_out", F.coalesce(fold("doc_id") == 1, F.lit(False)))
    return in_batches(source, str(RUN_BYTES)).mapInArrow(run, RUN)


class Pieces:
    """Byte strings of the vocabulary with log weights; every single byte is a piece."""

    def __init__(self, strings: list[bytes], weights: np.ndarray):
        self.strings = strings
        self.log = np.log(weights / weights.sum())
        self.end = math.log(1e-3)
        raw = np.frombuffer(b"".join(strings), np.uint8)
        end = np.cumsum([len(s) for s in strings])
        start = end - np.array([len(s) for s in strings])
        up, down = powers(_BASE, max(len(raw), TOGETHER) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True
        size = end - start
        self.sizes = np.unique(size).tolist()
        long = start[size > SHORT]
        self.beginnings = np.unique(mix((sums[long + SHORT] - sums[long]) * down[long] + np.uint64(SHORT)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, piece) of the hashes that are pieces."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        hit = self.hash[place] == h[at]
        return at[hit], self.order[place[hit]]

    def begins(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes of ``SHORT`` bytes with which a longer piece begins."""
        if not len(self.beginnings):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.beginnings, h), len(self.beginnings) - 1)
        return np.flatnonzero(self.beginnings[place] == h)

    @staticmethod
    def load(path: str) -> Pieces:
        """From a public piece model: the better a piece's score (its rank, negated), the larger its first weight."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            found[piece.encode()] = 1 / (10 - max(model.get_score(i), -1e6))
        return Pieces(list(found), np.array(list(found.values())))


def _edges(words: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, words, pieces) of every piece in words of one length (a matrix of bytes), ascending by start."""
    n = words.shape[1]
    up, down = powers(_BASE, n + 1)
    sums = np.zeros((n + 1, len(words)), np.uint64)
    np.cumsum((words.T.astype(np.uint64) + np.uint64(1)) * up[:n, None], axis=0, out=sums[1:])
    for start in range(n):
        for size in pieces.sizes:
            if size > min(SHORT, n - start):
                break
            at, piece = pieces.find(mix((sums[start + size] - sums[start]) * down[start] + np.uint64(size)))
            if len(at):
                yield start, start + size, at, piece
        if n - start > SHORT:
            deep = pieces.begins(mix((sums[start + SHORT] - sums[start]) * down[start] + np.uint64(SHORT)))
            for size in pieces.sizes if len(deep) else ():
                if SHORT < size <= n - start:
                    at, piece = pieces.find(mix((sums[start + size, deep] - sums[start, deep]) * down[start] + np.uint64(size)))
                    if len(at):
                        yield start, start + size, deep[at], piece


def marginal(words: np.ndarray, pieces: Pieces, expect: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log probability of words of one length over all segmentations.

    expect: (weight of each word, expected counts by piece, which are added to).
    """
    n = words.shape[1]
    if n > TOGETHER:
        return np.array([_long(row, pieces, (expect[0][i], expect[1]) if expect else None) for i, row in enumerate(words)])
    forward = np.full((n + 1, len(words)), -np.inf)
    forward[0] = 0
    edges = []
    for start, stop, at, piece in _edges(words, pieces):
        forward[stop, at] = np.logaddexp(forward[stop, at], forward[start, at] + pieces.log[piece])
        if expect:
            edges.append((start, stop, at, piece))
    if expect:
        weight, counts = expect
        backward = np.full((n + 1, len(words)), -np.inf)
        backward[n] = 0
        for start, stop, at, piece in reversed(edges):
            backward[start, at] = np.logaddexp(backward[start, at], backward[stop, at] + pieces.log[piece])
        for start, stop, at, piece in edges:
            share = np.exp(forward[start, at] + pieces.log[piece] + backward[stop, at] - forward[n, at])
            counts += np.bincount(piece, share * weight[at], len(counts))
    return forward[n]


def _long(word: np.ndarray, pieces: Pieces, expect: tuple[float, np.ndarray] | None) -> float:
    """The same for one long word, with pieces of all places looked up together."""
    n = len(word)
    up, down = powers(_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((word.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    found = []
    for size in (x for x in pieces.sizes if x <= n):
        at, piece = pieces.find(mix((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size] + np.uint64(size)))
        found.append((at, at + size, piece))
    start, stop, piece = (np.concatenate(x) for x in zip(*found, strict=True))

    def sweep(source: np.ndarray, target: np.ndarray, first: int) -> np.ndarray:
        order = np.argsort(target if first == 0 else -target, kind="stable")
        out = [-math.inf] * (n + 1)
        out[first] = 0.0
        for a, b, p in zip(source[order].tolist(), target[order].tolist(), pieces.log[piece[order]].tolist(), strict=True):
            x, y = out[b], out[a] + p
            if y > x:
                x, y = y, x
            out[b] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x
        return np.array(out)

    forward = sweep(start, stop, 0)
    if expect:
        backward = sweep(stop, start, n)
        expect[1][:] += np.bincount(piece, expect[0] * np.exp(forward[start] + pieces.log[piece] + backward[stop] - forward[n]), len(expect[1]))
    return float(forward[n])


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, bytes) of words with the space mark, a length at a time."""
    data, offsets = buffers(words)
    size = np.diff(offsets)
    mark = np.frombuffer(SPACE, np.uint8)
    for n in np.unique(size).tolist():
        index = np.flatnonzero(size == n)
        step = 16384 if n <= TOGETHER else max(1, (1 << 16) // n)
        for i in range(0, len(index), step):
            part = index[i : i + step]
            yield part, np.hstack([np.tile(mark, (len(part), 1)), data[offsets[part][:, None] + np.arange(n)[None, :]]])


def retrained(words: DataFrame, pieces: Pieces, documents: int) -> Pieces:
    """Weights from expected counts over the training words; the end of a document is counted besides the pieces."""
    given = words.sparkSession.sparkContext.broadcast(pieces)
    n = len(pieces.strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n)
        for batch in batches:
            weight = np.asarray(batch.column("c"), np.float64)
            for index, matrix in by_length(batch.column("word")):
                marginal(matrix, given.value, (weight[index], counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["piece", "n"])

    found = in_batches(words.where("c > 0").select("word", "c")).mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.full(n, SMOOTH)
    for r in found:
        counts[r["piece"]] += r["n"]
    out = Pieces(pieces.strings, counts)
    total = counts.sum() + documents + SMOOTH
    out.log = np.log(counts / total)
    out.end = math.log((documents + SMOOTH) / total)
    return out


def word_scores(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, c, p): p is the log10 probability of the word."""
    given = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for index, matrix in by_length(batch.column("word")):
                p[index] = marginal(matrix, given.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p)], ["word", "c", "p"])

    return in_batches(words.select("word", "c")).mapInArrow(run, "word string, c long, p double")


def counted(rows: DataFrame) -> DataFrame:
    """(word, c): every word of the runs with its training count."""
    return rows.where("docs is null").groupBy("word").agg(F.sum("n").alias("c"))


def trained(words: DataFrame, documents: int, path: str) -> Pieces:
    """Pieces of a vocabulary with weights from the training words of a table (word, c)."""
    pieces = Pieces.load(path)
    for _ in range(ROUNDS):
        pieces = retrained(words, pieces, documents)
    return pieces


def report(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Training documents are those whose fold is not 1, and those without doc_id.  A null or empty text is the end alone.  Repeated rows count
    and are scored each by itself.  Without any training document, counts are 0 and pieces keep the smoothed weights.
    """
    rows = stored(word_runs(documents), "runs")
    words = stored(counted(rows), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train = rows.where("docs is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    all_tokens, distinct = total["n"] + train, total["v"] + (train > 0)
    pieces = trained(words, train, path)
    scores = stored(word_scores(words, pieces), "scores")
    discard(words)
    below = all_tokens + 0.5 * (distinct + 1)
    end_base, end_score = math.log10((train + 0.5) / below), pieces.end / math.log(10)

    def of_run(parts: pa.Table) -> pa.Table:
        parts = parts.combine_chunks()
        listed = parts.filter(parts["docs"].is_null())
        ids, held, n, code = unpacked(parts["docs"].drop_null()[0].as_py())
        place = np.asarray(listed["place"], np.int64)
        c, p = np.zeros(len(place)), np.zeros(len(place))
        c[place], p[place] = np.asarray(listed["c"], np.float64), np.asarray(listed["p"], np.float64)
        doc = np.repeat(np.arange(len(n)), n)
        total = lambda x: np.bincount(doc, x[code], len(n))
        known = total((c > 0).astype(float)).astype(np.int64) + (train > 0)
        base = total(np.log10((c + 0.5) / below)) + end_base
        return pa.table([ids, pa.array(held), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), all_tokens, np.int64)), pa.array(base), pa.array(total(p) + end_score)], [x.split()[0] for x in out.split(", ")])

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    known = rows.where("docs is null").select("run", "place", "word").join(scores, "word").select("run", "place", "c", "p", F.lit(None).cast("binary").alias("docs"))
    heads = rows.where("docs is not null").select("run", "place", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("p"), "docs")
    return known.unionByName(heads).groupBy("run").applyInArrow(of_run, out)


def brute_force(texts: dict, path: str) -> dict:
    """score of every document by plain Python, for tests: expected counts and sums over all segmentations, word by word."""
    import re

    start = Pieces.load(path)
    weight = dict(zip(start.strings, np.exp(start.log).tolist(), strict=True))
    longest = max(map(len, weight))
    cut = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for k, t in texts.items()}
    train = [k for k in cut if zlib.crc32(str(k).encode()) % 5 != 1]

    def sums(raw: bytes, weight: dict) -> tuple[list[float], list[float], list[tuple[int, int]]]:
        spans = [(i, j) for j in range(1, len(raw) + 1) for i in range(max(0, j - longest), j) if raw[i:j] in weight]
        ahead, behind = [1.0] + [0.0] * len(raw), [0.0] * len(raw) + [1.0]
        for i, j in spans:
            ahead[j] += ahead[i] * weight[raw[i:j]]
        for i, j in sorted(spans, reverse=True):
            behind[i] += behind[j] * weight[raw[i:j]]
        return ahead, behind, spans

    counts = dict.fromkeys(weight, SMOOTH)
    for k in train:
        for w in cut[k]:
            raw = SPACE + w.encode()
            ahead, behind, spans = sums(raw, weight)
            for i, j in spans:
                counts[raw[i:j]] += ahead[i] * weight[raw[i:j]] * behind[j] / ahead[-1]
    total = math.fsum(counts.values()) + len(train) + SMOOTH
    final = {k: v / total for k, v in counts.items()}
    end = math.log10((len(train) + SMOOTH) / total)
    return {k: math.fsum(math.log10(sums(SPACE + w.encode(), final)[0][-1]) for w in ws) + end for k, ws in cut.items()}


def brute_force_marginal(word: str, pieces: Pieces) -> float:
    """log10 probability of a word by listing all its segmentations, for tests."""
    raw = SPACE + word.encode()
    log = dict(zip(pieces.strings, pieces.log, strict=True))

    def ways(i: int) -> Iterator[float]:
        if i == len(raw):
            yield 0.0
        for j in range(i + 1, len(raw) + 1):
            if raw[i:j] in log:
                for rest in ways(j):
                    yield log[raw[i:j]] + rest

    return math.log10(math.fsum(math.exp(x) for x in ways(0)))
