"""Periodic runs: stretches of words that repeat with one period at least twice.

A run is a stretch with smallest period q and a length of at least max(``LEAST``, 2 q) that can't be extended with period q.  For each power of two B the
words of a document are cut into aligned blocks of B.  The matching part of a run with a period that goes with B holds a whole
aligned block, which occurs again q words later.  So the blocks are the keys (sequences of word numbers) of an Aho-Corasick automaton that is run
over the document, occurrences at a distance that goes with B seed an exact extension to both sides, and stretches that are long enough and have
no smaller period are runs.  Periods 2B - 1 to 4B - 2 go with B; as a run has 12 words at least, B = 4 also serves periods 1 to 5, and period
6 has B = 2.

Only blocks that occur twice become keys, and documents without a block of four that occurs twice (told by hashes of a whole batch) need no
automaton.  A seed inside a known run whose period divides its distance would find that run again and is left out.

Every document is worked on where it is read; nothing is shuffled.  Words are told apart by 64-bit hashes.  Defined cases: a null, empty or blank text
has no words and no runs; a row without doc_id keeps its words as they are (``planted``); repeated rows are reported each by itself; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .support import id_and_text, in_batches
from .tokens import Words, buffers, grams, mix, runs

#: Words of the shortest run.
LEAST = 12
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document of n words, or None where all stay; one document of ten repeats a part of itself."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + np.arange(n - a) % p
    return place


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _matching(code: np.ndarray, b: int, d: int, size: int) -> tuple[int, int]:
    """The widest range around b..b+size-1 in which each word equals the one d behind it."""
    n = len(code)
    high, step = b + size, 32
    while high + d < n:
        m = min(step, n - d - high)
        bad = np.flatnonzero(code[high : high + m] != code[high + d : high + d + m])
        if len(bad):
            high += int(bad[0])
            break
        high, step = high + m, 2 * step
    low, step = b, 32
    while low:
        m = min(step, low)
        bad = np.flatnonzero(code[low - m : low] != code[low - m + d : low + d])
        if len(bad):
            low += int(bad[-1]) + 1 - m
            break
        low, step = low - m, 2 * step
    return low, high


def _distances(size: int) -> tuple[int, int]:
    """Least and greatest period that blocks of ``size`` words look for."""
    return {2: (6, 6), 4: (1, 14)}.get(size, (2 * size - 1, 4 * size - 2))


class _Known:
    """Runs found so far, and for each word the one that covers it and ends last."""

    def __init__(self, n: int):
        self.runs: dict[tuple[int, int], int] = {}
        self.end, self.period = np.zeros(n, np.int64), np.ones(n, np.int64)

    def add(self, start: int, period: int, length: int) -> None:
        self.runs[start, period] = length
        part = slice(start, start + length)
        later = self.end[part] < start + length
        self.end[part][later] = start + length
        self.period[part][later] = period


def seeds(code: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(b, d): aligned blocks b that occur again d words behind, for the distances that go with ``size``; None where no block occurs twice."""
    every = grams(hashes, size)
    aligned = every[::size]
    ordered = np.sort(every)
    twice = np.searchsorted(ordered, aligned, "right") - np.searchsorted(ordered, aligned, "left") > 1
    if not twice.any():
        return None
    low, high = _distances(size)
    words = code.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys, number = np.full(len(aligned), -1, np.int64), {}
    for j in np.flatnonzero(twice).tolist():
        key = tuple(words[j * size : (j + 1) * size])
        known = number.setdefault(key, len(number))
        if known == len(number) - 1:
            automaton.add_word(key, known)
        keys[j] = known
    automaton.make_automaton()
    met = np.array(list(automaton.iter(tuple(words))), np.int64).reshape(-1, 2)
    at, key = met[:, 0] - size + 1, met[:, 1]
    found = []
    for t in range((high - low) // size + 1):
        j = (at - low) // size - t
        d = at - j * size
        good = (j >= 0) & (d >= low) & (d <= high)
        if size == 4:
            good &= d != 6
        good[good] &= keys[j[good]] == key[good]
        found.append(np.stack([j[good] * size, d[good]]))
    b, d = np.concatenate(found, axis=1)
    return b, d


def runs_of(code: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document, by start and period; code: a number for each word, equal for equal words."""
    n = len(code)
    known = _Known(n)
    size = 2
    while 2 * _distances(size)[0] <= n or size == 2:
        found = seeds(code, hashes, size) if n >= LEAST else None
        if found is None:
            break
        b, d = found
        again = (known.end[b] >= b + d + size) & (d % known.period[b] == 0)
        b, d = b[~again], d[~again]
        order = np.lexsort((b, d))
        b, d = b[order], d[order]
        i = 0
        while i < len(b):
            at, distance = int(b[i]), int(d[i])
            low, high = _matching(code, at, distance, size)
            length = high - low + distance
            if length >= max(LEAST, 2 * distance) and (low, distance) not in known.runs:
                parts = (distance // p for p in _primes(distance))
                if not any((code[low : low + 2 * distance - q] == code[low + q : low + 2 * distance]).all() for q in parts):
                    known.add(low, distance, length)
            last = int(np.searchsorted(d, distance, "right"))
            i += int(np.searchsorted(b[i:last], high)) or 1
        size *= 2
    return sorted((start, length, period) for (start, period), length in known.runs.items())


def suspects(hashes: np.ndarray, doc: np.ndarray, left: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Which of n documents hold a block of four that occurs twice, or an aligned block of two that occurs again six words behind."""
    out = np.zeros(n, bool)
    at = np.flatnonzero(left >= 4)
    own = mix(grams(hashes, 4, at) ^ mix(doc[at].astype(np.uint64)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    out[doc[at[order[1:][same]]]] = True
    at = np.flatnonzero((left >= 8) & (place % 2 == 0))
    pair = grams(hashes, 2)
    out[doc[at[pair[at] == pair[at + 6]]]] = True
    return out


def _kept(raw: bytes, n: int, found: list[tuple[int, int, int]], place: np.ndarray | None) -> bytes:
    words = raw.split()
    if place is not None:
        words = [words[i] for i in place.tolist()]
    if found:
        keep = np.ones(n, bool)
        for start, length, period in found:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


_COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def found(documents: DataFrame, plant: bool = False, whole: bool = True) -> DataFrame:
    """Runs of every row of documents, the text without their repeats, and digests of both.

    plant: let every tenth document repeat a part of itself first.  whole: hand on runs and text, not the digests alone.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 6 + [_RUN, pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in runs(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "space", False)
                counts, hashes, rows = w.counts(), w.hash, []
                places = [planted(ids[i + k], c) if plant else None for k, c in enumerate(counts.tolist())]
                for k, place in enumerate(places):
                    if place is not None:
                        hashes[w.first[k] : w.first[k + 1]] = hashes[w.first[k] + place]
                doc = w.doc()
                often = suspects(hashes, doc, w.left(), np.arange(len(doc)) - w.first[:-1][doc], len(counts)).tolist()
                for k, n in enumerate(counts.tolist()):
                    of = []
                    if often[k] and n >= LEAST:
                        own = hashes[w.first[k] : w.first[k + 1]]
                        of = runs_of(np.unique(own, return_inverse=True)[1], own)
                    text = _kept(data[offsets[i + k] : offsets[i + k + 1]].tobytes(), n, of, places[k])
                    start, length, period = max(of, key=lambda r: (r[1], -r[0], -r[2])) if of else (None,) * 3
                    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(of, key=lambda r: (r[0], r[2])))
                    rows.append((
                        ids[i + k], len(of), start, length, period, None if period is None else 1000 * length // period,
                        [{"start": s, "length": m, "period": q} for s, m, q in of] if whole else None, text.decode() if whole else None,
                        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
                    ))
                yield batch_of(rows)

    return in_batches(id_and_text(documents)).mapInArrow(run, _COLUMNS)


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row of documents, with parts repeated."""
    return found(documents, plant=True, whole=False).drop("runs", "collapsed")


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """All runs by looking at every period, for tests."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(LEAST, 2 * q) and not any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def brute_force(documents: list[tuple]) -> list[tuple]:
    """The rows of ``report`` by plain Python, for tests."""
    rows = []
    for doc_id, text in documents:
        words = _TOKEN.findall((text or "").encode())
        n = len(words)
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        of = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        gone = {i for s, m, q in of for i in range(s + q, s + m)}
        best = min(of, key=lambda r: (-r[1], r[0], r[2]), default=None)
        rows.append((
            doc_id, len(of), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in of).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        ))
    return rows
