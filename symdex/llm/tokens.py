"""Vectorised words and word n-grams over Arrow string columns.

Executors receive Arrow record batches; the functions here look at the UTF-8 bytes of a whole batch at once, so that
no Python code runs per word.  A word is hashed with a random polynomial over its bytes (modulo 2**64), an n-gram with
two polynomials over the hashes of its words, which gives 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; one document is never cut, whatever its length.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _space() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def _alnum() -> np.ndarray:
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x80:] = True
    return word


def _values(lower: bool) -> np.ndarray:
    own = np.arange(256, dtype=np.uint64)
    if lower:
        own[0x41:0x5B] += np.uint64(0x20)
    return mix(own + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Word characters (after lower-casing A-Z) by rule: everything but white space, or ASCII letters, digits and non-ASCII.
WORD_BYTES = {"space": _space(), "alnum": _alnum()}
_VALUES = {lower: _values(lower) for lower in (False, True)}
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_STEP = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = -(-n // _STEP) * _STEP
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 8 * _STEP:  # what a text beyond 2 MB needs isn't kept
            _POWERS[base] = have
    return have


def prefix_sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


class Words:
    """Words of a run of documents: hash, first byte, end byte, and per document the range of its words.

    offsets: n_docs + 1 positions in ``data``; first: n_docs + 1 positions in the word arrays.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: str, lower: bool):
        self.data, self.offsets = data, offsets
        inside = WORD_BYTES[rule][data if not (lower and rule == "alnum") else _LOWER[data]]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        value = _VALUES[lower][data]
        up, down = powers(_BASES[0], n + 1)
        sums = prefix_sums(value * up[:n])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + length * _M2)
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def left(self) -> np.ndarray:
        """How many words of its document there are from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def grams(hashes: np.ndarray, k: int, at: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hash of the k words from each position (of ``at``, or of all that k words follow); which: 0 or 1, for 128 bits."""
    up, down = powers(_BASES[1 + which], len(hashes) + 1)
    sums = prefix_sums(hashes * up[: len(hashes)])
    if at is None:
        at = np.arange(max(0, len(hashes) - k + 1))
    return mix((sums[at + k] - sums[at]) * down[at] + np.uint64(k))


def span_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the words start..end-1 for arrays of ranges; equal to ``grams`` where the lengths are."""
    up, down = powers(_BASES[1 + which], len(hashes) + 1)
    sums = prefix_sums(hashes * up[: len(hashes)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the ranges start..end-1, one after the other."""
    size = end - start
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def string_array(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """A string column of bytes that stand one after the other."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def runs(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes together (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(column: pa.Array, rule: str, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first document, end document, their words) over a column, a bounded number of bytes at a time."""
    data, offsets = buffers(column)
    for i, j in runs(offsets):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule, lower)


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges start..start+length-1."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
