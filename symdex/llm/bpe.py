"""Byte-level BPE encoding and decoding.

A word's bytes form a doubly linked list of symbols; a priority queue holds the ranks of adjacent pairs with their places. The
smallest rank is merged, its new neighbours are queued, and entries whose pair has changed since are skipped.  Decoding
concatenates the byte strings of the vocabulary.  Words recur, so each worker keeps the ids of those it has seen, up to a
fixed number of them.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .support import arrow_map, id_and_text

#: Words that a worker remembers, of either kind.
REMEMBERED = 400_000

# The white space of Unicode, and the pattern that cuts words in the public byte-level scheme.
_SPACE = "\t-\r \x85" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Seen(dict):
    """ids of words as little-endian bytes, found on first use."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.find(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.special = {k: struct.pack("<I", v) for k, v in special.items()}
        self.cut = regex.compile("|".join(regex.escape(x) for x in special)) if special else None
        self.pattern = regex.compile(_PATTERN)
        wide = _SPACE.replace(" ", "").replace("\t-\r", "\t\x0b-\r")
        self.odd = regex.compile(rf"[{_SPACE}][{_SPACE}]|[{wide}]|[{_SPACE}]$|^[{_SPACE}]")
        self.pieces = _Seen(self.merge)
        self.chunks = _Seen(self.chunk)

    def merge(self, piece: str) -> bytes:
        """ids of one word."""
        data = piece.encode()
        sym = [self.first[b] for b in data]
        n = len(sym)
        get = self.merges.get
        queue = []
        for i in range(n - 1):
            if found := get(sym[i] << 32 | sym[i + 1]):
                queue.append((found[0], i))
        if queue:
            heapify(queue)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while queue:
                rank, i = heappop(queue)
                j = after[i]
                if sym[i] < 0 or j >= n or (found := get(sym[i] << 32 | sym[j])) is None or found[0] != rank:
                    continue
                sym[i], sym[j] = found[1], -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if found := get(sym[i] << 32 | sym[k]):
                        heappush(queue, (found[0], i))
                if (h := before[i]) >= 0 and (found := get(sym[h] << 32 | sym[i])):
                    heappush(queue, (found[0], h))
            sym = [x for x in sym if x >= 0]
        return struct.pack(f"<{len(sym)}I", *sym)

    def words(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def chunk(self, word: str) -> bytes:
        """ids of a word after a space, or of a line break and a word."""
        return self.words(word if word[:1] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        parts, at = [], 0
        for found in self.cut.finditer(text) if self.cut is not None else ():
            parts += [self.plain(text[at : found.start()]), self.special[found[0]]]
            at = found.end()
        return b"".join([*parts, self.plain(text[at:] if at else text)])

    def plain(self, text: str) -> bytes:
        """ids of a text between special tokens."""
        if not text:
            return b""
        if self.odd.search(text):
            return self.words(text)
        # words between single spaces and line breaks don't depend on each other
        lines = ("\n" + text).replace("\n", " \n").split(" ")
        return b"".join(map(self.chunks.__getitem__, lines[1:]))[4:]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of every text as little-endian unsigned 32-bit integers; a null text counts as empty."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return arrow_map(id_and_text(documents), each, "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c.decode(x or b"") for x in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(ids.select("doc_id", "ids"), each, "doc_id long, text string")


def checked(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): ids with digests of them and of what they decode to.

    A null text counts as empty and has no ids.  Repeated rows are encoded each by itself.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
            columns = [
                part.column("doc_id"),
                pa.array(ids, pa.binary()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(id_and_text(documents), each, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def report(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of documents, as ``checked`` has them."""
    return checked(documents, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
