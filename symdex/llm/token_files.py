"""Token-id files with Re-Pair grammars.

Texts are encoded by a public tokenizer and end with an end id.  Documents are dealt by ranges of doc_id, and each task cuts its own, in
order, into shards of about ``SHARD_IDS`` ids.  A shard is one row of the file: its documents, their lengths, and a
grammar: the most frequent pairs of neighbouring ids are replaced by nonterminals, again and again until no pair occurs ``LEAST`` times,
never across the end of a document.  With the rules the row stores the length to which each symbol expands, and how many symbols each
document has, so one document can be decoded without a look at the others.  Symbols are packed at the fewest bytes that hold them.  Rows are Parquet, so the files are committed and read by Spark
wherever they are.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .support import id_and_text, in_batches
from .tokens import buffers, runs

#: Ids of a shard (or one document, if that has more).
SHARD_IDS = 1 << 20
#: A pair becomes a rule if it occurs so often, the most frequent ones (so many at a time) first, until no pair does.
LEAST, RULES = 16, 4096
#: Pieces of text that a worker remembers, twice: those met lately, and those met before them.
REMEMBERED = 800_000
#: Bytes of text that are cut together; one document is never cut, whatever its length.
CUT_BYTES = 8 << 20
#: Words that the model gets at once.
WORDS = 4_096
_BUCKETS = 20

SHARD = "part int, start long, n_ids long, doc_ids binary, lengths binary, symbol_counts binary, rule_left binary, rule_right binary, expansions binary, width byte, symbols binary, base int"


def ends_as_letter(letter: str) -> bool:
    """Whether a letter still ends with one when it is composed and lower-cased; some become a letter and a mark."""
    return letter.isalpha() and unicodedata.normalize("NFC", letter).lower()[-1].isalpha()


_SPACE, _LETTER, _DIGIT, _OTHER, _APOSTROPHE, _ODD = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(256, _ODD, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kind[0x21:0x7F] = _OTHER
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0x27] = _APOSTROPHE
    return kind


def _opens() -> np.ndarray:
    """Whether a piece starts at a byte, by 8 * the kind of the byte before it + its own kind.

    The splitter keeps runs of letters, single digits and runs of what is neither, and nothing composes with a printable ASCII character after it. An apostrophe
    may belong to the letters after it.
    """
    opens = np.zeros(64, bool)
    opens[[8 * _SPACE + k for k in range(1, 6)]] = True
    opens[[8 * _LETTER + k for k in (_DIGIT, _OTHER, _APOSTROPHE)]] = True
    opens[[8 * _DIGIT + k for k in (_LETTER, _DIGIT, _OTHER, _APOSTROPHE)]] = True
    opens[[8 * _OTHER + k for k in (_LETTER, _DIGIT)]] = True
    opens[8 * _APOSTROPHE + _DIGIT] = True
    return opens


def _letters_of_two_bytes() -> np.ndarray:
    """Whether 256 * first byte + second byte is a letter after which a digit or mark starts a piece."""
    letter = np.zeros(1 << 16, bool)
    for c in map(chr, range(0x80, 0x800)):
        a, b = c.encode()
        letter[a << 8 | b] = ends_as_letter(c)
    return letter


_KIND, _OPENS, _TWO_BYTES = _kinds(), _opens(), _letters_of_two_bytes()


class _Words:
    """ids of texts.

    Texts are cut, many at a time, into pieces that the tokenizer encodes by themselves.  Each different piece is encoded once and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model, for words that need no normalizer and no splitter
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shown = np.zeros(256, "<u4")
        for letter, b in byte_letters().items():
            self.shown[b] = ord(letter) if b != 0x20 else b
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.late: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def model_ids(self, lower: list[bytes]) -> list[bytes]:
        """ids of words of letters alone in lower case, which neither the normalizer nor the splitter changes."""
        out = []
        for i in range(0, len(lower), WORDS):
            some = lower[i : i + WORDS]
            joined = self.shown[np.frombuffer(b" ".join(some), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:  # a vocabulary that doesn't mark the last token of a word
                out += [np.array(x.ids, "<u4").tobytes() for x in self.plain.encode_batch_fast(joined.split(" "), add_special_tokens=False)]
        return out

    def learned(self, pieces: list[bytes]) -> list[bytes]:
        """ids of pieces that aren't remembered."""
        found: list[bytes] = [b""] * len(pieces)
        at, lower = [], []
        for i, piece in enumerate(pieces):
            if piece.isalpha():  # for bytes: ASCII letters
                at.append(i)
                lower.append(piece.lower())
                continue
            text = piece.decode()
            low = text.lower()  # differs from lower-casing letter by letter for a final sigma alone
            if text.isalpha() and low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
                at.append(i)
                lower.append(low.encode())
            else:
                found[i] = self.whole(text)
        for i, ids in zip(at, self.model_ids(lower), strict=True):
            found[i] = ids
        return found

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """ids of different pieces, as little-endian bytes."""
        if len(self.late) >= REMEMBERED:
            self.late, self.before = {}, self.late
        found = list(map(self.late.get, pieces))
        for remembered in (self.before.get, None):
            at = [i for i, ids in enumerate(found) if ids is None]
            new = [pieces[i] for i in at]
            got = list(map(remembered, new)) if remembered else self.learned(new)
            for i, piece, ids in zip(at, new, got, strict=True):
                if ids is not None:
                    found[i] = ids
                    if len(piece) <= 64:
                        self.late[piece] = ids
        return found

    def encode(self, text: bytes) -> bytes:
        return self.encode_all(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()

    def encode_all(self, data: np.ndarray, offsets: np.ndarray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each text) of texts that stand one after the other, each followed by ``end``."""
        n = len(data)
        kind = np.zeros(n + 1, np.uint8)
        kind[1:] = _KIND[data]
        # a text with what may be a special token, which is found before lower-casing, isn't cut
        tokens = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        uncut = np.unique(np.searchsorted(offsets, tokens, "right") - 1)
        for k in uncut.tolist():
            kind[offsets[k] + 1 : offsets[k + 1] + 1] = _SPACE
        own = kind[1:]
        opens = _OPENS[(kind[:-1] << 3) | own]
        at = np.flatnonzero((kind[:-1] == _ODD) & (own >= _DIGIT) & (own <= _APOSTROPHE))
        at = at[at > 1]
        opens[at] = _TWO_BYTES[data[at - 2].astype(np.int64) << 8 | data[at - 1]]
        firsts = offsets[:-1][offsets[:-1] < n]
        opens[firsts] = own[firsts] != _SPACE
        inside = own != _SPACE
        edges = np.append(np.flatnonzero(opens[inside]), np.count_nonzero(inside)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data[inside])]).dictionary_encode()
        raw, places = buffers(pieces.dictionary)
        raw, places = raw.tobytes(), places.tolist()
        found = self.ids_of([raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)])
        close = np.full(len(offsets) - 1, len(found), np.int32)
        close[uncut] += np.arange(1, len(uncut) + 1, dtype=np.int32)
        found.append(end)
        found += [self.whole(data[offsets[k] : offsets[k + 1]].tobytes().decode()) + end for k in uncut.tolist()]
        stop = np.searchsorted(np.flatnonzero(opens), offsets[1:])
        codes = np.insert(pieces.indices.to_numpy(), stop, close)
        raw, places = buffers(pa.array(found, pa.binary()).take(pa.array(codes)))
        return raw.view("<u4"), np.diff(places[np.r_[0, stop + np.arange(1, len(stop) + 1)]]) // 4


@lru_cache(4)
def words(path: str) -> _Words:
    return _Words(path)


def compress(ids: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, expansions, symbols, counts): rule r replaces left[r], right[r] and is written as base + r; counts: symbols of each document.

    Each round replaces the ``RULES`` most frequent pairs at once.  A pair that falls on the bucket of another one, or is less frequent, waits for
    the next round; the rounds end when no pair is frequent.
    """
    seq = ids.astype(np.int64)
    ends = np.zeros(len(seq), bool)
    ends[np.cumsum(lengths)[lengths > 0] - 1] = True
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    weight = [np.zeros(0, np.int64)]
    top = base
    bucket = lambda key: ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)).astype(np.int64)
    while len(seq) > 1:
        key = (seq[:-1] << 32) | seq[1:]
        hashed = bucket(key)
        often = np.bincount(hashed, minlength=1 << _BUCKETS) >= LEAST  # pairs across ends included, so nothing frequent is missed
        at = np.flatnonzero(often[hashed] & ~ends[:-1])
        found, near = key[at], hashed[at]
        pairs, count = np.unique(found, return_counts=True)
        keep = np.flatnonzero(count >= LEAST)
        if not len(keep):
            break
        keep = keep[np.lexsort((pairs[keep], -count[keep]))[:RULES]]
        pairs = pairs[np.sort(keep[np.unique(bucket(pairs[keep]), return_index=True)[1]])]
        rule_of = np.full(1 << _BUCKETS, -1, np.int32)
        rule_of[bucket(pairs)] = np.arange(len(pairs))
        place = rule_of[near]
        maybe = np.flatnonzero(place >= 0)
        maybe = maybe[pairs[place[maybe]] == found[maybe]]
        at, place = at[maybe], place[maybe]
        # of pairs that overlap in a run, every second one from the left
        new = np.r_[True, np.diff(at) > 1]
        within = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        at, place = at[within % 2 == 0], place[within % 2 == 0]
        seq[at] = top + place
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        ends[at] |= ends[at + 1]
        seq, ends = seq[stay], ends[stay]
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        known = np.concatenate(weight)
        size = lambda x, known=known: np.where(x < base, 1, known[np.maximum(x - base, 0)] if len(known) else 1)
        lefts.append(left)
        rights.append(right)
        weight.append(size(left) + size(right))
        top += len(pairs)
    counts = np.zeros(len(lengths), np.int64)
    counts[lengths > 0] = np.diff(np.r_[0, np.flatnonzero(ends) + 1])
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(weight), seq, counts


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, expansions: np.ndarray, base: int) -> np.ndarray:
    """ids of the symbols."""
    if not len(left):
        return symbols.astype(np.uint32)
    offset = np.r_[0, np.cumsum(expansions)]
    flat = np.zeros(offset[-1], np.uint32)
    for r in range(len(left)):  # a rule refers to earlier ones only
        o = offset[r]
        for x in (left[r], right[r]):
            if x < base:
                flat[o] = x
                o += 1
            else:
                n = expansions[x - base]
                flat[o : o + n] = flat[offset[x - base] : offset[x - base] + n]
                o += n
    rule = symbols >= base
    place = np.where(rule, symbols - base, 0)
    size = np.where(rule, expansions[place], 1)
    to = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    out[to[~rule]] = symbols[~rule]
    n, start = size[rule], offset[place[rule]]
    index = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out[np.repeat(to[rule] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = flat[index]
    return out


def encoded_shards(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of the file, in ascending doc_id order within and across its parts."""
    documents = id_and_text(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = words(path)
        base = seen.tokenizer.get_vocab_size(with_added_tokens=True)
        end, part, start = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids: list[int] = []
        data: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in data], np.int64)
            left, right, expansions, symbols, counts = compress(np.concatenate(data), lengths, base)
            width = 2 if base + len(left) <= 1 << 16 else 3
            packed = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
            columns = [part, start, int(lengths.sum()), np.array(ids, "<i8").tobytes(), lengths.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), expansions.astype("<u4").tobytes(), width, packed, base]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int8(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for i, j in runs(offsets, CUT_BYTES):
                encoded, lengths = seen.encode_all(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                for doc, own in zip(docs[i:j], np.split(encoded, np.cumsum(lengths)[:-1]), strict=True):
                    ids.append(doc)
                    data.append(own)
                    held += len(own)
                    if held >= SHARD_IDS:
                        yield shard()
                        start += held
                        held = 0
                        ids.clear()
                        data.clear()
        if ids:
            yield shard()

    known = documents.where("doc_id is not null")
    return in_batches(known.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")).mapInArrow(run, SHARD)


def write(documents: DataFrame, to: str, path: str, end_id: int = 1) -> None:
    """Write the token files of a table; rows without doc_id have no place in the order and are left out.

    A null or empty text is the end id alone.  Rows that share a doc_id follow each other by text.
    """
    encoded_shards(documents, path, end_id).write.parquet(to)


def numbers(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], "<u4").astype(np.int64)


def symbols_of(row: dict, low: int = 0, high: int | None = None) -> np.ndarray:
    """The symbols low..high-1 of a shard."""
    width = row["width"]
    packed = np.frombuffer(row["symbols"], np.uint8)[low * width : None if high is None else high * width].reshape(-1, width)
    out = np.zeros((len(packed), 4), np.uint8)
    out[:, :width] = packed
    return out.view("<u4").ravel().astype(np.int64)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a shard."""
    ids = expand(symbols_of(row), numbers(row, "rule_left"), numbers(row, "rule_right"), numbers(row, "expansions"), row["base"])
    return np.frombuffer(row["doc_ids"], "<i8"), numbers(row, "lengths"), ids


def document(row: dict, k: int) -> np.ndarray:
    """Random access: ids of the k-th document of a shard, from its own symbols and the rules below them."""
    counts, base = numbers(row, "symbol_counts"), row["base"]
    low = int(counts[:k].sum())
    left, right = (np.frombuffer(row[name], "<u4") for name in ("rule_left", "rule_right"))
    out, todo = [], symbols_of(row, low, low + int(counts[k])).tolist()[::-1]
    while todo:
        x = todo.pop()
        if x < base:
            out.append(x)
        else:
            todo += [int(right[x - base]), int(left[x - base])]
    return np.array(out, np.uint32)


def token(row: dict, k: int, i: int) -> int:
    """Random access within a document: its i-th id, by the lengths to which symbols expand."""
    counts, base = numbers(row, "symbol_counts"), row["base"]
    expansions, left, right = numbers(row, "expansions"), numbers(row, "rule_left"), numbers(row, "rule_right")
    low = int(counts[:k].sum())
    size = lambda x: 1 if x < base else int(expansions[x - base])
    for x in symbols_of(row, low, low + int(counts[k])).tolist():
        if i < size(x):
            while x >= base:
                first = int(left[x - base])
                x, i = (first, i) if i < size(first) else (int(right[x - base]), i - size(first))
            return x
        i -= size(x)
    raise IndexError(i)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, first, doc_id, n_tokens, ids_crc32) of every document in the files; first: ids before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                docs, lengths, ids = unpack(row)
                raw = memoryview(ids.astype("<u4").tobytes())
                edge = np.r_[0, np.cumsum(lengths)]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(edge[:-1] + row["start"]), pa.array(docs.astype(np.int64)), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "first", "doc_id", "n_tokens", "ids_crc32"],
                )

    return in_batches(spark.read.schema(SHARD).parquet(path)).mapInArrow(run, "part int, first long, doc_id long, n_tokens long, ids_crc32 long")


def report(documents: DataFrame, to: str, path: str, end_id: int = 1) -> DataFrame:
    """Write the files, read them back, and give each document's place among all ids, its length and checksum.

    The driver learns one total for each part of the files, which are as many as the shuffle has partitions.
    """
    spark = documents.sparkSession
    write(documents, to, path, end_id)
    back = read(spark, to)
    sizes = spark.read.schema(SHARD).parquet(to).select("part", (F.col("start") + F.col("n_ids")).alias("end"))
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.max("end").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "p int, before long")
    out = back.join(F.broadcast(offsets), F.col("part") == F.col("p"))
    return out.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
