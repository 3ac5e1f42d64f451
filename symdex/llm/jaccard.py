"""Near-duplicate documents by word-shingle Jaccard similarity, with PartEnum signatures.

A document's set holds its distinct 4-word shingles; two documents link where 100 * |A & B| >= 85 * |A | B|.  Sizes are dealt
into bands so that linked sets are in one band or in neighbours.  Sets of a band and of the next one differ in at most K shingles if they
link, so when shingles are hashed into K + 1 + m partitions, m + 1 partitions at least are equal in both sets.  Each subset of m + 1
partitions would be a signature; of these a set needs only the subsets' rarest members.  Partitions are put in one order for all sets, the rarest content first, and
a set signs all its partitions but the last m: of m + 1 that two sets share, the first is signed by both.  An empty partition is no
content, but may be shared: a set with e of them signs all but the last m - e of the others.  Where e > m, all shared partitions might be
empty, so a set also signs each subset of m + 1 of its empty ones.  No link is missed, and sets that share a passage but not most of their text seldom meet.

Steps: copies (equal sets) become one class; sets that share a signature are connected to the smallest set that has it;
the parts connected in this way are compared in blocks of ``BLOCK`` documents, those of neighbouring bands only, by exact intersection counts; links between them are
contracted to a spanning forest, from which components follow.  Pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import components, discard, id_and_text, in_batches, stored
from .tokens import CHUNK_BYTES, Words, buffers, grams, mix, runs, signed

SHINGLE = 4
LEAST = 85
#: Documents, and shingles, of one block of a comparison.
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
#: Spare partitions of small sets; large ones have half of K.
SPARE = 3
_SLICE = 4096


@cache
def band_tops(upto: int) -> tuple[int, ...]:
    """Largest size of each band; band 0 holds size 1."""
    tops = [1]
    while tops[-1] < upto:
        tops.append((tops[-1] + 1) * 100 // LEAST)
    return tuple(tops)


@cache
def partitions(group: int) -> tuple[int, int]:
    """(number of partitions, m) of a group, which compares the sets of band ``group`` with those of it and the next band."""
    tops = band_tops(1)
    while len(tops) <= group:
        tops = band_tops(tops[-1] + 1)
    low, top = (tops[group - 1] + 1 if group else 1), tops[group]
    k = (100 - LEAST) * (top + top * 100 // LEAST) // (100 + LEAST)
    if k == 0:
        return 1, 0
    m = max(SPARE, k // 2)
    for _ in range(8):
        empty = (k + 1 + m) * math.exp(-low / (k + 1 + m))
        m = max(m, SPARE + (0 if empty < 1 else math.ceil(empty + 5 * math.sqrt(empty))))
    return k + 1 + m, m


class Sets:
    """Distinct shingles of a run of documents: sorted hashes, and per document the range of its own."""

    def __init__(self, w: Words):
        counts, left = w.counts(), w.left()
        whole = np.flatnonzero(left >= SHINGLE)
        few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        h = grams(w.hash, SHINGLE, whole)
        doc = w.doc()[whole]
        if len(few):
            own = np.concatenate([grams(w.hash, int(counts[d]), w.first[d : d + 1]) for d in few])
            order = np.argsort(np.r_[doc, few], kind="stable")
            h, doc = np.r_[h, own][order], np.r_[doc, few][order]
        edge = np.searchsorted(doc, np.arange(len(counts) + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(counts) + 1))
        self.size = np.diff(self.first)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum over each document's shingles modulo 2**64."""
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def sets_of(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = buffers(column)
    for i, j in runs(offsets, most):
        yield i, j, Sets(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "space", True))


def signatures(sets: Sets, take: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Contents of the documents ``take`` (mask): (document, hash) of the partitions of the own band's group, of those of the band's below, and
    of the subsets of empty ones; and for the two groups how many of the commonest partitions each document needn't sign."""
    size = sets.size
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spare = [np.zeros(len(size), np.int64) for _ in (0, 1)]
    if not take.any():
        return [none, none, none], spare
    tops = np.array(band_tops(int(size.max())))
    band = np.searchsorted(tops, np.maximum(size, 1))
    sides, gaps = [], [none]
    for back in (0, 1):
        of = np.flatnonzero(take & (size > 0) & (band >= back))
        group = band[of] - back
        shape = np.array([partitions(int(g)) for g in group], np.int64).reshape(-1, 2)
        n, m = shape[:, 0], shape[:, 1]
        each = size[of]
        base = np.cumsum(n) - n
        place = np.repeat(sets.first[:-1][of] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        h = sets.hash[place]
        spot = np.repeat(base, each) + (mix(h) % np.repeat(n, each).astype(np.uint64)).astype(np.int64)
        sums, filled = np.zeros(n.sum(), np.uint64), np.zeros(n.sum(), bool)
        np.add.at(sums, spot, mix(h + np.uint64(0x2545F4914F6CDD1D)))
        filled[spot] = True
        owner = np.repeat(np.arange(len(of)), n)
        index = np.arange(len(sums)) - base[owner]
        salt = mix(group.astype(np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15) + index.astype(np.uint64))
        sides.append((of[owner[filled]], mix(sums[filled] ^ salt[filled])))
        empty = n - np.bincount(owner[filled], minlength=len(of))
        spare[back][of] = np.maximum(m - empty, 0)
        for d in np.flatnonzero(empty > m):
            free = index[base[d] : base[d] + n[d]][~filled[base[d] : base[d] + n[d]]]
            subsets = np.array(list(combinations(free.tolist(), int(m[d]) + 1)), np.uint64)
            sign = np.zeros(len(subsets), np.uint64)
            for column in subsets.T:
                sign = mix(sign * np.uint64(31) + column + np.uint64(1))
            gaps.append((np.full(len(subsets), of[d]), mix(sign ^ mix(np.array([group[d] + (1 << 32)], np.uint64)))))
    return [*sides, (np.concatenate([x for x, _ in gaps]), np.concatenate([y for _, y in gaps]))], spare


def signed_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, own, below, gaps, own_spare, below_spare): sets with the contents of their partitions (``signatures``).

    A set that its task has signed already is not signed again; rows without doc_id are not signed.
    """
    lists = ("own", "below", "gaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            valid = np.asarray(batch.column("doc_id").is_valid())
            for i, j, sets in sets_of(batch.column("text")):
                h1, h2 = sets.total(mix(sets.hash)), sets.total(mix(sets.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                take = np.zeros(j - i, bool)
                for d in np.flatnonzero(valid[i:j]).tolist():
                    key = int(h1[d])
                    if key not in seen:
                        seen.add(key)
                        take[d] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                found, spare = signatures(sets, take)
                columns = []
                for doc, sign in found:
                    order = np.argsort(doc, kind="stable")
                    edge = np.searchsorted(doc[order], np.arange(j - i + 1))
                    columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(signed(sign[order]))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(sets.size.astype(np.int64)), pa.array(signed(h1)), pa.array(signed(h2)), *columns, *map(pa.array, spare)],
                    ["doc_id", "n_shingles", "h1", "h2", *lists, "own_spare", "below_spare"],
                )

    return in_batches(documents).mapInArrow(run, f"doc_id long, n_shingles long, h1 long, h2 long, {', '.join(f'{x} array<long>' for x in lists)}, own_spare long, below_spare long")


def met(known: DataFrame) -> DataFrame:
    """(a, b): pairs of sets (their h1) that connect all sets with a signature in common.

    Tables of counts and of hubs are written before they are joined, so that the join has a shuffle of its own, in which Spark splits a content of
    very many sets.
    """
    c = F.col
    both = known.where("size(own) > 0").select("h1", F.inline(F.array(*(F.struct(F.xxhash64("h1", F.lit(i)).alias("key"), c(x).alias("signs"), c(f"{x}_spare").alias("spare")) for i, x in enumerate(("own", "below"))))))
    rows = both.select("key", F.explode("signs").alias("s"))
    often = stored(rows.groupBy("s").count().where("count > 1").select(c("s").alias("t"), c("count").alias("c")), "often")
    shared = rows.join(often, c("s") == c("t")).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("c", "s"))).alias("shared"))
    spare = both.select(c("key").alias("k"), "h1", "spare").distinct().hint("shuffle_hash")
    signs = shared.join(spare, c("key") == c("k")).where(F.size("shared") > c("spare")).select("h1", F.explode(F.slice("shared", F.lit(1), F.size("shared") - c("spare").cast("int"))).alias("x")).select("h1", "x.s")
    signs = stored(signs.unionByName(known.select("h1", F.explode("gaps").alias("s"))), "signs")
    hubs = stored(signs.groupBy("s").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select(c("s").alias("t"), "low"), "hubs")
    near = stored(signs.join(hubs, c("s") == c("t")).where("h1 <> low").select(c("h1").alias("a"), c("low").alias("b")).distinct(), "near")
    discard(often, signs, hubs)
    return near


def linked(table: pa.Table) -> pa.Table:
    """Exact links between two blocks of documents (or in one): (doc_id, root, links) of every document that has a link.

    table: doc_id, text, copies, block, and i and j, the two blocks; one that has no document leaves nothing to compare.
    """
    table = table.combine_chunks()
    if table["i"][0] != table["j"][0] and len(table["block"].unique()) < 2:
        return pa.table({name: pa.array([], pa.int64()) for name in ("doc_id", "root", "links")})
    text = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    ids, block = np.asarray(table["doc_id"], np.int64), np.asarray(table["block"], np.int64)
    copies = np.asarray(table["copies"], np.int64)
    parts = [(i, s) for i, _, s in sets_of(text)]
    h = np.concatenate([s.hash for _, s in parts])
    doc = np.concatenate([s.doc + i for i, s in parts])
    size = np.concatenate([s.size for _, s in parts])
    one = block == block[0]
    rows, columns = (np.arange(len(ids)),) * 2 if one.all() else (np.flatnonzero(one), np.flatnonzero(~one))
    _, code, often = np.unique(h, return_inverse=True, return_counts=True)
    code, doc = (np.cumsum(often > 1) - 1)[code][often[code] > 1], doc[often[code] > 1]
    both = np.zeros((len(rows), len(columns)), np.float64)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, _SLICE):
        a, b = np.searchsorted(code, (low, low + _SLICE))
        has = np.zeros((len(ids), _SLICE), np.float32)
        has[doc[a:b], code[a:b] - low] = 1
        both += has[rows] @ has[columns].T
    union = size[rows][:, None] + size[columns][None, :] - both
    link = (100 * both >= LEAST * union) & (both > 0) & (ids[rows][:, None] != ids[columns][None, :])
    r, c = np.nonzero(link)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, rows[r], copies[columns[c]])
    if not one.all():
        np.add.at(links, columns[c], copies[rows[r]])
    root = ids.copy()
    while True:
        least = np.minimum(root[rows[r]], root[columns[c]])
        before = root.copy()
        np.minimum.at(root, rows[r], least)
        np.minimum.at(root, columns[c], least)
        if (root == before).all():
            break
    has = np.flatnonzero(links)
    return pa.table({"doc_id": pa.array(ids[has]), "root": pa.array(root[has]), "links": pa.array(links[has])})


def blocks_of(coarse: DataFrame) -> DataFrame:
    """(node, part, copies, block, others): the block of each document of a part, and the blocks that it is compared with, its own included.

    A part of more than one block is dealt by band first, as linked sets are in one band or in neighbours; blocks of other bands never meet.
    coarse: node, component, copies, n (size of the set).
    """
    c = F.col
    needed = lambda k, total: F.greatest(F.ceil(k / BLOCK), F.ceil(total / BLOCK_SHINGLES)).cast("long")
    parts = coarse.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    # small tables are written before they are joined, so that Spark splits a part of very many documents there
    parts = stored(parts.select(c("component").alias("part"), (needed(c("k"), c("total")) > 1).alias("large")), "parts")
    tops = F.array(*map(F.lit, band_tops(1 << 31)))
    band = F.when(c("large"), F.size(F.filter(tops, lambda t: t < c("n")))).otherwise(0).cast("long")
    own = coarse.join(parts, c("component") == c("part")).select("node", "part", "copies", "n", band.alias("band"))
    bands = own.groupBy("part", "band").agg(needed(F.count("*"), F.sum("n")).alias("blocks"))
    order = Window.partitionBy("part").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(order) == c("band") + step, f("blocks").over(order)).otherwise(0)
    bands = stored(bands.select("part", "band", "blocks", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above")), "bands")
    number = lambda step, i: (c("band") + step) * (1 << 32) + i
    each = lambda n, step: F.transform(F.filter(F.sequence(F.lit(-1), n - 1), lambda i: i >= 0), lambda i: number(step, i))
    others = F.concat(each(c("blocks"), 0), each(c("below"), -1), each(c("above"), 1))
    members = stored(own.join(bands, ["part", "band"]).select("node", "part", "copies", number(0, F.pmod(F.xxhash64("node"), c("blocks"))).alias("block"), others.alias("others")), "members")
    discard(parts, bands)
    return members


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of documents.

    A null or empty text, or one of white space, has an empty set and links with nothing.  Rows that share a doc_id are one node; a
    row without doc_id gets no component.  The result is a table in shared storage; what it was made of is deleted.  n_links counts the documents that a document links with, copies included.
    """
    documents = id_and_text(documents)
    sets = stored(signed_sets(documents), "sets")
    known = sets.where("n_shingles > 0 and doc_id is not null")
    classes = stored(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.max("n_shingles").alias("n")), "classes")
    of_class = known.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "rep", "copies")
    copy_edges = stored(of_class.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    near = met(known)
    parts = components(near)
    coarse = stored(parts.join(classes.hint("shuffle_hash"), F.col("node") == F.col("h1")).select(F.col("rep").alias("node"), "component", "copies", "n"), "coarse")
    discard(near, parts)
    members = blocks_of(coarse)
    texts = documents.join(members.hint("shuffle_hash"), F.col("doc_id") == F.col("node")).select("doc_id", "text", "part", "copies", "block", F.explode("others").alias("other"))
    dealt = texts.select("doc_id", "text", "copies", "block", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = stored(dealt.groupBy("part", "i", "j").applyInArrow(linked, "doc_id long, root long, links long"), "links")
    discard(coarse, members)
    forest = found.where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    final = components(forest.unionByName(copy_edges))
    links = found.groupBy("doc_id").agg(F.sum("links").alias("links")).withColumnRenamed("doc_id", "linker")
    links = of_class.distinct().join(links, F.col("rep") == F.col("linker"), "left").select(
        F.col("doc_id").alias("member"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    ).groupBy("member").agg(F.max("links").alias("links"))
    out = sets.select("doc_id", "n_shingles").join(final.hint("shuffle_hash"), F.col("doc_id") == F.col("node"), "left")
    out = out.join(links.hint("shuffle_hash"), F.col("doc_id") == F.col("member"), "left")
    out = stored(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")), "near-duplicates")
    discard(sets, classes, copy_edges, found, final)
    return out


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of documents, as ``near_duplicates`` has them."""
    return near_duplicates(documents)


def brute_force(texts: dict) -> dict:
    """The same by plain Python over all pairs, for tests: doc -> (n_shingles, component, n_links)."""
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    root, n = {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= LEAST * max(len(x), len(y)):
            i = len(x & y)
            if 100 * i >= LEAST * (len(x) + len(y) - i):
                n[a], n[b] = n[a] + 1, n[b] + 1
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k), n[k]) for k in sets}
