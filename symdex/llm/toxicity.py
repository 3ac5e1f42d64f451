"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings of 4 to 8 bytes, lower-cased and hashed to 64 bits; inflected words so share terms.  The features of
the classifier are all terms that go with either label in a bounded sample of labelled documents (likelihood ratio): texts are compared by what they hold of
these, and the cosine is exact over them.  Their document frequencies come from all documents.  Sampled examples that hold any of these terms form the index: postings by term,
in blocks of ``BLOCK`` examples, each with the largest weight in the block.  A query visits blocks in order of their upper
bound and stops when no block can reach the k-th similarity found.  The similarity-weighted vote of the ``NEIGHBOURS``
nearest examples is calibrated by a logistic curve, fitted on votes for the part of the sample that had no say in the choice of terms,
each without itself.  The nearest examples are the evidence of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import arrow_map, fold, with_text
from .tokens import Words, mix, powers, prefix_sums, signed, words_of

#: Labelled documents in the fit, toxic ones and others at most (by hash order of their ids).
SAMPLE = (6_000, 18_000)
#: One in so many of these calibrates the votes; the others choose the terms.
CALIBRATING = 4
#: A term is in this many examples at least, its odds of a label are this many times those of all examples, and its likelihood ratio is one that chance exceeds once in 1000 terms.
LEAST_EXAMPLES, LEAST_ODDS, LEAST_RATIO = 4, 3, 10.83 / 2
NEIGHBOURS = 15
BLOCK = 64
BEGINNINGS = (4, 5, 6, 7, 8)
#: Neighbours of a clean kind that every vote holds, so that one weak neighbour doesn't decide.
PRIOR = 0.5


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of every word and word beginning, repetitions included."""
    data, start, end = w.data, w.start, w.end
    low = data.astype(np.uint64)
    big = (data >= 0x41) & (data <= 0x5A)
    low[big] += np.uint64(0x20)
    up, down = powers(0x9E3779B97F4A7C15, len(data) + 1)
    sums = prefix_sums((low + np.uint64(1)) * up[: len(data)])
    doc = w.doc()
    docs, out = [doc], [w.hash]
    for n in BEGINNINGS:
        has = np.flatnonzero(end - start > n)
        s = start[has]
        docs.append(doc[has])
        out.append(mix((sums[s + n] - sums[s]) * down[s] + np.uint64(n << 8)))
    return np.concatenate(docs), np.concatenate(out)


class Vocabulary:
    """Sorted term hashes with a first test by 16 bits, as nearly all terms are strangers."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term number, occurrences), sorted."""
        doc, h = terms(w)
        near = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        doc, h = doc[near], h[near]
        if not len(self.terms):
            return doc[:0], doc[:0], doc[:0]
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[place] == h
        key, n = np.unique(doc[hit] * len(self.terms) + place[hit], return_counts=True)
        return key // len(self.terms), key % len(self.terms), n


def sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, calibrates) of the labelled documents of the fit: never those whose fold is 0.

    Of several labels of a document the largest holds.  The sample's ids (24 000 at most) are broadcast.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold("id") != 0)
    picked = None
    for toxic, most in ((1, SAMPLE[0]), (0, SAMPLE[1])):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    calibrates = (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(CALIBRATING)) == 0).alias("calibrates")
    return text.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic", calibrates)


def choose_terms(examples: DataFrame) -> np.ndarray:
    """Hashes of all terms that go with one of the labels; they come to the driver, bounded by the words of the sample."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        toxic = np.asarray(batch.column("toxic"), np.int64)
        for i, _, w in words_of(batch.column("text"), "alnum", True):
            doc, h = terms(w)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            y, h = toxic[i + doc[new]], h[new]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            if len(first):
                n = np.diff(np.r_[first, len(h)])
                t = np.add.reduceat(y, first)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(t), pa.array(n)], ["h", "t", "n"])

    totals = examples.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    a, b = float(totals[0]), float(totals[1] - totals[0])
    if not a or not b:
        return np.zeros(0, np.uint64)
    df = arrow_map(examples, each, "h long, t long, n long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    t, c = F.col("t"), F.col("n") - F.col("t")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (F.col("n") * share))).otherwise(0.0)
    df = df.where(F.col("n") >= min(LEAST_EXAMPLES, max(2, int(a // 8)))).where((t * b > LEAST_ODDS * c * a) | (c * a > LEAST_ODDS * t * b))
    best = df.where(part(t, a / (a + b)) + part(c, b / (a + b)) >= LEAST_RATIO)
    return np.array([r["h"] for r in best.select("h").collect()], np.int64).view(np.uint64)


def document_frequencies(documents: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents."""
    size = len(vocabulary.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, w in words_of(batch.column("text"), "alnum", True):
                df += np.bincount(vocabulary.counts(w)[1], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(size), -1].astype(np.int32)), pa.array(np.r_[df, rows])], ["term", "n"])

    found = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = {r["term"]: r["n"] for r in found}
    return np.array([out.get(t, 0) for t in range(size)], np.int64), int(out.get(-1, 0))


class Index:
    """Block-max inverted index of unit vectors."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        # neighbours with the same strongest term stand together, so that bounds of blocks are tight
        strongest = np.full(len(ids), n_terms)
        order = np.lexsort((-weight, example))
        head = order[np.r_[True, example[order][1:] != example[order][:-1]]] if len(order) else order
        strongest[example[head]] = term[head]
        rank = np.lexsort((ids, strongest))
        back = np.empty(len(ids), np.int64)
        back[rank] = np.arange(len(ids))
        self.ids, self.toxic = ids[rank], toxic[rank].astype(np.float64)
        example = back[example]
        order = np.lexsort((example, term))
        self.doc, self.weight = example[order], weight[order]
        term, block = term[order], example[order] // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.low = np.flatnonzero(new)
        self.high = np.r_[self.low[1:], len(term)]
        self.block = block[self.low]
        self.most = np.maximum.reduceat(self.weight, self.low) if len(self.low) else np.zeros(0)
        self.of_term = np.searchsorted(term[self.low], np.arange(n_terms + 1))
        self.n_blocks = -(-len(ids) // BLOCK)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine, ties to the smaller id; ``but``: an id to leave out."""
        lo, hi = self.of_term[term], self.of_term[term + 1]
        n = hi - lo
        cells = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        q = np.repeat(weight, n)
        bound = np.bincount(self.block[cells], q * self.most[cells], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound)]
        docs, sims, kth, done, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4
        while done < len(order) and bound[order[done]] >= kth - 1e-12:
            now = np.zeros(self.n_blocks, bool)
            now[order[done : done + step]] = True
            done, step = done + step, step * 2
            at = now[self.block[cells]]
            c, w = cells[at], q[at]
            size = self.high[c] - self.low[c]
            place = np.repeat(self.low[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found, inverse = np.unique(self.doc[place], return_inverse=True)
            sim = np.round(np.bincount(inverse, np.repeat(w, size) * self.weight[place]), 9)
            docs, sims = np.r_[docs, found], np.r_[sims, sim]
            if but is not None:
                keep = self.ids[docs] != but
                docs, sims = docs[keep], sims[keep]
            best = np.lexsort((self.ids[docs], -sims))[:k]
            docs, sims = docs[best], sims[best]
            kth = sims[-1] if len(sims) == k else 0.0
        return docs, sims

    def vote(self, docs: np.ndarray, sims: np.ndarray) -> float:
        return float((sims * self.toxic[docs]).sum() / (sims.sum() + PRIOR)) if len(docs) else 0.0


class Model:
    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, index: Index, curve: tuple[float, float], empty: float):
        self.vocabulary, self.idf, self.index, self.curve, self.empty = vocabulary, idf, index, curve, empty

    def vectors(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, terms, weights) for documents that hold a term."""
        doc, term, n = self.vocabulary.counts(w)
        if not len(doc):
            return
        weight = unit(doc, term, n, self.idf)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(doc)], strict=True):
            yield int(doc[a]), term[a:b], weight[a:b]

    def score(self, vote: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-(a + b * vote)))


def unit(doc: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, (1 + log tf) * idf, of unit length per document (doc is sorted)."""
    weight = (1 + np.log(np.maximum(n, 1))) * idf[term]
    return weight / np.sqrt(np.bincount(doc, weight * weight))[doc] if len(doc) else weight


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-a - b x)), with a small ridge; b is not negative."""
    beta = np.zeros(2)
    m = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        g = m.T @ (y - p) - 1e-2 * beta
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of a table and its labels; rows that share a doc_id are examples each by its own text."""
    examples = sample(documents, labels)
    vocabulary = Vocabulary(choose_terms(examples.where("not calibrates")))
    size = len(vocabulary.terms)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, w in words_of(batch.column("text"), "alnum", True):
            doc, term, n = vocabulary.counts(w)
            edge = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "toxic", "calibrates")), pa.ListArray.from_arrays(edge, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(n.astype(np.int32)))],
                ["doc_id", "toxic", "calibrates", "terms", "counts"],
            )

    found = arrow_map(examples, each, "doc_id long, toxic int, calibrates boolean, terms array<int>, counts array<int>")
    t = found.dropDuplicates().orderBy("doc_id", F.to_json(F.struct("terms", "counts"))).toArrow().combine_chunks()
    df, n = document_frequencies(documents, vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 1
    flat = lambda name: np.asarray(pa.concat_arrays(t[name].chunks).flatten() if t.num_rows else [], np.int64)
    ids, toxic = np.asarray(t["doc_id"], np.int64), np.asarray(t["toxic"], np.int64)
    lengths = np.asarray(pa.compute.list_value_length(t["terms"]), np.int64) if t.num_rows else np.zeros(0, np.int64)
    doc, term, count = np.repeat(np.arange(len(ids)), lengths), flat("terms"), flat("counts")
    weight = unit(doc, term, count, idf)
    index = Index(ids, toxic, doc, term, weight, size)
    edge = np.r_[0, np.cumsum(lengths)]
    votes, truth = [], []
    for d in np.flatnonzero((lengths > 0) & np.asarray(t["calibrates"], bool)).tolist():
        a, b = edge[d], edge[d + 1]
        votes.append(index.vote(*index.nearest(term[a:b], weight[a:b], NEIGHBOURS, int(ids[d]))))
        truth.append(toxic[d])
    none = toxic[lengths == 0]
    empty = float((none.sum() + 0.5) / (len(none) + 10))
    curve = logistic(np.array(votes), np.array(truth, float)) if votes else (-3.0, 0.0)
    return Model(vocabulary, idf, index, curve, empty)


NEAR = "array<struct<doc_id: bigint, toxic: int, cosine: double>>"


def scored(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of documents with score and neighbours: the nearest examples with label and cosine.

    A document without any term, and so every null or empty text, gets the share of toxic ones among such examples and has no
    neighbours.  Repeated rows are scored each by itself.
    """
    given = documents.sparkSession.sparkContext.broadcast(model)
    source, name = with_text(documents, keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = given.value
        for i, j, w in words_of(batch.column(name), "alnum", True):
            score, n = np.full(j - i, m.empty), np.zeros(j - i, np.int32)
            docs, sims = [np.zeros(0, np.int64)], [np.zeros(0)]
            for d, term, weight in m.vectors(w):
                near, sim = m.index.nearest(term, weight, NEIGHBOURS)
                score[d], n[d] = m.score(m.index.vote(near, sim)), len(near)
                docs.append(near)
                sims.append(sim)
            at = np.concatenate(docs)
            each_near = pa.StructArray.from_arrays([pa.array(m.index.ids[at]), pa.array(m.index.toxic[at].astype(np.int32)), pa.array(np.concatenate(sims))], ["doc_id", "toxic", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), each_near)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score), evidence], [*keep, "score", "neighbours"])

    return arrow_map(source, each, f"{schema}, score double, neighbours {NEAR}")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours) of every document, as ``scored`` has them."""
    out = scored(documents, fit(documents, labels), ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")
