"""BM25 first stage in one pass over the collection.

The collection is tokenised once and kept as one short row a document: the ids and counts of
its query terms. Scoring goes through blocks of documents. A block knows the largest impact of
each of its terms; a query whose impacts there cannot reach its k-th score so far skips the
block, and of the others the terms that cannot reach it together are only looked up for
documents that hold another term and could still reach it. Both are exact. A task holds a
bounded number of postings at a time and keeps the best scores from one such part to the next, or,
where queries are many, only their thresholds; only a query's k best of what is kept leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.session import scratch_dir

#: (query, term) pairs that one pass over the collection serves; their terms are broadcast.
PAIRS = 4_000_000
#: Documents of a block and queries of a chunk.
BLOCK, CHUNK = 256, 256
#: Postings that a task holds at once, and documents whose tokens it looks up at once.
HELD, LOOKED_UP = 2_000_000, 512
#: Scores that a task keeps from one part of its postings to the next; beyond that only thresholds.
KEPT = 2_000_000
#: Share of a query's threshold that its low terms may reach together.
LOW = 0.5
_SLACK = 2e-6


def _postings(vocabulary):
    """(docid, tokens) to (docid, dl, ids, tfs): the query terms of a document and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary.value, pa.string())
        for batch in (whole.slice(lo, LOOKED_UP) for whole in batches for lo in range(0, len(whole), LOOKED_UP)):
            tokens = batch.column(1)
            if pa.types.is_large_list(tokens.type):
                tokens = tokens.cast(pa.list_(pa.string()))
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(tokens.flatten(), value_set=terms)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(batch)), size)[at]
            code = row * len(terms) + found.drop_null().to_numpy()
            code, tf = np.unique(code, return_counts=True)
            row, term = (code // len(terms), code % len(terms)) if len(terms) else (code, code)
            ptr = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int32), mask=tokens.is_null().to_numpy(zero_copy_only=False)), pa.ListArray.from_arrays(ptr, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(ptr, pa.array(tf.astype(np.int32)))], names=["docid", "dl", "ids", "tfs"])

    return run


def _counts(n_terms: int):
    """Documents per term of a task, and under -1 to -3 its documents, those with a text, and
    their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, texts, length = np.zeros(n_terms, np.int64), 0, 0, 0
        for batch in batches:
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            docs += len(batch)
            texts += len(batch) - batch.column(0).null_count
            length += pc.sum(batch.column(0)).as_py() or 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2, -3])), pa.array(np.append(df[some], [docs, texts, length]))], names=["term", "n"])

    return run


class _Block:
    """Postings of some documents by term, with each term's largest impact."""

    def __init__(self, docids: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.docids, self.row, self.impact = docids, row[order].astype(np.int32), impact[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.ptr = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)


class _Best:
    """The best scores so far of a chunk of queries, and the k-th of each as its threshold."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.limit = 0

    def add(self, q: np.ndarray, docid: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, docid, score))
        self.size += len(q)
        if self.size > self.limit:  # thresholds rise whenever the scores have grown by a quarter
            self.parts = [self.kept()]
            self.size = len(self.parts[0][0])
            self.limit = self.size * 5 // 4

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query and what may tie with the last of them after rounding."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, docid, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((-score, q))
        q, docid, score = q[order], docid[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.least)))
        kth = first + self.k - 1
        has = (kth < len(q)) & (q[np.minimum(kth, len(q) - 1)] == np.arange(len(self.least)))
        self.least = np.maximum(self.least, np.where(has, score[np.minimum(kth, len(q) - 1)], -np.inf))
        stay = score >= self.least[q] - _SLACK
        return q[stay], docid[stay], score[stay]


def _low(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which (query, term) pairs cannot lift a document to the query's threshold, not even all
    together: the least reaching terms of each query."""
    order = np.lexsort((most, q))
    total = np.cumsum(most[order])
    first = np.searchsorted(q[order], q[order])
    low = np.empty(len(q), dtype=bool)
    low[order] = total - total[first] + most[order][first] < LOW * least[q[order]] - _SLACK
    return low


def _meet(block: _Block, term: np.ndarray, q: np.ndarray, w: np.ndarray, best: _Best) -> tuple[int, int]:
    """Score a block for the queries (q, term, w) of a chunk that may gain from it; returns the
    postings read and those there were.

    A document must hold a term that is not low to reach the threshold, so only postings of
    such terms are gone through; the low terms are looked up for the documents that, with all
    of them, could reach it.
    """
    if not len(block.terms) or not len(term):
        return 0, 0
    at = np.minimum(np.searchsorted(block.terms, term), len(block.terms) - 1)
    hit = np.flatnonzero(block.terms[at] == term)
    at, q, w = at[hit], q[hit], w[hit]
    n, docs = len(best.least), len(block.docids)
    size = block.ptr[at + 1] - block.ptr[at]
    every = int(size.sum())
    most = w * block.most[at]
    live = (np.bincount(q, most, n) >= best.least - _SLACK)[q]
    at, q, w, size, most = at[live], q[live], w[live], size[live], most[live]
    low = _low(q, most, best.least)
    rest = np.bincount(q[low], most[low], n)
    read = int(size[~low].sum())
    if not read:
        return 0, every

    def postings(places, sizes):
        """For each of the sizes' postings, which place it is of, and its own place."""
        pair = np.repeat(np.arange(len(places)), sizes)
        return pair, np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + block.ptr[places][pair]

    pair, posting = postings(at[~low], size[~low])
    score = np.bincount(q[~low][pair] * docs + block.row[posting], w[~low][pair] * block.impact[posting], n * docs)
    cell = np.flatnonzero(score)
    asked, doc, found = cell // docs, cell % docs, score[cell]
    stay = found + rest[asked] >= best.least[asked] - _SLACK
    asked, doc, found = asked[stay], doc[stay], found[stay]
    if low.any() and len(asked):
        order = np.argsort(q[low], kind="stable")
        lq, lw, lat = q[low][order], w[low][order], at[low][order]
        used, place = np.unique(lat, return_inverse=True)
        impact = np.zeros((len(used), docs))
        pair, posting = postings(used, block.ptr[used + 1] - block.ptr[used])
        impact[pair, block.row[posting]] = block.impact[posting]
        first, count = np.searchsorted(lq, asked), np.searchsorted(lq, asked, "right") - np.searchsorted(lq, asked)
        of = np.repeat(np.arange(len(asked)), count)
        at_low = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
        found = found + np.bincount(of, lw[at_low] * impact[place[at_low], doc[of]], len(asked))
        read += len(posting) + len(of)
    stay = found >= best.least[asked] - _SLACK
    best.add(asked[stay], block.docids[doc[stay]], found[stay])
    return read, every


def _blocks(batches: Iterator[pa.RecordBatch], k1: float, b: float, mean_length: float) -> Iterator[_Block]:
    held: list[pa.RecordBatch] = []

    def flush() -> _Block:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        dl = table.column("dl").to_numpy().astype(np.float64)
        ids, tfs = (table.column(c).chunk(0) for c in ("ids", "tfs"))
        size = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        row, tf = np.repeat(np.arange(len(dl)), size), tfs.flatten().to_numpy().astype(np.float64)
        norm = k1 * (1.0 - b + b * dl / mean_length)
        return _Block(table.column("docid").to_numpy(), row, ids.flatten().to_numpy(), tf * (k1 + 1.0) / (tf + norm[row]))

    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            held.append(batch.slice(lo, BLOCK))
            if sum(map(len, held)) >= BLOCK:
                yield flush()
    if held:
        yield flush()


def _parts(blocks: Iterator[_Block]) -> Iterator[list[_Block]]:
    """Blocks in lists of about HELD postings."""
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block.row)
        if size >= HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scored(shared, k: int, k1: float, b: float, mean_length: float, report: bool):
    """Documents of a task to (qid, docid, score), or to the postings read and those there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, term, q, w = shared.value  # pairs in the order of q
        read = every = 0
        least, kept = np.full(len(qids), -np.inf), {}

        def out(lo: int, best: _Best) -> Iterator[pa.RecordBatch]:
            at, docid, score = best.kept()
            least[lo:lo + CHUNK] = best.least
            if not report and len(at):
                yield pa.RecordBatch.from_arrays([pa.array(qids[lo + at]), pa.array(docid), pa.array(score)], names=["qid", "docid", "score"])

        for blocks in _parts(_blocks(batches, k1, b, mean_length)):
            for lo in range(0, len(qids), CHUNK):
                a, z = np.searchsorted(q, (lo, lo + CHUNK))
                best = kept.get(lo) or _Best(min(CHUNK, len(qids) - lo), k)
                best.least = np.maximum(best.least, least[lo:lo + CHUNK])
                for block in blocks:
                    r, e = _meet(block, term[a:z], q[a:z] - lo, w[a:z], best)
                    read, every = read + r, every + e
                if len(qids) * k <= KEPT:
                    kept[lo] = best
                else:
                    yield from out(lo, best)
            blocks.clear()  # before the next ones are read
        for lo, best in kept.items():
            yield from out(lo, best)
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([read]), pa.array([every])], names=["read", "postings"])

    return run


def scored_pairs(pairs: pa.Table, docs: DataFrame, tokens: Column, k: int, k1: float, b: float, report: bool = False) -> DataFrame:
    """``qid, docid, score`` of at least the k best documents (``id`` and ``tokens``) of each
    query of ``pairs`` (``qid, term, qtf``), before rounding; with ``report`` the postings
    read and all postings of the queries' terms, a row a task."""
    spark = docs.sparkSession
    terms = pc.unique(pairs.column("term").combine_chunks())
    term = pc.index_in(pairs.column("term").combine_chunks(), value_set=terms).to_numpy().astype(np.int64)
    path = scratch_dir(spark, "postings")
    vocabulary = spark.sparkContext.broadcast(terms.to_pylist())
    (docs.select(F.col("id").cast("long").alias("docid"), tokens.alias("tokens"))
     .mapInArrow(_postings(vocabulary), "docid long, dl int, ids array<int>, tfs array<int>").write.parquet(path))
    table = spark.read.parquet(path)
    df = np.zeros(len(terms), np.int64)
    total = {-1: 0, -2: 0, -3: 0}
    for r in table.select("dl", "ids").mapInArrow(_counts(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            total[r["term"]] = r["n"]
        else:  # at most one row a term of the pass
            df[r["term"]] = r["n"]
    n_docs, mean_length = total[-1], total[-3] / max(total[-2], 1) or 1.0
    qids, q = np.unique(pairs.column("qid").to_numpy(), return_inverse=True)
    order = np.argsort(q, kind="stable")
    weight = pairs.column("qtf").to_numpy() * np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))[term]
    shared = spark.sparkContext.broadcast((qids, term[order], q[order], weight[order]))
    schema = "read long, postings long" if report else "qid long, docid long, score double"
    return table.mapInArrow(_scored(shared, k, k1, b, mean_length, report), schema)


def passes(pairs: DataFrame) -> Iterator[pa.Table]:
    """The (``qid, term, qtf``) rows of all queries in groups of about PAIRS, a query whole."""
    n = pairs.count()
    groups = math.ceil(n / PAIRS)
    for g in range(groups):
        yield pairs.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g).toArrow()
