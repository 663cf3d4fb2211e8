"""Top-k of queries against blocks of vectors, as a stream, and small numpy k-means.

Passages and queries that share a block key meet in one sorted partition, passages first. A
task holds one block of passages; the queries of that block go past it in Arrow batches, one
matrix product a chunk. So passages are shuffled once, however many queries there are.

``ranked`` turns this round: a task holds queries with their k best so far, and all passages go
past them. Its rows are n x k, however many blocks there are, but passages are copied once a
block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores are ranked after rounding to this many decimals.
ROUND = 9
_CHUNK_SCORES = 1 << 24
#: Passages that queries which hold their best meet at once, and scores of one such product.
CHUNK, _MEET_SCORES = 256, 1 << 21
_HITS = 1 << 14


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def local_topk(qids: np.ndarray, q: np.ndarray, dids: np.ndarray, p: np.ndarray, k: int, exclude_self: bool):
    """(qid, docid, score) of each query's k best passages of a block, ties to smaller ids."""
    rows = max(1, _CHUNK_SCORES // max(len(dids), 1))
    for lo in range(0, len(qids), rows):
        ids = qids[lo:lo + rows]
        s = q[lo:lo + rows] @ p.T
        if exclude_self:
            s[ids[:, None] == dids[None, :]] = -np.inf
        keep = np.isfinite(s)
        if k < s.shape[1]:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            keep &= s >= (kth - 10.0 ** -(ROUND - 1))[:, None]  # all that could tie with the k-th after rounding
        r, c = np.nonzero(keep)
        score = np.round(s[r, c], ROUND)
        by = np.lexsort((dids[c], -score, r))
        r, c, score = r[by], c[by], score[by]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield ids[r[best]], dids[c[best]], score[best]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(key, is a query, ids, vectors) of runs of alike rows, in order."""
    for batch in batches:
        if not len(batch):
            continue
        key, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(key)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield int(key[a]), bool(side[a]), ids[a:b], matrix(batch.column(3).slice(a, b - a))


def _streamed(k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        for key, is_query, these, vectors in _runs(batches):
            if key != now:
                now, ids, rows = key, [], []
            if not is_query:
                ids.append(these)
                rows.append(vectors)
                continue
            if not ids:
                continue
            if len(ids) > 1:
                ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
            for q, d, s in local_topk(these, vectors, ids[0], rows[0], k, exclude_self):
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())],
                                                 names=["qid", "docid", "score"])

    return run


class Running:
    """The k best passages so far of some queries, ties to smaller ids.

    Products are taken in single precision first; only what may reach a query's k-th score,
    rounding errors included, is scored in double precision.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.q, self.k, self.exclude_self = ids, q, k, exclude_self
        self.q32, self.size = q.astype(np.float32), np.sqrt((q * q).sum(1))
        self.least, self.held = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        self.score, self.docid = np.empty((len(ids), k + CHUNK)), np.empty((len(ids), k + CHUNK), np.int64)

    def meet(self, dids: np.ndarray, p: np.ndarray, live: np.ndarray) -> None:
        """The queries at ``live`` meet passages."""
        rows = max(1, _MEET_SCORES // CHUNK)
        for a in range(0, len(dids), CHUNK):
            these, vectors = dids[a:a + CHUNK], p[a:a + CHUNK]
            for b in range(0, len(live), rows):
                self._meet(these, vectors, live[b:b + rows])

    def _meet(self, dids: np.ndarray, p: np.ndarray, at: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            error = (p.shape[1] + 8) * 2.0 ** -23 * self.size[at] * np.sqrt((p * p).sum(1)).max()
            bound = self.least[at] - error - 10.0 ** -(ROUND - 1)
            s = self.q32[at] @ p.astype(np.float32).T
            hits = np.flatnonzero(~(s < bound[:, None].astype(np.float32)))  # also what is no number in single precision
            r, c = np.divmod(hits, len(dids))
            score = np.round(self._exact(p, at, r, c, hits), ROUND)
        of, docid = at[r], dids[c]
        stay = np.isfinite(score) & (score >= self.least[of])
        if self.exclude_self:
            stay &= self.ids[of] != docid
        score, of, docid = score[stay], of[stay], docid[stay]
        more = np.bincount(of, minlength=len(self.ids))
        full = np.flatnonzero(self.held + more > self.k + CHUNK)
        if len(full):
            self._cut(full)
        place = self.held[of] + np.arange(len(of)) - np.searchsorted(of, of)
        self.score[of, place], self.docid[of, place] = score, docid
        self.held += more
        self._cut(at[(self.held[at] >= self.k) & (self.least[at] == -np.inf)])

    def _exact(self, p: np.ndarray, at: np.ndarray, r: np.ndarray, c: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Products in double precision: all of them where many are asked for."""
        if len(hits) > len(at) * len(p) // 8:
            return (self.q[at] @ p.T).ravel()[hits]
        exact = np.empty(len(hits))
        for lo in range(0, len(hits), _HITS):
            part = slice(lo, lo + _HITS)
            exact[part] = np.einsum("ij,ij->i", self.q[at[r[part]]], p[c[part]])
        return exact

    def _cut(self, rows: np.ndarray) -> None:
        """Only their k best are held of the queries ``rows``, which hold as many."""
        k = self.k
        step = max(1, _MEET_SCORES // (k + CHUNK))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            width = int(self.held[part].max())
            score, docid = self.score[part, :width], self.docid[part, :width]
            score[np.arange(width) >= self.held[part][:, None]] = -np.inf
            kth = np.partition(score, width - k, axis=1)[:, width - k]
            stay, tie = score > kth[:, None], score == kth[:, None]
            need = k - stay.sum(1)
            many = tie.sum(1) > need
            stay |= tie & ~many[:, None]
            for i in np.flatnonzero(many):
                tied = np.flatnonzero(tie[i])
                stay[i, tied[np.argsort(docid[i, tied], kind="stable")[:need[i]]]] = True
            self.score[part, :k], self.docid[part, :k] = score[stay].reshape(-1, k), docid[stay].reshape(-1, k)
            self.held[part], self.least[part] = k, kth

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(qid, docid, score, rank), query by query."""
        step = max(1, _MEET_SCORES // (8 * (self.k + CHUNK)))
        for lo in range(0, len(self.ids), step):
            held = self.held[lo:lo + step]
            r = np.repeat(np.arange(len(held)), held)
            rank = np.arange(len(r)) - np.repeat(np.cumsum(held) - held, held)
            score, docid = self.score[lo + r, rank], self.docid[lo + r, rank]
            by = np.lexsort((docid, -score, r))
            best = rank < self.k
            by = by[best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[lo + r[best]], pa.int64()), pa.array(docid[by], pa.int64()), pa.array(score[by], pa.float64()),
                 pa.array(rank[best] + 1, pa.int64())], names=["qid", "docid", "score", "rank"])


def listed(cells: int):
    """Which queries list a cell, from their lists."""

    def prepared(lists: list[pa.Array]):
        n = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]
        asked = np.zeros((sum(map(len, n)), -(-cells // 8)), np.uint8)
        first = 0
        for x, size in zip(lists, n):
            at, cell = np.repeat(np.arange(len(x)), size) + first, x.flatten().to_numpy()
            np.bitwise_or.at(asked, (at, cell >> 3), (1 << (cell & 7)).astype(np.uint8))
            first += len(x)
        return lambda cell, q, least: asked[:, cell >> 3] & (1 << (cell & 7))

    return prepared


def _ranked(k: int, exclude_self: bool, meets):
    """Rows (key, side, turn, cell, id, vec, cells), of a key queries first, to (qid, docid, score, rank).
    ``meets(lists)(cell, queries, least)`` tells which queries, of these lists of cells, may gain from a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, lists, best, gain = None, [], [], [], None, None
        for batch in batches:
            if not len(batch):
                continue
            key, side, cell, these = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3, 4))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1]) | (side[1:] & (cell[1:] != cell[:-1]))) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if key[a] != now:
                    if best is not None:
                        yield from best.rows()
                    now, ids, rows, lists, best = key[a], [], [], [], None
                vectors = matrix(batch.column(5).slice(a, b - a))
                if not side[a]:
                    ids.append(these[a:b])
                    rows.append(vectors)
                    lists.append(batch.column(6).slice(a, b - a))
                    continue
                if best is None and ids:
                    best, gain = Running(np.concatenate(ids), np.concatenate(rows), k, exclude_self), meets(lists)
                    ids, rows, lists = [], [], []
                if best is not None:
                    best.meet(these[a:b], vectors, np.flatnonzero(gain(int(cell[a]), best.q, best.least)))
        if best is not None:
            yield from best.rows()

    return run


def ranked(queries: DataFrame, passages: DataFrame, blocks: int, k: int, exclude_self: bool, meets) -> DataFrame:
    """``qid, docid, score, rank``: the k best passages (``key, turn, cell, docid, dvec``) of
    every query (``key, qid, qvec`` and perhaps ``cells``) of their key, keys 0 to ``blocks`` - 1, a
    task each. Passages come by ``turn``; those of one ``cell`` have one turn."""
    none = F.lit(None).cast("array<int>").alias("cells")
    both = (queries.select("key", F.lit(False).alias("side"), F.lit(0).alias("turn"), F.lit(0).alias("cell"),
                           F.col("qid").alias("id"), F.col("qvec").alias("vec"), F.col("cells") if "cells" in queries.columns else none)
            .unionByName(passages.select("key", F.lit(True).alias("side"), F.col("turn").cast("int").alias("turn"), F.col("cell").cast("int").alias("cell"),
                                         F.col("docid").alias("id"), F.col("dvec").alias("vec"), none)))
    return (both.repartitionById(blocks, F.col("key").cast("int")).sortWithinPartitions("key", "side", "turn")
            .mapInArrow(_ranked(k, exclude_self, meets), "qid long, docid long, score double, rank long"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of (key, side, ...) so that a key is in one partition, its sides in order."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, "key").sortWithinPartitions("key", "side")


def stream_topk(queries: DataFrame, passages: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``qid, docid, score``: for every (``key, qid, qvec``) the best k of the passages (``key,
    docid, dvec``) of its key. A key's passages are held by one task."""
    both = (passages.select("key", F.lit(False).alias("side"), F.col("docid").alias("id"), F.col("dvec").alias("vec"))
            .unionByName(queries.select("key", F.lit(True).alias("side"), F.col("qid").alias("id"), F.col("qvec").alias("vec"))))
    return dealt(both).mapInArrow(_streamed(k, exclude_self), "qid long, docid long, score double")


def sampled(rows: DataFrame, id_col: str, n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of the ``n`` rows (all, if fewer), chosen by a seeded hash of the id."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of at most k groups of the rows of x (fewer rows: the rows)."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(1) / 2
    rows = max(1, _CHUNK_SCORES // max(len(centres), 1))
    return np.concatenate([np.argmax(x[lo:lo + rows] @ centres.T - half, axis=1) for lo in range(0, len(x), rows)]) if len(x) else np.zeros(0, int)


def blocks_of(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))
