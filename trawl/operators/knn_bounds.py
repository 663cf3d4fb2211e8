"""Exact nearest neighbours that skip blocks by their bounds.

Passages lie in cells of close vectors, each with a centre and a radius. No passage of a cell
can score more than q.centre + |q| * radius. Queries of close cells share a task, which holds
the k best of each so far; passages come cell by cell, those of the queries' own cells first, and
a query meets only cells whose bound reaches its k-th score. Centres come from a bounded sample,
which the result does not depend on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.vector_stream import CHUNK, ROUND, blocks_of, kmeans, matrix, ranked, sampled, stream_topk
from trawl.session import scratch_dir

#: Rows that centres are fitted on, and most cells; their centres are broadcast.
SAMPLE, MOST_CELLS = 16_384, 1024
#: Rows of a block, and queries that one copy of a block serves.
BLOCK_ROWS, QUERY_ROWS = 8192, 131_072
#: Bytes of the queries, scores and ids that a task holds, and its queries at most and at least.
STATE, MOST_QUERIES, LEAST_QUERIES = 200_000_000, 32_768, 256
_SLACK = 10.0 ** -(ROUND - 1)


def query_blocks(n: int, k: int, tasks: int, dims: int) -> int:
    """Into how many blocks ``n`` queries of ``dims`` components are dealt: each holds its state in
    memory, and there is one for each of the ``tasks`` that run at once where queries suffice."""
    rows = min(MOST_QUERIES, max(1, STATE // (16 * (k + CHUNK) + 12 * dims)))
    least = max(1, -(-n // rows))
    return max(least, min(-(-least // tasks) * tasks, n // LEAST_QUERIES))


def numbered(queries: DataFrame) -> tuple[DataFrame, bool]:
    """``qid, qvec, copy`` and whether every qid comes once; copies of a qid are numbered, so
    that many are dealt over many blocks."""
    if queries.groupBy("qid").count().where("count > 1").isEmpty():
        return queries.select("qid", "qvec", F.lit(0).alias("copy")), True
    return queries.select("qid", "qvec", F.row_number().over(Window.partitionBy("qid").orderBy(F.xxhash64("qvec"))).alias("copy")), False


def _reached(shared):
    """Which queries may gain from a cell, by its bound."""

    def reached(cell: int, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        centres, radius, _ = shared.value
        with np.errstate(over="ignore", invalid="ignore"):  # a bound that is no number skips nothing
            return ~(q @ centres[cell] + np.sqrt((q * q).sum(1)) * radius[cell] * (1 + 1e-12) < least - _SLACK)

    return lambda lists: reached


def _cells(centres: np.ndarray):
    """(docid, dvec) to (docid, dvec, cell, far): the nearest centre and the distance to it."""
    half = (centres * centres).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            cell = np.argmax(x @ centres.T - half, axis=1)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far)],
                                             names=["docid", "dvec", "cell", "far"])

    return run


def _homes(scores: np.ndarray, rows: np.ndarray, need: int) -> np.ndarray:
    """Which cells are a query's homes: the best by centre until they hold ``need`` rows."""
    order = np.argsort(-scores, axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    home = np.zeros(scores.shape, dtype=bool)
    np.put_along_axis(home, order, before < need, axis=1)
    return home & (rows > 0)


def _routed(shared, need: int, splits: np.ndarray, salts: int, bounded: bool):
    """Queries to the blocks they meet: their homes, or, with a threshold, the others whose
    bound reaches it."""
    first = np.concatenate([[0], np.cumsum(splits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, rows = shared.value
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch.column(1))
            scores = q @ centres.T
            meet = _homes(scores, rows, need)
            if bounded:
                least = batch.column(2).to_numpy(zero_copy_only=False)
                reach = scores + np.sqrt((q * q).sum(1))[:, None] * radius * (1 + 1e-12)
                meet = ~meet & (rows > 0) & (reach >= least[:, None] - _SLACK)
            at, cell = np.nonzero(meet)
            times = splits[cell]
            at = np.repeat(at, times)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            block = np.repeat(first[cell], times) + inside
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            salt = np.asarray(ids.to_numpy()) % salts
            yield pa.RecordBatch.from_arrays([pa.array(block * salts + salt, pa.int64()), ids, batch.column(1).take(pa.array(at, pa.int64()))],
                                             names=["key", "qid", "qvec"])

    return run


class BoundedSearch:
    """Blocks of ``passages`` (``docid, dvec``) with bounds, and the two passes of ``queries``
    (``qid, qvec``) over them. Vectors have one length and no nulls."""

    def __init__(self, queries: DataFrame, passages: DataFrame, k: int, exclude_self: bool, *, seed: int = 42,
                 block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, n_queries: int | None = None, n_passages: int | None = None):
        spark = passages.sparkSession
        self.queries, self.k, self.exclude_self = queries.select("qid", "qvec"), k, exclude_self
        n = passages.count() if n_passages is None else n_passages
        nq = queries.count() if n_queries is None else n_queries
        self.n, self.nq = n, nq
        self.empty = n == 0 or nq == 0
        if self.empty:
            return
        sample = sampled(passages.select("docid", "dvec"), "docid", n, SAMPLE, seed).select("dvec").toArrow()  # about SAMPLE rows
        if not len(sample):
            sample = passages.limit(1).select("dvec").toArrow()
        centres = kmeans(matrix(sample.column(0)), min(MOST_CELLS, blocks_of(n, block_rows) * 4), seed)
        path = scratch_dir(spark, "blocks")
        passages.select("docid", "dvec").mapInArrow(_cells(centres), "docid long, dvec array<float>, cell int, far double").write.parquet(path)
        self.placed = placed = spark.read.parquet(path)
        radius, rows = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
            radius[r["cell"]], rows[r["cell"]] = r["far"], r["n"]
        self.splits = np.maximum(1, -(-rows // block_rows))
        self.salts = blocks_of(nq, query_rows)
        self.rows = rows
        self.need = k + int(exclude_self)
        self.shared = spark.sparkContext.broadcast((centres, radius, rows))
        cells = spark.createDataFrame(pa.table({"cell": np.arange(len(centres), dtype=np.int32), "first": np.cumsum(self.splits) - self.splits,
                                                "n": self.splits}), "cell int, first long, n long")
        block = F.col("first") + F.pmod(F.xxhash64("docid"), F.col("n"))
        salt = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt")
        self.blocks = placed.join(F.broadcast(cells), "cell").select(block.alias("block"), "docid", "dvec", salt).select(
            (F.col("block") * self.salts + F.col("salt")).cast("long").alias("key"), "docid", "dvec")

    def ranked(self) -> tuple[DataFrame, bool]:
        """``qid, docid, score, rank`` of each query's k best, and whether ranks are final: of a
        qid that comes more than once each copy has its own."""
        spark = self.queries.sparkSession
        k, (centres, _, rows) = min(self.k, self.n), self.shared.value
        queries, once = numbered(self.queries)
        path = scratch_dir(spark, "query-cells")
        (queries.select(F.struct("qid", "copy").alias("docid"), F.col("qvec").alias("dvec"))
         .mapInArrow(_cells(centres), "docid struct<qid:long,copy:int>, dvec array<float>, cell int, far double")
         .select("docid.qid", "docid.copy", F.col("dvec").alias("qvec"), "cell").write.parquet(path))
        placed = spark.read.parquet(path)
        size = np.zeros(len(centres), np.int64)
        for r in placed.groupBy("cell").count().collect():  # a row a cell
            size[r["cell"]] = r["count"]
        before = np.cumsum(size) - size
        blocks = query_blocks(self.nq, k, spark.sparkContext.defaultParallelism, centres.shape[1])
        cells = spark.createDataFrame(pa.table({"cell": np.arange(len(centres), dtype=np.int32), "before": before, "n": size}), "cell int, before long, n long")
        at = F.col("before") + F.floor(F.pmod(F.xxhash64("qid", "copy"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n"))
        mine = placed.join(F.broadcast(cells), "cell").select(F.floor(at * F.lit(blocks) / F.lit(self.nq)).cast("int").alias("key"), "qid", "qvec")
        own = np.searchsorted(before, np.arange(blocks) * self.nq // blocks, "right") - 1  # the first cell of a block's queries
        turns = spark.createDataFrame(pa.table({"key": np.arange(blocks, dtype=np.int32), "own": own.astype(np.int32)}), "key int, own int")
        theirs = (self.placed.select("docid", "dvec", "cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("key"))
                  .join(F.broadcast(turns), "key").select("key", F.pmod(F.col("cell") - F.col("own"), F.lit(len(centres))).alias("turn"), "cell", "docid", "dvec"))
        return ranked(mine, theirs, blocks, k, self.exclude_self, _reached(self.shared)), once

    def _route(self, rows: DataFrame, bounded: bool) -> DataFrame:
        return rows.mapInArrow(_routed(self.shared, self.need, self.splits, self.salts, bounded), "key long, qid long, qvec array<float>")

    def homes(self) -> DataFrame:
        """``key, qid, qvec``: queries at the blocks of their homes."""
        return self._route(self.queries, False)

    def first(self) -> DataFrame:
        """``qid, docid, score`` of the k best of each block of a query's homes."""
        return stream_topk(self.homes(), self.blocks, self.k, self.exclude_self)

    def survivors(self, found: DataFrame) -> DataFrame:
        """``key, qid, qvec``: queries at the further blocks whose bound reaches the k-th score of ``found``."""
        least = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= self.k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        rows = self.queries.join(least, "qid", "left").select("qid", "qvec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        return self._route(rows, True)

    def pairs_met(self, found: DataFrame) -> tuple[int, int]:
        """(query-block pairs that are scored, all such pairs)."""
        met = self.homes().count() + self.survivors(found).count()
        return met, self.queries.count() * int(self.splits[self.rows > 0].sum())
