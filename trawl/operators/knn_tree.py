"""Inverted file with a tree of centroids.

A few root centroids are fitted on the driver from a bounded sample; the leaves (the cells)
of each root are fitted by Spark tasks from a larger sample. A row looks at the roots and then
at the leaves of its root only, so fitting and assigning cost rows x root of the cells. Only
the roots are broadcast: leaf centroids travel to the rows of their root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.vector_stream import blocks_of, dealt, kmeans, listed, matrix, nearest, ranked, sampled, stream_topk
from trawl.session import scratch_dir

#: Rows that roots are fitted on (on the driver), that all leaves are fitted on, and of one root.
ROOT_SAMPLE, LEAF_SAMPLE, ONE_ROOT = 16_384, 1_000_000, 65_536
#: Roots a query looks into, at least, and rows of a block of one cell.
ROOTS, BLOCK_ROWS = 8, 32_768
#: Queries that one copy of a cell's rows serves.
QUERY_ROWS = 131_072


def _at_root(roots: np.ndarray, keep: np.ndarray, seed: int, first: np.ndarray, salts: np.ndarray):
    """(id, vec) to (key, side, id, vec): rows at their root, spread over its salts; of a root's
    rows a seeded share ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            root = nearest(matrix(batch.column(1)), roots)
            ids = batch.column(0).to_numpy()
            with np.errstate(over="ignore"):
                h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            stay = pa.array((h >> np.uint64(11)).astype(np.float64) / (1 << 53) < keep[root])
            key = first[root] + (h >> np.uint64(7)).astype(np.int64) % salts[root]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(np.ones(len(ids), np.int32)), batch.column(0), batch.column(1)],
                names=["key", "side", "id", "vec"]).filter(stay)

    return run


def _leaves(first_cell: np.ndarray, n_leaves: np.ndarray, seed: int):
    def run(table: pa.Table) -> pa.Table:
        root = table.column("key")[0].as_py()
        centres = kmeans(matrix(table.sort_by("id").column("vec")), int(n_leaves[root]), seed + root)
        return pa.table({"root": pa.array([root] * len(centres), pa.int64()),
                         "cell": pa.array(int(first_cell[root]) + np.arange(len(centres)), pa.int64()),
                         "vec": pa.array(centres.astype(np.float32).tolist(), pa.list_(pa.float32()))})

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Runs of rows of one key that follow the leaves of that key, with those (cells, sizes) and centroids."""
    now, cells, rows, held = None, [], [], None
    for batch in batches:
        if not len(batch):
            continue
        key, side = (batch.column(c).to_numpy() for c in (0, 1))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if key[a] != now:
                now, cells, rows, held = key[a], [], [], None
            if side[a] == 0:
                cells.append(np.stack([part.column(2).to_numpy(), part.column("size").to_numpy()]))
                rows.append(matrix(part.column(3)))
                continue
            if held is None and cells:
                order = np.argsort(np.concatenate(cells, axis=1)[0])
                held = np.concatenate(cells, axis=1)[:, order], np.concatenate(rows)[order]
            if held is not None:
                yield part, held[0], held[1]


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, cells, centres in _parts(batches):
        at = nearest(matrix(part.column(3)), centres)
        yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(cells[0][at], pa.int64())], names=["docid", "dvec", "cell"])


def _probed(nprobe: int, least: int):
    """A root's part of each query's probes: the best leaves, enough for the whole query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cells, centres in _parts(batches):
            full = cells[1] > 0
            if not full.any():
                continue
            scores = matrix(part.column(3)) @ centres[full].T
            cell, size = cells[0][full], cells[1][full]
            order = np.argsort(-scores, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            r, c = np.nonzero((np.arange(order.shape[1]) < nprobe) | (before < least))
            take = order[r, c]
            yield pa.RecordBatch.from_arrays(
                [part.column(2).take(pa.array(r)), pa.array(cell[take], pa.int64()), pa.array(size[take], pa.int64()), pa.array(scores[r, take])],
                names=["qid", "cell", "size", "near"])

    return run


def _to_roots(roots: np.ndarray, rows: np.ndarray, leaves: np.ndarray, nprobe: int, least: int):
    """Queries to the roots they look into: the best, at least ROOTS, until they hold enough
    rows and leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch.column(1))
            order = np.argsort(-(q @ roots.T), axis=1, kind="stable")
            before, cells = (np.cumsum(x[order], axis=1) - x[order] for x in (rows, leaves))
            r, c = np.nonzero((np.arange(order.shape[1]) < ROOTS) | (before < 2 * least) | (cells < nprobe))
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(order[r, c].astype(np.int64)), pa.array(np.ones(len(r), np.int32)),
                                              batch.column(0).take(at), batch.column(1).take(at)], names=["key", "side", "id", "vec"])

    return run


_ROWS = "key long, side int, id long, vec array<float>"


class Tree:
    """Cells of ``passages`` (``docid, dvec``), written to the shared folder, for any queries.

    ``nlist`` cells at most, shared among the roots by their rows, so a root that holds a
    third of all rows has a third of the cells. Vectors have one length and no nulls.
    """

    def __init__(self, passages: DataFrame, nlist: int, n: int, seed: int = 42):
        self.spark = spark = passages.sparkSession
        rows = passages.select("docid", "dvec")
        sample = sampled(rows, "docid", n, ROOT_SAMPLE, seed).select("dvec").toArrow()  # about ROOT_SAMPLE rows
        if not len(sample):
            sample = rows.limit(1).select("dvec").toArrow()
        x = matrix(sample.column(0))
        self.roots = roots = kmeans(x, max(1, math.isqrt(nlist)), seed)
        share = np.bincount(nearest(x, roots), minlength=len(roots)) / len(x)
        leaves = 1 + np.floor(share * max(0, nlist - len(roots))).astype(np.int64)
        first_cell = np.cumsum(leaves) - leaves
        self.cells, self.root_leaves = int(leaves.sum()), leaves
        one = np.ones(len(roots), np.int64)
        keep = np.minimum(1.0, ONE_ROOT / np.maximum(share * min(n, LEAF_SAMPLE), 1))
        path = scratch_dir(spark, "tree")
        (sampled(rows, "docid", n, LEAF_SAMPLE, seed + 1)
         .mapInArrow(_at_root(roots, keep, seed, np.arange(len(roots)), one), _ROWS).groupBy("key")
         .applyInArrow(_leaves(first_cell, leaves, seed), "root long, cell long, vec array<float>").write.parquet(f"{path}/leaves"))
        self.leaves = spark.read.parquet(f"{path}/leaves")
        parts = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        salts = np.maximum(1, np.round(share * parts)).astype(np.int64)  # a large root is many tasks
        first = np.cumsum(salts) - salts
        spreads = spark.createDataFrame(pa.table({"root": np.arange(len(roots)), "first": first, "n": salts}), "root long, first long, n long")
        centroids = self.leaves.join(F.broadcast(spreads), "root").select(
            F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("key"),
                                       F.lit(0).alias("side"), F.col("cell").alias("id"), "vec", F.lit(0).cast("long").alias("size"))
        placed = rows.mapInArrow(_at_root(roots, np.ones(len(roots)), seed + 2, first, salts), _ROWS)
        both = centroids.unionByName(placed.withColumn("size", F.lit(None).cast("long")))
        dealt(both).mapInArrow(_assigned, "docid long, dvec array<float>, cell long").write.parquet(f"{path}/cells")
        self.placed = spark.read.parquet(f"{path}/cells")
        self.sizes = np.zeros(self.cells, np.int64)
        for r in self.placed.groupBy("cell").count().collect():  # one number a cell
            self.sizes[r["cell"]] = r["count"]
        self.root_rows = np.add.reduceat(self.sizes, first_cell)

    def probes(self, queries: DataFrame, nprobe: int, least: int) -> DataFrame:
        """``qid, cell`` of the cells that queries (``qid, qvec``) look into: the best
        ``nprobe``, and more until they hold ``least`` passages."""
        spark = self.spark
        sizes = spark.createDataFrame(self._sized(), "cell long, size long")
        leaves = self.leaves.join(F.broadcast(sizes), "cell").select(
            F.col("root").alias("key"), F.lit(0).alias("side"), F.col("cell").alias("id"), "vec", "size")
        looking = queries.select("qid", "qvec").mapInArrow(_to_roots(self.roots, self.root_rows, self.root_leaves, nprobe, least), _ROWS)
        parts = dealt(leaves.unionByName(looking.withColumn("size", F.lit(None).cast("long"))))
        found = parts.mapInArrow(_probed(nprobe, least), "qid long, cell long, size long, near double")
        best = Window.partitionBy("qid").orderBy(F.desc("near"), "cell")
        before = F.coalesce(F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = found.withColumn("_rank", F.row_number().over(best)).withColumn("_before", before)
        return ranked.where((F.col("_rank") <= nprobe) | (F.col("_before") < least)).select("qid", "cell")

    def _sized(self) -> pa.Table:
        return pa.table({"cell": np.arange(self.cells), "size": self.sizes})

    def search(self, queries: DataFrame, probes: DataFrame, k: int, exclude_self: bool, n_queries: int) -> DataFrame:
        """``qid, docid, score``: the k best of every block of a query's cells. A cell of more than
        BLOCK_ROWS rows is several blocks, and each serves QUERY_ROWS queries."""
        salts = blocks_of(n_queries, QUERY_ROWS)
        splits = np.maximum(1, -(-self.sizes // BLOCK_ROWS))
        first = np.cumsum(splits) - splits
        table = self.spark.createDataFrame(
            pa.table({"cell": np.arange(self.cells), "first": first, "n": splits}), "cell long, first long, n long")
        salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        blocks = self.placed.join(F.broadcast(table), "cell").select(
            (F.col("first") + F.pmod(F.xxhash64("docid"), F.col("n"))).alias("block"), "docid", "dvec", salt)
        meets = (probes.join(F.broadcast(table), "cell").select("qid", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block"))
                 .join(queries.select("qid", "qvec"), "qid"))
        key = (F.col("block") * salts).cast("long")
        return stream_topk(meets.select((key + F.pmod(F.xxhash64("qid"), F.lit(salts))).alias("key"), "qid", "qvec"),
                           blocks.select((key + F.col("salt")).alias("key"), "docid", "dvec"), k, exclude_self)

    def search_held(self, queries: DataFrame, probes: DataFrame, k: int, exclude_self: bool, blocks: int) -> DataFrame:
        """What ``search`` gives, where queries look into many cells: ``blocks`` tasks hold the k best
        of their queries so far, and all passages go past each. A query travels once, with its cells."""
        asked = probes.groupBy("qid").agg(F.collect_list(F.col("cell").cast("int")).alias("cells"))
        copy = F.pmod(F.xxhash64("qid", "qvec"), F.lit(blocks)).cast("int")
        mine = queries.select("qid", "qvec").join(asked, "qid").select(copy.alias("key"), "qid", "qvec", "cells")
        theirs = self.placed.select("docid", "dvec", "cell", F.col("cell").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("key"))
        return ranked(mine, theirs, blocks, k, exclude_self, listed(self.cells)).drop("rank")
