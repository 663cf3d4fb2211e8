"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Rows are dealt to blocks of bounded size. A block holds one sorted array of long hash
strings (signs of random projections) per tree. A query descends in every tree to its
longest-prefix matches, then ascends in all trees at the same depth until the shared
prefixes hold enough candidates; these are compared exactly. Every block is searched for
every query, and the blocks' best are merged, so the share of true neighbours found does
not fall as rows are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import scratch_dir

#: Trees, bits of a hash string, most rows of a block and queries of a task (about; rows
#: are dealt by hash), and candidates (counted in each tree) at which the ascent stops.
TREES, BITS, BLOCK_ROWS, QUERY_ROWS, CANDIDATES = 128, 32, 8192, 8192, 4096


class Forest:
    """Sorted hash strings of unit vectors, one array per tree."""

    def __init__(self, unit: np.ndarray, seed: int = 11):
        self.centre = unit.mean(0)
        self.planes = np.random.default_rng(seed).standard_normal((TREES, unit.shape[1], BITS)).astype(np.float32)
        self.order, self.sorted = [], []
        for h in self.hashes(unit):
            by = np.argsort(h, kind="stable")
            self.order.append(by)
            self.sorted.append(h[by])

    def hashes(self, unit: np.ndarray):
        """The hash strings of vectors, tree by tree."""
        x = (unit - self.centre).astype(np.float32)
        place = (1 << np.arange(BITS - 1, -1, -1)).astype(np.uint64)
        for planes in self.planes:
            yield ((x @ planes) > 0).astype(np.float32).dot(place.astype(np.float64)).astype(np.uint64)

    def candidates(self, queries: np.ndarray, enough: int) -> list[np.ndarray]:
        """Row numbers of each query's candidates, ascending from the longest matches."""
        hashed = list(self.hashes(queries))
        n = len(queries)
        low, high = np.zeros((TREES, n), np.int64), np.zeros((TREES, n), np.int64)
        todo = np.arange(n)
        # descend: no prefix longer than the longest match in any tree needs a look
        longest = np.zeros(n, np.int64)
        for h, q in zip(self.sorted, hashed):
            at = np.searchsorted(h, q)
            for near in (np.minimum(at, len(h) - 1), np.maximum(at - 1, 0)):
                differ = h[near] ^ q
                longest = np.maximum(longest, BITS - np.frexp(differ.astype(np.float64))[1])
        # ascend in all trees at once
        for depth in range(int(longest.max(initial=0)), -1, -1):
            here = todo[longest[todo] >= depth]
            if not len(here):
                continue
            tail = np.uint64((1 << (BITS - depth)) - 1)
            total = np.zeros(len(here), np.int64)
            for t, (h, q) in enumerate(zip(self.sorted, hashed)):
                low[t, here] = np.searchsorted(h, q[here] & ~tail)
                high[t, here] = np.searchsorted(h, q[here] | tail, "right")
                total += high[t, here] - low[t, here]
            todo = np.setdiff1d(todo, here[total >= enough])
            if not len(todo):
                break
        found = []
        for k in range(n):
            mark = np.zeros(len(self.order[0]), bool)
            for t in range(TREES):
                mark[self.order[t][low[t, k]:high[t, k]]] = True
            found.append(np.flatnonzero(mark))
        return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _search(k: int, enough: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            rows, queries = _matrix(left.column("vector")), _matrix(right.column("vector"))
            size, qsize = np.sqrt((rows * rows).sum(1)), np.sqrt((queries * queries).sum(1))
            members, names = left.column("ids").to_pylist(), right.column("query_id").to_pylist()
            unit_rows, unit_queries = rows / size[:, None], queries / qsize[:, None]
            for j, cand in enumerate(Forest(unit_rows).candidates(unit_queries, enough)):
                score = (rows[cand] @ queries[j]) / (size[cand] * qsize[j])
                if len(cand) > k + 1:  # ties with the last one stay
                    edge = np.partition(score, -(k + 1))[-(k + 1)]
                    cand, score = cand[score >= edge], score[score >= edge]
                best = sorted((-s, i) for c, s in zip(cand.tolist(), score.tolist()) for i in members[c] if i != names[j])[:k]
                out["query_id"] += [names[j]] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    return run


def valid(vector: str):
    """Vectors that take part: not null, not empty, all components finite, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            enough: int = CANDIDATES) -> DataFrame:
    """Each query's ``k`` nearest rows found: query_id, rank, vec_id, score (cosine, double).

    ``queries`` has the same columns as ``rows``; a row of the query's own id is not a
    candidate. Invalid vectors (see ``valid``) and null ids take no part; vectors of
    another length than a query's are no candidates of it; a repeated (id, vector) counts
    once. Ties go to the smaller id. Equal vectors are one index entry that keeps the
    k + 1 smallest ids, the only ones that can be among the k nearest, so a vector that
    fills a third of the table costs one entry. No queries or rows: no result.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "forest")

    def clean(df):
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
            F.col("id").isNotNull() & valid("vector"))

    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = (clean(rows).distinct().withColumn("at", first).where(F.col("at") <= k + 1)
               .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    entries.write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    asked = clean(queries).distinct().select(F.col("id").alias("query_id"), "vector")
    asked.write.parquet(f"{path}/queries")
    asked = spark.read.parquet(f"{path}/queries")
    blocks = max(1, -(-entries.count() // BLOCK_ROWS))
    lots = max(1, -(-asked.count() // QUERY_ROWS))
    left = entries.select("ids", "vector", F.size("vector").alias("dim"),
                          F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    right = asked.select("query_id", "vector", F.size("vector").alias("dim"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                         F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int").alias("lot"))
    found = left.groupBy("dim", "block", "lot").cogroup(right.groupBy("dim", "block", "lot")).applyInArrow(
        _search(k, enough), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
