"""Nearest-neighbour joins over unit vectors (inner product = cosine).

Neither join materialises query x passage pairs as rows. Small exact joins use
``blocked_topk``: queries and passages that share a grouping key are split into bounded
blocks by hashing their ids. Large ones skip blocks by bounds (``knn_bounds``), and the
approximate join looks into a few cells (``knn_tree``).

In ``blocked_topk`` every (query block, passage block) pair meets in one grouped task, which scores the block with one BLAS matrix product and emits only its local top-k
per query. A ``row_number() <= k`` window (planned as a partial + final
WindowGroupLimit) then merges the local lists. Block sizes come from per-key counts,
so a hot key (a cell holding a third of all vectors) is split like any other and no
task holds more than ``max_query_rows x max_passage_rows`` scores.

Scores are rounded to 9 decimals before ranking; ties break by docid ascending.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.knn_bounds import BoundedSearch, query_blocks
from trawl.operators.knn_tree import Tree

_SCORED_SCHEMA = "qid long, docid long, score double"
# rows scored per BLAS call inside a task: 512 x block passages x 8 bytes
_QUERY_CHUNK = 512
_MIN_QUERY_BLOCK = 64
_ROUND = 9
#: The probed cells of a query hold at least this many times k passages.
PROBE_ROWS = 32
#: Pairs of blocks up to which the exact join scores all of them without building bounds.
FEW_PAIRS = 16
#: Pairs of a query and a cell up to which queries travel to cells.
HELD_PAIRS = 1_000_000


def _local_topk(k: int, exclude_self: bool):
    """Group body: score one (query block, passage block) pair, keep local top-k.

    The group holds both sides, tagged by ``_isq`` (True = query row)."""

    def run(both: pd.DataFrame) -> pd.DataFrame:
        isq = both["_isq"].to_numpy(bool)
        qdf = both.loc[isq, ["_id", "_vec"]].rename(columns={"_id": "qid", "_vec": "qvec"})
        pdf = both.loc[~isq, ["_id", "_vec"]].rename(columns={"_id": "docid", "_vec": "dvec"})
        if qdf.empty or pdf.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "docid": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        qids = qdf["qid"].to_numpy(np.int64)
        dids = pdf["docid"].to_numpy(np.int64)
        qm = np.stack(qdf["qvec"].to_numpy()).astype(np.float64)
        pm = np.stack(pdf["dvec"].to_numpy()).astype(np.float64)
        out_q, out_d, out_s = [], [], []
        for start in range(0, len(qids), _QUERY_CHUNK):
            qs = qids[start:start + _QUERY_CHUNK]
            s = qm[start:start + _QUERY_CHUNK] @ pm.T
            if exclude_self:
                s[qs[:, None] == dids[None, :]] = -np.inf
            if k < s.shape[1]:
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                # keep everything that could tie with the k-th score after rounding
                keep = s >= (kth - 10.0 ** -(_ROUND - 1))[:, None]
            else:
                keep = np.ones_like(s, dtype=bool)
            keep &= np.isfinite(s)
            r, c = np.nonzero(keep)
            rounded = np.round(s[r, c], _ROUND)
            by = np.lexsort((dids[c], -rounded, r))
            r, c = r[by], c[by]
            first = np.searchsorted(r, r)  # of ties with the k-th score only the smallest ids stay
            best = np.arange(len(r)) - first < k
            r, c = r[best], c[best]
            out_q.append(qs[r])
            out_d.append(dids[c])
            out_s.append(s[r, c])
        return pd.DataFrame({"qid": np.concatenate(out_q), "docid": np.concatenate(out_d),
                             "score": np.concatenate(out_s)})

    return run


def blocked_topk(queries: DataFrame, passages: DataFrame, k: int, *, keys: list[str] | None = None,
                 exclude_self: bool = False, max_query_rows: int = 2048,
                 max_passage_rows: int = 32768, counts: tuple[int, int] | None = None) -> DataFrame:
    """Top-k passages per query among passages sharing ``keys`` with the query.

    ``counts``: rows of both sides, where the caller knows them. queries: ``qid long, qvec array<float>`` (+ keys); passages: ``docid long,
    dvec array<float>`` (+ keys). Returns ``qid, docid, score, rank`` (rank 1-based).
    """
    if k <= 0:
        raise ValueError("k must be positive")
    keys = list(keys or [])
    if not keys:
        # one group: block counts are two driver scalars (row counts), used as literals.
        # Blocks are bounded by the row limits, and queries are cut further (down to
        # _MIN_QUERY_BLOCK rows) until there are about two blocks per core, so small
        # inputs still use the whole cluster.
        nq, npass = counts or (queries.count(), passages.count())
        target = 2 * queries.sparkSession.sparkContext.defaultParallelism
        qb = max(1, math.ceil(nq / max_query_rows), min(target, math.ceil(nq / _MIN_QUERY_BLOCK)))
        pb = max(1, math.ceil(npass / max_passage_rows))
        keys = ["_key"]
        q = (queries.select(F.lit(0).alias("_key"), "qid", "qvec")
             .withColumn("_qs", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int"))
             .withColumn("_ps", F.explode(F.sequence(F.lit(0), F.lit(pb - 1)))))
        p = (passages.select(F.lit(0).alias("_key"), "docid", "dvec")
             .withColumn("_ps", F.pmod(F.xxhash64("docid"), F.lit(pb)).cast("int"))
             .withColumn("_qs", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    else:
        qcount = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nq"))
        pcount = passages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_np"))
        # one row per key: how many blocks each side of that key is cut into
        sizes = qcount.join(pcount, keys).select(
            *keys,
            F.ceil(F.col("_nq") / F.lit(max_query_rows)).cast("int").alias("_qb"),
            F.ceil(F.col("_np") / F.lit(max_passage_rows)).cast("int").alias("_pb"),
        )
        q = (queries.join(sizes, keys)
             .withColumn("_qs", F.pmod(F.xxhash64("qid"), F.col("_qb")).cast("int"))
             .withColumn("_ps", F.explode(F.sequence(F.lit(0), F.col("_pb") - 1))))
        p = (passages.join(sizes, keys)
             .withColumn("_ps", F.pmod(F.xxhash64("docid"), F.col("_pb")).cast("int"))
             .withColumn("_qs", F.explode(F.sequence(F.lit(0), F.col("_qb") - 1))))
    q = q.select(*keys, "_qs", "_ps", "qid", "qvec")
    p = p.select(*keys, "_qs", "_ps", "docid", "dvec")
    # both sides in one frame, tagged, so one grouped kernel sees a (query block,
    # passage block) pair per group
    both = (q.select(*keys, "_qs", "_ps", F.col("qid").alias("_id"), F.col("qvec").alias("_vec"),
                     F.lit(True).alias("_isq"))
            .unionByName(p.select(*keys, "_qs", "_ps", F.col("docid").alias("_id"), F.col("dvec").alias("_vec"),
                                  F.lit(False).alias("_isq"))))
    # one group is one (query block, passage block) pair, so tasks grow with the passages
    # even for a single query; k rows per query leave each group
    group = [*keys, "_qs", "_ps"]
    local = both.groupBy(*group).applyInPandas(_local_topk(k, exclude_self), _SCORED_SCHEMA)
    return rank_topk(local.withColumn("score", F.round("score", _ROUND)), k)


def rank_topk(scored: DataFrame, k: int | None, *, part: str = "qid", order_id: str = "docid",
              score: str = "score") -> DataFrame:
    """1-based ``rank`` by score desc, id asc; keep rank <= k (all rows when k is falsy)."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(order_id).asc())
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= k) if k else ranked


def knn_join_exact(queries: DataFrame, passages: DataFrame, k: int, *, exclude_self: bool = False,
                   max_query_rows: int = 2048, max_passage_rows: int = 32768, prune: bool | None = None) -> DataFrame:
    """Exact inner-product top-k per query (flat index semantics).

    Beyond FEW_PAIRS pairs of a query block and a passage block, or with ``prune``, passages
    lie in cells of close vectors that are skipped by their bounds (``knn_bounds``); a task holds
    the k best of its queries, so only the result's rows leave it. Both ways give the same rows.
    """
    counts = None
    if prune is None:
        counts = nq, n = queries.count(), passages.count()
        prune = math.ceil(nq / max_query_rows) * math.ceil(n / max_passage_rows) > FEW_PAIRS
    if not prune:
        return blocked_topk(queries, passages, k, exclude_self=exclude_self,
                            max_query_rows=max_query_rows, max_passage_rows=max_passage_rows, counts=counts)
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    search = BoundedSearch(queries, passages, k, exclude_self, n_queries=counts and counts[0], n_passages=counts and counts[1])
    if search.empty:
        return spark.createDataFrame([], "qid long, docid long, score double, rank long")
    found, final = search.ranked()
    return found if final else rank_topk(found.drop("rank"), k)


def ivf_params(n: int) -> tuple[int, int]:
    """Cell count and probe count for ``n`` passages (fixed rule of the reference index)."""
    nlist = max(int(4 * (n ** 0.5)), 256)
    nprobe = max(32, nlist // 128)
    return nlist, nprobe


def knn_join_ivf(queries: DataFrame, passages: DataFrame, k: int, *, exclude_self: bool = False,
                 nlist: int | None = None, nprobe: int | None = None, seed: int = 42,
                 probe_rows: int | None = None) -> DataFrame:
    """Inverted-file approximate top-k over a tree of centroids (``knn_tree``).

    Every passage is in one cell. Queries look into their ``nprobe`` best cells, and more
    until those hold ``probe_rows`` passages (PROBE_ROWS * k unless given), so every query
    with k candidates gets k rows; scores are exact. Centroids are fitted on bounded
    samples. No passages: no rows.
    """
    n, nq = passages.count(), queries.count()
    if n == 0 or nq == 0:
        return passages.sparkSession.createDataFrame([], "qid long, docid long, score double, rank long")
    dn, dp = ivf_params(n)
    tree = Tree(passages, nlist or dn, n, seed)
    least = max(k, PROBE_ROWS * k if probe_rows is None else probe_rows) + int(exclude_self)
    probes = tree.probes(queries, nprobe or dp, least)
    looks = max(nprobe or dp, math.ceil(least * tree.cells / n))  # cells that a query looks into, about
    blocks = query_blocks(nq, min(k, n), passages.sparkSession.sparkContext.defaultParallelism, tree.roots.shape[1])
    if nq * looks > HELD_PAIRS and nq * looks > n * blocks:
        return rank_topk(tree.search_held(queries, probes, min(k, n), exclude_self, blocks), k)
    return rank_topk(tree.search(queries, probes, k, exclude_self, nq), k)


def knn_recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean over queries of |approx top-k ∩ exact top-k| / |exact top-k|."""
    a = approx.where(F.col("rank") <= k).select("qid", "docid")
    e = exact.where(F.col("rank") <= k).select("qid", "docid")
    per_q = (e.join(a.withColumn("_hit", F.lit(1)), ["qid", "docid"], "left")
             .groupBy("qid").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall")))
    return per_q.agg(F.round(F.avg("recall"), 6).alias("knn_recall"),
                     F.count(F.lit(1)).alias("num_queries"))
