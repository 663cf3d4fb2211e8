"""Scoring and ranking.

A scorer is either
* a Column function ``(query_col, passage_col) -> Column`` — stays in the JVM inside
  whole-stage codegen (the default: token overlap), or
* a batch callable ``list[(query, passage)] -> sequence[float]`` (a cross-encoder's
  ``predict``), run with ``mapInPandas`` so pairs cross to Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trawl.functions.vectors import dot
from trawl.operators.joins import candidate_pairs
from trawl.operators.knn import knn_join_exact, rank_topk
from trawl.operators.lexical import tokens


def token_overlap(query: Column, passage: Column, digits: int = 6) -> Column:
    """Share of distinct query tokens present in the passage, in [0, 1]."""
    q = F.array_distinct(tokens(query))
    p = F.array_distinct(tokens(passage))
    return F.round(F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1)), digits)


def pair_length(query_col: str = "query", passage_col: str = "passage") -> Column:
    """Characters of a pair (null texts: none), which a batch is padded by."""
    return F.coalesce(F.length(query_col), F.lit(0)) + F.coalesce(F.length(passage_col), F.lit(0))


def by_length(pairs: DataFrame, query_col: str = "query", passage_col: str = "passage") -> DataFrame:
    """``pairs`` range-partitioned and sorted by length, so that a batch holds pairs of like
    length. Equal lengths are spread by a hash of the pair; a pair's columns travel with it."""
    size, spread = pair_length(query_col, passage_col), F.xxhash64(query_col, passage_col)
    return pairs.repartitionByRange(size, spread).sortWithinPartitions(size, spread)


def padding(pairs: DataFrame, batch_rows: int, query_col: str = "query", passage_col: str = "passage") -> DataFrame:
    """One row: ``characters`` of the pairs as they lie and ``padded``, what batches of
    ``batch_rows`` hold once every pair is as long as its batch's longest."""
    def run(it):
        for pdf in it:
            size = pdf["_size"].to_numpy()
            for lo in range(0, len(size), batch_rows):
                part = size[lo:lo + batch_rows]
                yield pd.DataFrame({"characters": [int(part.sum())], "padded": [int(part.max()) * len(part)]})

    sizes = pairs.select(pair_length(query_col, passage_col).alias("_size"))
    return sizes.mapInPandas(run, "characters long, padded long").agg(
        F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"), F.coalesce(F.sum("padded"), F.lit(0)).alias("padded"))


def score_pairs(pairs: DataFrame, scorer: Callable | None = None, *, batch: bool = False, batch_rows: int = 256,
                sort_by_length: bool = True, query_col: str = "query", passage_col: str = "passage") -> DataFrame:
    """Add ``score`` to ``pairs``.

    ``batch=False``: ``scorer(query_col, passage_col) -> Column``.
    ``batch=True``: ``scorer(list_of_pairs) -> scores`` of up to ``batch_rows`` pairs at a
    time, in order of length unless ``sort_by_length`` is off (one shuffle of the pairs, so
    that a model pads little).
    """
    scorer = scorer or token_overlap
    if not batch:
        return pairs.withColumn("score", scorer(F.col(query_col), F.col(passage_col)).cast("double"))
    out_schema = StructType([*pairs.schema.fields, StructField("score", DoubleType())])

    def run(it):
        for pdf in it:
            for lo in range(0, len(pdf), batch_rows):
                part = pdf.iloc[lo:lo + batch_rows]
                s = scorer(list(zip(part[query_col].tolist(), part[passage_col].tolist(), strict=True)))
                yield part.assign(score=np.asarray(s, dtype=np.float64))

    return (by_length(pairs, query_col, passage_col) if sort_by_length else pairs).mapInPandas(run, out_schema)


def rerank(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """R2: rank by score desc, docid asc; ``top_n`` falsy keeps all."""
    return rank_topk(scored, top_n)


def rerank_numbered(scored: DataFrame, top_n: int | None = None, digits: int = 4) -> DataFrame:
    """1-based ``rank`` and the score rounded to ``digits`` decimals."""
    return rerank(scored, top_n).withColumn("score", F.round("score", digits))


def overlap_rerank(run: DataFrame, queries: DataFrame, collection: DataFrame, top_n: int | None = None) -> DataFrame:
    """Rerank a candidate run with the token-overlap scorer: ``qid, docid, score, rank``."""
    pairs = candidate_pairs(run.select("qid", "docid"), queries, collection)
    return rerank(score_pairs(pairs).select("qid", "docid", "score"), top_n)


def two_stage(first_stage: DataFrame, queries: DataFrame, collection: DataFrame, k: int, top_n: int,
              scorer: Callable | None = None, batch: bool = False) -> DataFrame:
    """Keep the first stage's top ``k``, score those pairs, return the reranked top ``top_n``."""
    cands = first_stage.where(F.col("rank") <= k).select("qid", "docid")
    pairs = candidate_pairs(cands, queries, collection)
    return rerank(score_pairs(pairs, scorer, batch=batch).select("qid", "docid", "score"), top_n)


def two_stage_dense(queries: DataFrame, passages: DataFrame, coarse_dims: int, k: int, top_n: int, *,
                    exclude_self: bool = False) -> DataFrame:
    """R4 on vectors: the exact top ``k`` by the first ``coarse_dims`` dimensions, scored again
    by the whole inner product; ``qid, docid, score, rank`` of the best ``top_n``.

    ``queries``: qid, qvec; ``passages``: docid, dvec.
    """
    first = knn_join_exact(queries.select("qid", F.slice("qvec", 1, coarse_dims).alias("qvec")),
                           passages.select("docid", F.slice("dvec", 1, coarse_dims).alias("dvec")),
                           k, exclude_self=exclude_self)
    pairs = first.select("qid", "docid").join(queries.select("qid", "qvec"), "qid").join(
        passages.select("docid", "dvec"), "docid")
    return rerank(pairs.select("qid", "docid", F.round(dot(F.col("qvec"), F.col("dvec")), 9).alias("score")), top_n)


def top1_per_query(scored: DataFrame) -> DataFrame:
    """Highest-scoring candidate per query (ties: smaller docid)."""
    return rank_topk(scored, 1).drop("rank")


def hit_at_1(ranked_by_system: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per system, share of judged queries whose rank-1 passage is relevant.

    ``ranked_by_system``: ``system, qid, docid, rank``; ``qrels``: ``qid, docid, rel``.
    """
    rel = qrels.where(F.col("rel") > 0).select("qid", "docid", F.lit(1).alias("_r"))
    judged = qrels.select("qid").distinct()
    top = ranked_by_system.where(F.col("rank") == 1).join(judged, "qid", "left_semi")
    j = top.join(rel, ["qid", "docid"], "left")
    return j.groupBy("system").agg(F.round(F.avg(F.coalesce("_r", F.lit(0)).cast("double")), 6).alias("hit_at_1"),
                                   F.count(F.lit(1)).alias("num_queries"))


def pass_rate_top3(ranked: DataFrame, qrels: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Share of judged queries with a relevant passage in the top 3; pass at >= threshold."""
    rel = qrels.where(F.col("rel") > 0).select("qid", "docid", F.lit(1).alias("_r"))
    judged = qrels.select("qid").distinct()
    per_q = (ranked.where(F.col("rank") <= 3).join(rel, ["qid", "docid"], "left")
             .groupBy("qid").agg(F.max(F.coalesce("_r", F.lit(0))).alias("_hit")))
    per_q = judged.join(per_q, "qid", "left").select("qid", F.coalesce("_hit", F.lit(0)).alias("_hit"))
    return (per_q.agg(F.round(F.avg(F.col("_hit").cast("double")), 6).alias("pass_rate"),
                      F.count(F.lit(1)).alias("num_cases"))
            .withColumn("passed", F.col("pass_rate") >= F.lit(threshold)))


def jaccard_batch_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Example batch scorer (the shape of a cross-encoder's ``predict``): token-set Jaccard
    similarity of query and passage, computed in Python for one Arrow batch of pairs."""
    import regex

    tok = regex.compile(r"[\p{L}\p{N}]+")
    out = []
    for q, p in pairs:
        a = set(tok.findall((q or "").lower()))
        b = set(tok.findall((p or "").lower()))
        u = a | b
        out.append(len(a & b) / len(u) if u else 0.0)
    return out
