"""Retrieval metrics (trec_eval definitions) as one grouped pass over a ranked run.

Input contract
--------------
ranked   ``qid, docid, rank (1-based, score desc / docid asc), gain (double)``;
         ``gain > 0`` means relevant (graded gains feed nDCG).
ideal    ``qid, num_rel, idcg_10``: per-query judgment summary, built either from an
         explicit qrels table (:func:`ideal_from_qrels`) or from class labels
         (:func:`ideal_from_classes`, relevant = same class, self excluded) so that
         "every document of my class" judgments never have to be materialised as pairs.

Per-query metrics exist for queries in both the run and the judgments (inner join),
which is also the denominator of the aggregate means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.util import broadcast_if_small, scalars

_DIGITS = 6
#: Classes (an id and a label each) that are joined to a run without moving its rows.
CLASS_ROWS = 2_000_000
METRIC_COLUMNS = ["map", "ndcg_at_10", "mrr_at_10", "recall_at_100", "recall_at_1000"]


def _discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(1))


def label_pairs(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Scored pairs get ``gain`` (judged rel, else 0) and ``is_pos`` (rel > 0)."""
    j = qrels.select("qid", "docid", F.col("rel").cast("double").alias("_rel"))
    return (run.join(j, ["qid", "docid"], "left")
            .withColumn("gain", F.greatest(F.coalesce("_rel", F.lit(0.0)), F.lit(0.0)))
            .withColumn("is_pos", F.col("gain") > 0)
            .drop("_rel"))


def label_pairs_by_class(run: DataFrame, query_classes: DataFrame, doc_classes: DataFrame) -> DataFrame:
    """J7 for class judgments: relevant when query and document share a class. Classes of up to
    CLASS_ROWS rows a side travel to the run, which is much longer."""
    return (run.join(broadcast_if_small(query_classes.select("qid", F.col("cls").alias("_qc")), CLASS_ROWS), "qid")
            .join(broadcast_if_small(doc_classes.select("docid", F.col("cls").alias("_dc")), CLASS_ROWS), "docid", "left")
            .withColumn("is_pos", F.coalesce(F.col("_qc") == F.col("_dc"), F.lit(False)))
            .withColumn("gain", F.col("is_pos").cast("double"))
            .drop("_qc", "_dc"))


def ideal_from_qrels(qrels: DataFrame, cutoff: int = 10) -> DataFrame:
    """``qid, num_rel, idcg_10`` from ``qid, docid, rel`` (ideal order: rel desc).

    Every judged query has a row; one without a positive has num_rel = 0 and idcg_10 = 0.
    """
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("docid").asc())
    r = qrels.withColumn("_i", F.row_number().over(w))
    rel = F.col("rel") > 0
    return r.groupBy("qid").agg(
        F.count_if(rel).alias("num_rel"),
        F.coalesce(F.sum(F.when(rel & (F.col("_i") <= cutoff), F.col("rel").cast("double") / _discount(F.col("_i")))),
                   F.lit(0.0)).alias("idcg_10"))


def ideal_from_classes(query_classes: DataFrame, doc_classes: DataFrame, *, self_excluded: bool = True,
                       cutoff: int = 10) -> DataFrame:
    """``qid, num_rel, idcg_10`` when relevant = same class (binary gains).

    ``num_rel`` = size of the query's class in the collection (minus the query itself when
    queries are also documents); the ideal DCG is then a closed sum over ranks 1..min(R, 10).
    """
    sizes = doc_classes.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    r = query_classes.join(sizes, "cls").select(
        "qid", (F.col("_n") - F.lit(1 if self_excluded else 0)).alias("num_rel"))
    ranks = F.when(F.col("num_rel") > 0, F.sequence(F.lit(1), F.least(F.col("num_rel"), F.lit(cutoff)).cast("int"))
                   ).otherwise(F.array().cast("array<int>"))
    idcg = F.aggregate(ranks, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))
    return r.select("qid", "num_rel", idcg.alias("idcg_10"))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for a query without a positive judgment (it still counts)."""
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def _by_relevant_rank(ranked: DataFrame, cutoff: int = 10) -> DataFrame:
    """``qid, _rank, _n, _dcg``: a row a query and relevant rank, how often it comes and its part of the
    DCG; a query's other rows are one, of a null rank. Sums alone are held, so the run is neither moved nor sorted."""
    part = F.when(F.col("rank") <= cutoff, F.col("gain") / _discount(F.col("rank")))
    return (ranked.select("qid", F.when(F.col("gain") > 0, F.col("rank")).alias("_rank"), part.alias("_part"))
            .groupBy("qid", "_rank").agg(F.count(F.lit(1)).alias("_n"), F.sum("_part").alias("_dcg")))


def _precisions() -> Column:
    """Per query of ``_by_relevant_rank``, the sum of precision at each relevant rank: the i-th relevant
    rank r adds i / r."""
    found = F.sort_array(F.collect_list(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_n"))))
    ranks = F.flatten(F.transform(found, lambda x: F.array_repeat(x["_rank"], x["_n"].cast("int"))))
    parts = F.transform(ranks, lambda rank, i: (i + F.lit(1)) / rank)
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def per_query_metrics(ranked: DataFrame, ideal: DataFrame) -> DataFrame:
    """``qid, map, ndcg_at_10, mrr_at_10, recall_at_100, recall_at_1000``."""
    def within(k: int) -> Column:
        return F.sum(F.when(F.col("_rank") <= k, F.col("_n")).otherwise(0))

    per = _by_relevant_rank(ranked).groupBy("qid").agg(
        F.min(F.when(F.col("_rank") <= 10, F.col("_rank"))).alias("_first"), F.sum("_dcg").alias("_dcg"),
        _precisions().alias("_ap"), within(100).alias("_h100"), within(1000).alias("_h1000"))
    j = per.join(ideal, "qid")
    n = F.col("num_rel").cast("double")

    def r(c: Column) -> Column:
        return F.round(c, _DIGITS)

    return j.select(
        "qid",
        r(_share(F.col("_ap"), n)).alias("map"),
        r(_share(F.col("_dcg"), F.col("idcg_10"))).alias("ndcg_at_10"),
        r(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))).alias("mrr_at_10"),
        r(_share(F.col("_h100"), n)).alias("recall_at_100"),
        r(_share(F.col("_h1000"), n)).alias("recall_at_1000"),
    )


def mrr_at_k(ranked: DataFrame, k: int = 10) -> DataFrame:
    """E1 alone: ``qid, mrr`` = 1/rank of first relevant within top k, else 0."""
    rel = F.col("gain") > 0
    return ranked.groupBy("qid").agg(
        F.round(F.coalesce(F.lit(1.0) / F.min(F.when(rel & (F.col("rank") <= k), F.col("rank"))),
                           F.lit(0.0)), _DIGITS).alias(f"mrr_at_{k}"))


def aggregate_metrics(per_query: DataFrame) -> DataFrame:
    """Means over the evaluated queries plus ``num_queries``."""
    return per_query.agg(*[F.round(F.avg(c), _DIGITS).alias(c) for c in METRIC_COLUMNS],
                         F.count(F.lit(1)).alias("num_queries"))


def metrics_by_stratum(per_query: DataFrame, strata: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Means per stratum; ``rollup`` adds the overall row (stratum = 'all'). Queries of a null
    stratum are a stratum of their own, with a null name."""
    j = per_query.join(strata.select("qid", stratum), "qid")
    out = j.rollup(stratum).agg(*[F.round(F.avg(c), _DIGITS).alias(c) for c in METRIC_COLUMNS],
                                F.count(F.lit(1)).alias("num_queries"), F.grouping(stratum).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(stratum)).alias(stratum),
                      *METRIC_COLUMNS, "num_queries")


def compare_systems(aggregates: DataFrame, base_system: str, metric: str = "mrr_at_10") -> DataFrame:
    """One row per system with its metric and the delta to ``base_system``."""
    base = scalars(aggregates.where(F.col("system") == base_system).select(F.col(metric).alias("b")))["b"]
    return aggregates.select("system", F.col(metric).alias(metric),
                             F.round(F.col(metric) - F.lit(base), _DIGITS).alias("delta"))


def variant_gap(per_query_a: DataFrame, per_query_b: DataFrame, metric: str = "mrr_at_10",
                threshold: float = 0.05) -> DataFrame:
    """Mean metric gap between paired query variants (joined by base query id)."""
    j = per_query_a.select("qid", F.col(metric).alias("_a")).join(
        per_query_b.select("qid", F.col(metric).alias("_b")), "qid")
    return j.agg(F.round(F.avg("_a"), _DIGITS).alias("mean_a"),
                 F.round(F.avg("_b"), _DIGITS).alias("mean_b"),
                 F.round(F.abs(F.avg("_a") - F.avg("_b")), _DIGITS).alias("gap"),
                 F.count(F.lit(1)).alias("num_pairs")).withColumn(
        "passed", F.col("gap") < F.lit(threshold))


def ndcg_at_k(ranked: DataFrame, ideal: DataFrame, k: int = 10) -> DataFrame:
    """E2 alone: ``qid, ndcg_at_10`` — DCG of the top k over the ideal DCG of all judged docs
    (``ideal.idcg_10`` holds the ideal for k = 10)."""
    if k != 10:
        raise ValueError("ideal tables carry idcg_10; build them with cutoff=k for other k")
    per = ranked.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("gain") / _discount(F.col("rank")))).alias("_dcg"))
    return per.join(ideal, "qid").select(
        "qid", F.round(_share(F.col("_dcg"), F.col("idcg_10")), _DIGITS).alias("ndcg_at_10"))


def average_precision(ranked: DataFrame, ideal: DataFrame) -> DataFrame:
    """E3 alone: ``qid, map`` — sum of precision at each relevant rank over the judged relevant count."""
    per = _by_relevant_rank(ranked).groupBy("qid").agg(_precisions().alias("_ap"))
    return per.join(ideal, "qid").select(
        "qid", F.round(_share(F.col("_ap"), F.col("num_rel")), _DIGITS).alias("map"))


def recall_at_k(ranked: DataFrame, ideal: DataFrame, ks: tuple[int, ...] = (100, 1000)) -> DataFrame:
    """E4 alone: ``qid, recall_at_<k>...`` — relevant retrieved in the top k over judged relevant."""
    rel = F.col("gain") > 0
    per = ranked.groupBy("qid").agg(*[F.count_if(rel & (F.col("rank") <= k)).alias(f"_h{k}") for k in ks])
    return per.join(ideal, "qid").select(
        "qid", *[F.round(_share(F.col(f"_h{k}"), F.col("num_rel")), _DIGITS).alias(f"recall_at_{k}") for k in ks])
