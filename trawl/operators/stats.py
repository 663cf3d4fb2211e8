"""Bootstrap statistics over per-query values.

Resampling is a join, not a loop: ``spark.range(B * n)`` enumerates (resample b, draw j),
each draw picks row ``pmod(md5(seed|b|j), n)`` of the per-query table (indexed 0..n-1
in qid order by :func:`dense_index`), and ``groupBy(b)`` computes the metric of every
resample at once. Only the B resample statistics meet in the final percentile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.hashing import draw_index
from trawl.operators.resample import MEAN, Metric, is_counts_metric, original_metric, resampled_metric
from trawl.operators.util import broadcast_if_small, dense_index, literal_row, scalars

_DIGITS = 6
#: Draws of a task at most: a median keeps every value that a resample drew in memory.
DRAWS = 4_000_000


def _draws(spark, n: int, n_resamples: int, seed: int) -> DataFrame:
    ids = spark.range(0, n_resamples * n, 1, max(spark.sparkContext.defaultParallelism, -(-n_resamples * n // DRAWS)))
    b = F.floor(F.col("id") / F.lit(n)).cast("long")
    j = F.pmod(F.col("id"), F.lit(n))
    return ids.select(b.alias("b"), draw_index(seed, n, b, j).alias("idx"))


def bootstrap_ci(per_query: DataFrame, value: str, *, metric_fn: Callable | Metric = F.avg,
                 n_resamples: int = 1000, confidence: float = 0.95, seed: int = 42,
                 max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """``mean, ci_low, ci_high, n_resamples, confidence`` (percentile CI).

    ``metric_fn`` is an aggregate of one Column (``F.avg``, ``F.median``), a Python function of
    (values, counts) or a ``resample.Metric``. The last two draw by ``resample``: other
    draws than those of a Column, of the same distribution. Null values are left out of a
    Python metric; without values it raises like an empty table.
    """
    spark = per_query.sparkSession
    # one row per query: materialise once, every later step (count, index, mean) reads it
    vals = per_query.select("qid", F.col(value).cast("double").alias("v")).checkpoint(eager=True)
    n = vals.count()
    if n == 0:
        raise ValueError("no query to resample")
    if is_counts_metric(metric_fn):
        vals = vals.where(F.col("v").isNotNull())
        n = vals.count()
        if n == 0:
            raise ValueError("no value to resample")
        resampled = resampled_metric(vals, n, metric_fn, n_resamples, seed)
        return _interval(spark, resampled, round(original_metric(vals, metric_fn), _DIGITS), n_resamples, confidence)
    indexed = dense_index(vals, "qid", "idx").select("idx", "v")
    resampled = (_draws(spark, n, n_resamples, seed).join(broadcast_if_small(indexed, max_broadcast_rows), "idx")
                 .groupBy("b").agg(metric_fn(F.col("v")).alias("m")))
    mean = scalars(vals.agg(F.round(metric_fn(F.col("v")), _DIGITS).alias("mean")))
    return _interval(spark, resampled, mean["mean"], n_resamples, confidence)


def _interval(spark, resampled: DataFrame, mean: float, n_resamples: int, confidence: float) -> DataFrame:
    alpha = (1.0 - confidence) / 2.0
    ci = scalars(resampled.agg(F.round(F.percentile("m", alpha), _DIGITS).alias("ci_low"),
                               F.round(F.percentile("m", 1.0 - alpha), _DIGITS).alias("ci_high")))
    return literal_row(spark, {"mean": mean, "ci_low": ci["ci_low"], "ci_high": ci["ci_high"],
                               "n_resamples": n_resamples, "confidence": float(confidence)},
                       {"mean": "double", "ci_low": "double", "ci_high": "double", "n_resamples": "int"})


def paired_bootstrap(paired: DataFrame, *, n_resamples: int = 1000, seed: int = 42,
                     max_broadcast_rows: int = 5_000_000, as_counts: bool = False) -> DataFrame:
    """One-sided paired test that A beats B on ``qid, a, b`` rows.

    d = a - b; observed = mean(d); observed <= 0 gives p = 1.0; otherwise the centred
    differences are resampled and p = (#{resample mean >= observed} + 1) / (B + 1). With
    ``as_counts`` resamples are counts (``resample``) in place of one row per draw: other
    draws, and no more than B states leave a task. Returns ``observed_diff, p_value, n_resamples, num_queries``.
    """
    spark = paired.sparkSession
    d = paired.select("qid", (F.col("a").cast("double") - F.col("b").cast("double")).alias("d")).checkpoint(eager=True)
    n = d.count()
    if n == 0:
        raise ValueError("no paired values")
    obs = scalars(d.agg(F.avg("d").alias("obs")))["obs"]
    if obs <= 0:
        p = 1.0
    else:
        if as_counts:
            means = resampled_metric(d.select("qid", (F.col("d") - F.lit(obs)).alias("v")), n, MEAN, n_resamples, seed)
        else:
            indexed = dense_index(d, "qid", "idx").select("idx", "d")
            centred = indexed.select("idx", (F.col("d") - F.lit(obs)).alias("c"))
            means = (_draws(spark, n, n_resamples, seed).join(broadcast_if_small(centred, max_broadcast_rows), "idx")
                     .groupBy("b").agg(F.avg("c").alias("m")))
        c = scalars(means.agg(F.count_if(F.col("m") >= F.lit(obs)).alias("c")))["c"]
        p = (c + 1) / float(n_resamples + 1)
    return literal_row(spark, {"observed_diff": round(obs, _DIGITS), "p_value": round(p, _DIGITS),
                               "n_resamples": n_resamples, "num_queries": n},
                       {"observed_diff": "double", "p_value": "double", "n_resamples": "int", "num_queries": "long"})
