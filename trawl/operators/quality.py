"""Calibration, robustness and release checks.

Input of the calibration operators: ``score double, is_pos boolean`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.hashing import hash_key
from trawl.operators.util import exact_quantile, literal_row, scalars
from trawl.session import scratch_dir

_DIGITS = 6

# fixed values: release thresholds. "gain" and "pass rate" must reach the value, the
# others must stay strictly below it.
RELEASE_THRESHOLDS = [
    ("mrr10_gain_over_baseline", 0.03, "min"),
    ("ece", 0.10, "max"),
    ("robustness_drop_no_accents", 0.10, "max"),
    ("robustness_drop_typos", 0.15, "max"),
    ("robustness_drop_case", 0.05, "max"),
    ("qualitative_pass_rate", 0.80, "min"),
]


def bin_index(score: Column, n_bins: int = 10) -> Column:
    """Equal-width bin on [0, 1] with edges ``i / n_bins`` computed as ``i * (1 / n_bins)``
    (so 0.3 falls in bin 2: its edge is 0.30000000000000004); the last bin is closed;
    scores outside [0, 1] get null. Equivalent to comparing against every edge, as an
    expression (no join against a bin table)."""
    step = 1.0 / n_bins
    raw = F.least(F.greatest(F.floor(score * n_bins).cast("int"), F.lit(0)), F.lit(n_bins - 1))
    lo = raw.cast("double") * F.lit(step)
    hi = (raw + 1).cast("double") * F.lit(step)
    adj = (F.when(score < lo, raw - 1)
           .when((raw < n_bins - 1) & (score >= hi), raw + 1)
           .otherwise(raw))
    return F.when((score >= 0.0) & (score <= 1.0), adj)


def reliability_bins(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """``bin, lo, hi, n, mean_score, pos_rate, gap`` for every bin (empty bins: n = 0, nulls)."""
    spark = pairs.sparkSession
    step = 1.0 / n_bins
    per = (pairs.select(bin_index(F.col("score"), n_bins).alias("bin"), "score", "is_pos")
           .where(F.col("bin").isNotNull())
           .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("ms"),
                               F.avg(F.col("is_pos").cast("double")).alias("pr")))
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    j = bins.join(per, "bin", "left")
    return j.select(
        "bin",
        F.round(F.col("bin") * F.lit(step), 2).alias("lo"),
        F.round((F.col("bin") + 1) * F.lit(step), 2).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        F.round("ms", _DIGITS).alias("mean_score"),
        F.round("pr", _DIGITS).alias("pos_rate"),
        F.round(F.abs(F.col("ms") - F.col("pr")), _DIGITS).alias("gap"))


def ece_brier(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """C2 + C3: ``ece`` = sum over bins of (n_bin / n_all) * gap, n_all counting every pair;
    ``brier`` = mean (score - label)^2; plus ``n``."""
    per = (pairs.select(bin_index(F.col("score"), n_bins).alias("bin"), "score", "is_pos")
           .where(F.col("bin").isNotNull())
           .groupBy("bin").agg(F.count(F.lit(1)).alias("nb"), F.abs(F.avg("score") - F.avg(F.col("is_pos").cast("double"))).alias("g")))
    tot = scalars(pairs.agg(F.count(F.lit(1)).alias("n"),
                            F.round(F.avg(F.pow(F.col("score") - F.col("is_pos").cast("double"), 2)), _DIGITS)
                            .alias("brier")))
    n = tot["n"]
    e = scalars(per.agg(F.round(F.coalesce(F.sum(F.col("nb") / F.lit(max(n, 1)) * F.col("g")), F.lit(0.0)),
                                _DIGITS).alias("ece")))
    return literal_row(pairs.sparkSession, {"ece": e["ece"], "brier": tot["brier"], "n": n},
                       {"ece": "double", "brier": "double", "n": "long"})


def class_score_gap(pairs: DataFrame) -> DataFrame:
    """C4: mean score of positives, of negatives, and their difference."""
    pos = F.avg(F.when(F.col("is_pos"), F.col("score")))
    neg = F.avg(F.when(~F.col("is_pos"), F.col("score")))
    return pairs.agg(F.round(pos, _DIGITS).alias("pos_mean"), F.round(neg, _DIGITS).alias("neg_mean"),
                     F.round(pos - neg, _DIGITS).alias("gap"))


def separation_p90(pairs: DataFrame, q: float = 0.9) -> DataFrame:
    """Share of positives scoring above the negatives' ``q`` quantile (linear interpolation)."""
    thr = scalars(exact_quantile(pairs.where(~F.col("is_pos")), "score", q))["quantile"]
    pos = pairs.where(F.col("is_pos")).select("score")
    return pos.agg(F.round(F.lit(thr), _DIGITS).alias("neg_p90"),
                   F.round(F.avg((F.col("score") > F.lit(thr)).cast("double")), _DIGITS).alias("pos_above_p90"))


def score_histogram(pairs: DataFrame, n_buckets: int = 20, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """``is_pos, bucket, n`` with ``width_bucket`` (0 below, n+1 at or above ``hi``)."""
    b = F.width_bucket(F.col("score"), F.lit(lo), F.lit(hi), F.lit(n_buckets))
    return pairs.groupBy("is_pos", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def calibrate_scores(pairs: DataFrame, method: str = "isotonic") -> DataFrame:
    """Fit Platt (logistic) or isotonic calibration on ``score -> is_pos`` and apply it.

    Both are fitted on one weighted row per distinct score (its share of positives and its
    count), which gives the same fit as the single rows. The isotonic fit pools range
    partitions (``isotonic``). Rows of a null score or label take no part in a fit; a score that no
    labelled row has gets null from the isotonic one.
    """
    known = pairs.where("score is not null and is_pos is not null")
    by_label = known.groupBy("score", F.col("is_pos").cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    by_score = by_label.groupBy("score").agg(
        (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"))
    if method == "isotonic":
        from trawl.operators.isotonic import fitted_values, isotonic_blocks

        path = scratch_dir(pairs.sparkSession, "scores")  # read by the fit and to apply it
        by_score.write.parquet(path)
        by_score = pairs.sparkSession.read.parquet(path)
        return pairs.join(fitted_values(by_score.select("score"), isotonic_blocks(by_score)), "score", "left").select(*pairs.columns, "calibrated")
    if method == "platt":
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        points = VectorAssembler(inputCols=["score"], outputCol="features").transform(by_label)
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(points)
        slope, shift = float(model.coefficients[0]), float(model.intercept)
        return pairs.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(shift)))))
    raise ValueError(f"unknown calibration method {method}")


def calibration_check(calibrated: DataFrame) -> DataFrame:
    """What any fitted calibration must keep: ``n``, ``pos_rate``, ``balanced`` (the mean
    calibrated score is the share of positives, within 0.001) and ``monotone`` (over 20
    equal-width score buckets, no bucket's least value lies below an earlier one's largest).
    """
    per = calibrated.groupBy(F.width_bucket("score", F.lit(0.0), F.lit(1.0), F.lit(20)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_pos").cast("long")).alias("pos"),
        F.sum("calibrated").alias("total"), F.min("calibrated").alias("least"), F.max("calibrated").alias("most"))
    earlier = F.lag("most").over(Window.orderBy("bucket"))  # at most 22 rows
    per = per.withColumn("ordered", F.coalesce(earlier <= F.col("least") + 1e-12, F.lit(True)))
    rate = F.sum("pos") / F.sum("n")
    return per.agg(F.sum("n").alias("n"), F.round(rate, _DIGITS).alias("pos_rate"),
                   (F.abs(F.sum("total") / F.sum("n") - rate) < 1e-3).alias("balanced"),
                   F.bool_and("ordered").alias("monotone"))


def score_drop(orig: DataFrame, pert: DataFrame, keys: list[str], thresholds: dict[str, float]) -> DataFrame:
    """Per perturbation, relative score drop (o - p) / o when o > 1e-3 else 0.

    ``orig``: ``*keys, orig_score``; ``pert``: ``*keys, perturbation, pert_score``.
    Returns ``perturbation, mean_rel_drop, median_rel_drop, abs_drop, threshold, passed, n``.
    """
    j = pert.join(orig, keys)
    drop = F.when(F.col("orig_score") > 1e-3, (F.col("orig_score") - F.col("pert_score")) / F.col("orig_score")
                  ).otherwise(F.lit(0.0))
    path = scratch_dir(orig.sparkSession, "drops")
    j.select("perturbation", "orig_score", "pert_score", drop.alias("rel_drop")).write.parquet(path)
    per = orig.sparkSession.read.parquet(path)  # read for the means and for the medians
    thr = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])
    medians = exact_quantile(per, "rel_drop", 0.5, ("perturbation",)).withColumnRenamed("quantile", "md")
    agg = per.groupBy("perturbation").agg(
        F.avg("rel_drop").alias("m"),
        F.avg(F.col("orig_score") - F.col("pert_score")).alias("a"), F.count(F.lit(1)).alias("n")
    ).join(medians, "perturbation", "left")
    return agg.select("perturbation", F.round("m", _DIGITS).alias("mean_rel_drop"),
                      F.round("md", _DIGITS).alias("median_rel_drop"), F.round("a", _DIGITS).alias("abs_drop"),
                      thr[F.col("perturbation")].alias("threshold"),
                      (F.col("m") < thr[F.col("perturbation")]).alias("passed"), "n")


def per_pair_drops(orig: DataFrame, pert: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of C8 before aggregation (input of the worst-cases report R9)."""
    j = pert.join(orig, keys)
    drop = F.when(F.col("orig_score") > 1e-3, (F.col("orig_score") - F.col("pert_score")) / F.col("orig_score")
                  ).otherwise(F.lit(0.0))
    return j.withColumn("drop", F.round(drop, _DIGITS))


def release_gate(metrics: DataFrame) -> DataFrame:
    """``system, passed, failures`` from long ``system, metric, value`` rows.

    Every threshold must hold; a metric that is missing (or null) fails.
    """
    thr = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("threshold"), F.lit(k).alias("kind"))
                    for m, t, k in RELEASE_THRESHOLDS])
    # every (system, threshold) pair: each system row expanded by the fixed threshold list
    need = metrics.select("system").distinct().select("system", F.inline(thr))
    j = need.join(metrics, ["system", "metric"], "left")
    ok = (F.when(F.col("value").isNull(), F.lit(False))
          .when(F.col("kind") == "min", F.col("value") >= F.col("threshold"))
          .otherwise(F.col("value") < F.col("threshold")))
    return (j.withColumn("ok", ok).groupBy("system")
            .agg(F.bool_and("ok").alias("passed"),
                 F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("metric")))).alias("failures")))


def sample_queries(top1: DataFrame, queries: DataFrame, passages: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """C11: ``n`` seeded random queries with their top-1 passage; rows lacking text dropped.

    ``top1``: ``qid, docid, score``; ``queries``/``passages``: ``id, text``.
    """
    picked = top1.orderBy(hash_key(seed, F.col("qid")), F.col("qid")).limit(n)
    q = queries.select(F.col("id").alias("qid"), F.col("text").alias("query"))
    p = passages.select(F.col("id").alias("docid"), F.col("text").alias("passage"))
    return (picked.join(q, "qid").join(p, "docid")
            .select("qid", "docid", "query", "passage", F.col("score").alias("score_saved")))


def ece(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """C2 alone: ``ece, n``."""
    return ece_brier(pairs, n_bins).select("ece", "n")


def brier(pairs: DataFrame) -> DataFrame:
    """C3 alone: ``brier`` = mean squared difference between score and label."""
    return pairs.agg(F.round(F.avg(F.pow(F.col("score") - F.col("is_pos").cast("double"), 2)), _DIGITS)
                     .alias("brier"))
