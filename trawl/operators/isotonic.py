"""Isotonic regression over range partitions.

The fit of sorted points is the slope of the greatest convex minorant of their cumulative sums:
adjacent blocks are pooled until their means rise. Each range partition pools its own points,
then neighbouring partitions that still fall are pooled pairwise, until no mean falls from one
partition to the next. Partitions that are in order are not touched again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import scratch_dir

_BLOCKS = "part long, lo double, hi double, total double, weight double"


def pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent blocks pooled until their means rise strictly."""
    first, sums, weights = [], [], []
    for i, (t, w) in enumerate(zip(total.tolist(), weight.tolist())):
        first.append(i)
        while sums and sums[-1] * w >= t * weights[-1]:
            t += sums.pop()
            w += weights.pop()
            first.pop()
        sums.append(t)
        weights.append(w)
    first = np.array(first, np.int64)
    last = np.append(first[1:], len(lo)) - 1 if len(first) else first
    return lo[first], hi[last], np.array(sums, float), np.array(weights, float)


def _pool(table: pa.Table) -> pa.Table:
    table = table.sort_by("lo")
    lo, hi, total, weight = pooled(*(table.column(c).to_numpy() for c in ("lo", "hi", "total", "weight")))
    part = np.full(len(lo), table.column("part")[0].as_py() if len(table) else 0, np.int64)
    return pa.table({"part": part, "lo": lo, "hi": hi, "total": total, "weight": weight})


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """``lo, hi, value``: the rising steps of the weighted isotonic fit of ``points`` (``score,
    label, weight``, one row per score). No points: no rows.

    A task holds the points of at most two range partitions. A round pools every falling
    border, so there are few unless the labels fall along the scores throughout, and then
    partitions halve in every round.
    """
    spark = points.sparkSession
    path = scratch_dir(spark, "isotonic")
    (points.select(F.col("score").alias("lo"), F.col("score").alias("hi"), (F.col("label") * F.col("weight")).alias("total"), "weight")
     .repartitionByRange("lo").withColumn("part", F.spark_partition_id().cast("long"))
     .groupBy("part").applyInArrow(_pool, _BLOCKS).write.parquet(f"{path}/0"))
    turn = 0
    while True:
        blocks = spark.read.parquet(f"{path}/{turn}")
        mean = F.col("total") / F.col("weight")
        ends = (blocks.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
                .orderBy("part").collect())  # one row a partition
        falls = [a["last"] >= b["first"] for a, b in zip(ends, ends[1:])]
        if not any(falls):
            return blocks.select("lo", "hi", mean.alias("value"))
        group, k = {}, 0
        while k < len(ends):  # a falling border joins two partitions; a partition is in one pair
            pair = k < len(falls) and falls[k]
            for at in range(k, k + 1 + pair):
                group[ends[at]["part"]] = ends[k]["part"]
            k += 1 + pair
        to = F.create_map(*(F.lit(x).cast("long") for old, new in group.items() if old != new for x in (old, new)))
        moved = blocks.withColumn("part", F.coalesce(to[F.col("part")], F.col("part")))
        turn += 1
        moved.groupBy("part").applyInArrow(_pool, _BLOCKS).write.parquet(f"{path}/{turn}")


def fitted_values(scores: DataFrame, blocks: DataFrame) -> DataFrame:
    """``score, calibrated`` of the fitted scores (one row each): the value of the block that
    begins last at or before the score.

    Block starts and scores are range-partitioned together and the last start is carried
    forward, across partitions by one value each.
    """
    spark = scores.sparkSession
    path = scratch_dir(spark, "fitted")
    both = (blocks.select(F.col("lo").alias("score"), F.lit(0).alias("kind"), "value")
            .unionByName(scores.select("score", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value"))))
    both.repartitionByRange("score", "kind").withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    ends = rows.where("kind = 0").groupBy("part").agg(F.max_by("value", "score").alias("end"))
    every = rows.select("part").distinct().join(ends, "part", "left")
    carried = every.select("part", F.last("end", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # one row a partition
    inside = Window.partitionBy("part").orderBy("score", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(F.broadcast(carried), "part")
            .withColumn("calibrated", F.coalesce(F.last("value", ignorenulls=True).over(inside), F.col("carried")))
            .where("kind = 1").select("score", "calibrated"))
