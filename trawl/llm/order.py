"""Row numbers in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import scratch_dir


def numbered(df: DataFrame, order: list[str | Column], index: str = "position", repeat: str | None = None) -> DataFrame:
    """``df`` with ``index`` = 0, 1, 2... in the given order, which should have no ties.

    Rows are range-partitioned by the order, sorted inside partitions and written to the
    shared folder; a row's number is its partition's offset plus its place inside. Only one
    count per partition meets in one task. With ``repeat``, a row stands that many times
    (a count column, replaced by ``copy`` = 0, 1, ...). An empty table gives no rows.
    """
    path = scratch_dir(df.sparkSession, "ordered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if repeat:
        ranged = ranged.withColumn("copy", F.explode(F.expr(f"sequence(0, cast({repeat} as int) - 1)"))).drop(repeat)
    (ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
     .write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_place") - F.shiftleft(F.col("_part").cast("long"), 33)
    return (rows.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(index, F.col("_before") + place).drop("_part", "_place", "_before"))
