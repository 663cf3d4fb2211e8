"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import scratch_dir


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a narrow scan enough tasks for the cluster.

    A table stored as one parquet row group scans as one task, and every row-wise step
    before the first shuffle (tokenising, exploding, scoring) then runs on one core. When
    the scan has fewer splits than the default parallelism, rows are spread round-robin
    (one shuffle of the table). Large inputs already have more splits than cores and
    pass through untouched.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back, for readers that would
    each compute it again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    The check stops after ``max_rows + 1`` rows. Callers pass narrow frames (ids,
    short keys, doubles), so the row bound is a byte bound. Above the bound the frame
    is returned unhinted and the planner/AQE chooses a shuffle join, with skew-join
    splitting enabled in the session.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def dense_index(df: DataFrame, order_col: str, index_col: str = "idx", partitions: int | None = None) -> DataFrame:
    """Attach ``index_col`` = 0-based position of each row in ``order_col`` order.

    Range partitioning orders partitions by key; inside a partition
    ``monotonically_increasing_id`` counts rows in order, so the global index is the
    partition's offset (rows in earlier partitions) plus the local position. Only the
    per-partition counts (one row per partition) are combined in one place.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n_parts, order_col).sortWithinPartitions(order_col)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mono", "_off"))


def exact_quantile(df: DataFrame, value: str, q: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """``*groups, quantile``: the exact ``q`` quantile of ``value`` (linear interpolation).

    Equal values are counted before the shuffle, the counts are range-partitioned by
    (groups, value) and written, and a value's rank is its partition's offset plus the
    running count inside the partition. So one large group is spread over many tasks;
    only one count per (group, partition) is combined in one place. Null values take no
    part; without rows an ungrouped quantile is null.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "quantile")
    (df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
     .repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id())
     .write.parquet(path))
    counts = spark.read.parquet(path)
    parts = counts.groupBy(*groups, "_part").agg(F.sum("_n").alias("_rows"))
    every = Window.partitionBy(*groups)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*groups, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off"),
                         (F.lit(q) * (F.sum("_rows").over(every) - 1)).alias("_pos"))
    inside = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.join(parts, [*groups, "_part"])
              .withColumn("_end", F.col("_off") + F.sum("_n").over(inside)))

    def at(rank):
        return F.max(F.when((F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end")), F.col(value)))

    lower, upper, share = at(F.floor("_pos")), at(F.ceil("_pos")), F.max(F.col("_pos") - F.floor("_pos"))
    return ranked.groupBy(*groups).agg(((F.lit(1.0) - share) * lower + share * upper).alias("quantile"))


def scalars(df: DataFrame) -> dict:
    """The single row of a global aggregate, as driver values (a handful of numbers)."""
    row = df.first()
    return row.asDict() if row is not None else {}


def literal_row(spark, values: dict, types: dict | None = None) -> DataFrame:
    """One-row frame of computed scalars (the shape of a global aggregate result)."""
    types = types or {}
    cols = [(F.lit(v).cast(types[k]) if k in types else F.lit(v)).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols)
