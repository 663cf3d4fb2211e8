"""First n rows by key, for any n.

``orderBy(...).limit(n)`` sends n rows of every partition to one task. Here the keys alone are
counted, range-partitioned and written; the counts of the partitions give the one that holds
the n-th key, and only inside that partition keys are ranked. The rows themselves are then
filtered by the key found, a predicate that reaches the scan, and never move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import scratch_dir

#: Up to this many rows Spark's own top-n is used: its last task sees so many rows a partition.
TOP_N = 1000
#: Keys that one task ranks in the end, and the partitions that more keys are split into.
FEW_KEYS, SPLIT = 10_000, 64


def _equal(key: Column, value: Column | None) -> Column:
    return key.isNull() if value is None else key == value


def _before(keys: list[Column], cut: list[Column | None], equal: bool) -> Column:
    """keys < cut (or <=) in lexical order, nulls first, in a form that the scan can use."""
    out = None
    for key, value in reversed(list(zip(keys, cut))):
        if out is None:  # the last key
            if value is None:
                out = key.isNull() if equal else F.lit(False)
            else:
                out = (key <= value if equal else key < value) | key.isNull()
        elif value is None:
            out = key.isNull() & out
        else:
            out = (key < value) | key.isNull() | ((key == value) & out)
    return out


def _cut(rows: DataFrame, keys: list[Column], n: int) -> tuple[list[Column | None], int, int] | None:
    """(key values, rows to keep of them, rows that have them) of the n-th row, None if there
    are at most n rows."""
    spark = rows.sparkSession
    names = [f"_key{i}" for i in range(len(keys))]
    path = scratch_dir(spark, "keys")
    counts = rows.select(*(k.alias(c) for k, c in zip(keys, names))).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    left, turn = n, 0
    while True:  # into the partition that holds the n-th row, until it holds few keys
        parts = counts.repartitionByRange(SPLIT, *names) if turn else counts.repartitionByRange(*names)
        parts.withColumn("_part", F.spark_partition_id()).write.parquet(f"{path}/{turn}")
        counts = spark.read.parquet(f"{path}/{turn}")
        sums = counts.groupBy("_part").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_keys"))
        for part in sums.orderBy("_part").collect():  # one row a partition
            if left <= part["_n"]:
                break
            left -= part["_n"]
        else:
            return None
        counts = counts.where(F.col("_part") == part["_part"]).drop("_part")
        turn += 1
        if part["_keys"] <= FEW_KEYS:
            break
    end = F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))  # over FEW_KEYS rows at most
    at = counts.withColumn("_end", end).where(F.col("_end") >= left).orderBy(*names).limit(1).first()
    values = [None if at[c] is None else F.lit(at[c]).cast(counts.schema[c].dataType) for c in names]
    need = left - (at["_end"] - at["_n"])
    return values, need, at["_n"]


def first_rows(rows: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (ascending, nulls first), in no particular order.

    Ties at the cut are settled by all columns in turn, so the result does not depend on
    how rows are stored; rows alike in every column are interchangeable. ``rows`` is read
    several times and must give the same rows each time (a table, a written result). All
    columns must be orderable. An empty table gives no rows.
    """
    every = [F.col(f"`{c}`") for c in rows.columns]
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    if n <= 0:
        return rows.limit(0)
    if n <= TOP_N:
        return rows.orderBy(*(k.asc_nulls_first() for k in [*keys, *every])).limit(n)
    cut = _cut(rows, keys, n)
    if cut is None:
        return rows
    values, need, ties = cut
    if need == ties:
        return rows.where(_before(keys, values, True))
    below = rows.where(_before(keys, values, False))
    same = rows.where(reduce(lambda a, b: a & b, (_equal(k, v) for k, v in zip(keys, values))))
    if need <= TOP_N:
        return below.unionByName(first_rows(same, every, need))
    values, need, ties = _cut(same, every, need)
    below = below.unionByName(same.where(_before(every, values, need == ties)))
    if need == ties:
        return below
    # rows alike in every column: as many as are needed, made from one
    alike = same.where(reduce(lambda a, b: a & b, (_equal(k, v) for k, v in zip(every, values)))).distinct()
    return below.unionByName(alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(need)))).drop("_copy"))
