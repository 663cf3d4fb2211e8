"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.session import scratch_dir


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them (every u is above its v)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, path: str | None = None) -> DataFrame:
    """(node, component) of every node that a link (u, v) names; component is the least
    node of its component. Repeated links, both directions and loops are allowed; nulls
    are not. Each round is written to the shared folder (``path``, if given), which cuts the
    lineage; the result reads the last one."""
    spark = links.sparkSession
    path = path or scratch_dir(spark, "stars")
    cur = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, turn = None, -1
    while True:  # to the end: the number of rounds grows with the logarithm of the nodes
        turn += 1
        cur.write.parquet(f"{path}/{turn}")
        cur = spark.read.parquet(f"{path}/{turn}")
        mark = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before, cur = mark, _small_star(_large_star(cur))
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
