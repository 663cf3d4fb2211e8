"""Columnar scans: id/text tables and ordered shard slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.selection import first_rows


def scan_id_text(spark: SparkSession, path: str | list[str], id_col: str = "id",
                 text_col: str = "text") -> DataFrame:
    """``id, text`` only (the parquet scan reads just these two columns)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths).select(F.col(id_col).cast("long").alias("id"),
                                             F.col(text_col).alias("text"))


def slice_shards(spark: SparkSession, paths: list[str], row_limit: int | None, id_col: str = "id",
                 columns: list[str] | None = None) -> DataFrame:
    """Concatenate shards and keep the first ``row_limit`` rows in id order (``first_rows``:
    the rows themselves are only filtered, by a predicate that reaches the scan)."""
    df = spark.read.parquet(*paths)
    if columns:
        df = df.select(*columns)
    return first_rows(df, [id_col], row_limit) if row_limit else df


def slice_in_order(spark: SparkSession, paths: list[str], row_limit: int | None, kind: str = "parquet",
                   columns: list[str] | None = None) -> DataFrame:
    """The first ``row_limit`` rows of the shards read one after another, in file order.

    A shard is a file or a folder of files in name order; ``kind`` is ``parquet`` or ``text``
    (one ``value`` a line, in the order of the lines). Rows are counted per split first, one
    number each; then only the shards up to the one where the limit falls are read, and only
    the split it falls in is numbered. Rows come in no particular order; with fewer rows than
    the limit, or without one, all come. Shards of parquet share their columns.
    """
    if kind not in ("parquet", "text"):
        raise ValueError(f"unknown kind of shard {kind}")

    def shard(k: int) -> DataFrame:
        rows = spark.read.parquet(paths[k]) if kind == "parquet" else spark.read.text(paths[k])
        rows = rows.select(*(columns or rows.columns), "_metadata")
        place = F.col("_metadata.row_index") if kind == "parquet" else F.monotonically_increasing_id()
        split = F.lit(0).cast("long") if kind == "parquet" else F.col("_metadata.file_block_start")
        return rows.select("*", F.lit(k).alias("_shard"), F.col("_metadata.file_path").alias("_file"),
                           split.alias("_split"), place.alias("_place")).drop("_metadata")

    def plain(rows: DataFrame) -> DataFrame:
        return rows.drop("_shard", "_file", "_split", "_place")

    shards = [shard(k) for k in range(len(paths))]
    whole = plain(reduce(DataFrame.unionByName, shards))
    if not row_limit:
        return whole
    counts = reduce(DataFrame.unionByName, (s.select("_shard", "_file", "_split") for s in shards))
    counts = counts.groupBy("_shard", "_file", "_split").agg(F.count(F.lit(1)).alias("n"))
    left = row_limit
    for at in counts.orderBy("_shard", "_file", "_split").collect():  # one row a split
        if left <= at["n"]:
            break
        left -= at["n"]
    else:
        return whole
    last = shards[at["_shard"]]
    cut = last.where((F.col("_file") == at["_file"]) & (F.col("_split") == at["_split"]))
    earlier = (F.col("_file") < at["_file"]) | ((F.col("_file") == at["_file"]) & (F.col("_split") < at["_split"]))
    if kind == "parquet":
        cut = cut.where(F.col("_place") < left)
    elif left < at["n"]:
        cut = first_rows(cut, ["_place"], left)
    parts = [*shards[:at["_shard"]], last.where(earlier), cut]
    return reduce(DataFrame.unionByName, map(plain, parts))
