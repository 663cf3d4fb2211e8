"""Long jobs in buckets of queries, each committed by a marker, so that a restart goes on.

The output folder has one folder per bucket. A bucket's marker is written after its files are
committed; a restart computes the buckets without one, over whatever a killed job left there.
Settings are kept beside the buckets, so results of different settings never mix.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK, _SETTINGS = "_committed", "_settings.json"


class _Store:
    """Small files through Hadoop's file system, so that any shared store works."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def put(self, name: str, text: str = "") -> None:
        fs, path = self._at(name)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a query: a hash of its id, so buckets are alike in size (null ids: bucket 0)."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"), F.lit(0))


def open_buckets(spark: SparkSession, path: str, buckets: int) -> list[int]:
    """Buckets of ``path`` that have no marker yet."""
    store = _Store(spark, path)
    return [b for b in range(buckets) if not store.has(f"bucket={b}/{_MARK}")]


def run_in_buckets(todo: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, *, buckets: int = 16,
                   key: str = "qid", settings: dict | None = None) -> DataFrame:
    """``compute`` over ``todo``, a bucket of its rows at a time, and the whole result read back.

    Every bucket is one distributed job written to ``path/bucket=b``; a bucket whose marker
    is there is not computed again. So at most one bucket's work is lost with the driver, and
    none with executors. ``settings`` (JSON values) must be those the folder was begun with,
    else ValueError; the bucket count is one of them. ``compute`` must give each bucket's rows
    from that bucket's queries alone. No queries: no rows, with the columns of ``compute``.
    """
    spark = todo.sparkSession
    store = _Store(spark, path)
    now = json.dumps({"buckets": buckets, "key": key, **(settings or {})}, sort_keys=True)
    if not store.has(_SETTINGS):
        store.put(_SETTINGS, now)
    elif (begun := store.text(_SETTINGS)) != now:
        raise ValueError(f"{path} was begun with {begun}, not {now}")
    for b in open_buckets(spark, path, buckets):
        mine = todo.where(bucket_of(key, buckets) == b)
        compute(mine).write.mode("overwrite").parquet(f"{path}/bucket={b}")
        store.put(f"bucket={b}/{_MARK}")
    return spark.read.parquet(*(f"{path}/bucket={b}" for b in range(buckets)))
