"""Sinks and data manifests.

Writes go through Spark's output committer (task output is promoted atomically when the
job commits), which replaces the reference's temp-file-then-rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST_SCHEMA = ("snapshot long, timestamp_utc timestamp, mode string, table_name string, "
                   "num_rows long, output_path string, repo string, config string, split string, revision string")
ORIGIN = ("repo", "config", "split", "revision")


def sink_parquet(df: DataFrame, path: str, *, mode: str = "overwrite", partitions: int | None = None) -> str:
    """Write a table as parquet (optionally re-cut into ``partitions`` files of even size)."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode(mode).parquet(path)
    return path


def sink_counted(rows: DataFrame, path: str, what: str, *, keep: Column | None = None,
                 counts: dict[str, Column] | None = None, drop: tuple[str, ...] = (), mode: str = "overwrite") -> dict[str, int]:
    """Write the rows that ``keep`` holds for, and count in the job that writes them.

    ``counts`` are conditions counted over all of ``rows``, kept or not. They are observed in
    the stage that writes, whose tasks count once however often they are tried. Returns
    ``rows`` (written) and the other counts; ValueError with all of them if no row was
    written (the empty table stays). ``drop`` names helper columns that are not written.
    """
    keep = F.lit(True) if keep is None else keep
    seen = Observation()
    conditions = {"rows": keep, **(counts or {})}
    (rows.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()))
     .where(keep).drop(*drop).write.mode(mode).parquet(path))
    found = {name: int(seen.get[name]) for name in conditions}
    if not found["rows"]:
        raise ValueError(f"{what} gave no rows (" + ", ".join(f"{k} = {v}" for k, v in found.items()) + ")")
    return found


def sink_json(df: DataFrame, path: str) -> str:
    """Small result (e.g. the one-row aggregate) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def _read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    except AnalysisException:
        return None


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def snapshot_manifest(spark: SparkSession, tables: dict[str, str], manifest_path: str, mode: str,
                      origins: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Append one snapshot ``(snapshot, timestamp_utc, mode, table_name, num_rows,
    output_path, repo, config, split, revision)`` per table to the manifest; earlier
    snapshots are kept. ``origins`` names where a table came from (null where unknown).

    Counts come from one Spark job (a union of per-table counts; parquet answers them
    from footers).
    """
    prior = _read_manifest(spark, manifest_path)
    snap = 1
    if prior is not None:
        last = prior.agg(F.max("snapshot")).first()[0]
        snap = (last or 0) + 1
    origins = origins or {}
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("num_rows"))
             .select(F.lit(name).alias("table_name"), "num_rows", F.lit(p).alias("output_path"),
                     *[F.lit(origins.get(name, {}).get(o)).cast("string").alias(o) for o in ORIGIN])
             for name, p in sorted(tables.items())]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    snapshot = counts.select(F.lit(snap).cast("long").alias("snapshot"),
                             F.current_timestamp().alias("timestamp_utc"), F.lit(mode).alias("mode"),
                             "table_name", F.col("num_rows").cast("long").alias("num_rows"), "output_path", *ORIGIN)
    snapshot.coalesce(1).write.mode("append").parquet(manifest_path)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_path)


def check_row_counts(spark: SparkSession, manifest_path: str, expected: DataFrame) -> DataFrame:
    """Latest snapshot vs ``expected(table_name, expected_rows)``.

    full mode: counts must equal; small mode: counts must not exceed. A table missing
    from the snapshot fails, and so does one whose files are gone. A missing manifest raises.
    Returns ``table_name, expected_rows, num_rows, mode, ok``.
    """
    man = _read_manifest(spark, manifest_path)
    if man is None:
        raise FileNotFoundError(f"no manifest at {manifest_path}")
    last = man.agg(F.max("snapshot").alias("snapshot"))
    latest = man.join(last, "snapshot").select("table_name", "num_rows", "mode", "output_path")
    gone = [r.table_name for r in latest.select("table_name", "output_path").collect()  # a row per table
            if not _readable(spark, r.output_path)]
    mode_row = latest.select("mode").first()
    j = expected.join(latest.drop("mode", "output_path"), "table_name", "left").withColumn(
        "mode", F.lit(mode_row["mode"] if mode_row else None).cast("string"))
    ok = (F.when(F.col("num_rows").isNull() | F.col("table_name").isin(gone), F.lit(False))
          .when(F.col("mode") == "full", F.col("num_rows") == F.col("expected_rows"))
          .otherwise(F.col("num_rows") <= F.col("expected_rows")))
    return j.select("table_name", F.col("expected_rows").cast("long").alias("expected_rows"), "num_rows",
                    "mode", ok.alias("ok"))
