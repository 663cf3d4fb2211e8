"""Incremental, resumable scoring with Structured Streaming.

Long scoring jobs (hours of model inference over millions of candidate pairs) should
survive interruptions without redoing finished work. Candidate pairs land as parquet
files in a folder; a streaming query scores each new file and appends the scores to a
parquet sink. The checkpoint folder records which files were committed, so a restarted
query (after a lost driver, a preempted cluster, or simply new files arriving) processes
only what is new. The file sink's commit log makes the output exactly-once.

``trigger(availableNow=True)`` drains everything present and stops, which makes the
same code usable as a batch job that can be re-run safely.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trawl.operators.ranking import score_pairs


def stream_score(spark: SparkSession, candidates_dir: str, out_dir: str, checkpoint_dir: str,
                 schema: StructType | str, *, scorer: Callable | None = None, batch: bool = False,
                 max_files_per_trigger: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Score every candidate file not yet committed; return the whole scored output.

    ``candidates_dir`` holds ``qid, docid, query, passage`` parquet files; the output has
    ``keep`` columns (default ``qid, docid``) plus ``score``.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(candidates_dir)
    keep = keep or ["qid", "docid"]
    scored = score_pairs(src, scorer, batch=batch).select(*keep, "score")
    q = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir).option("path", out_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
