"""The training-data pipeline: documents -> toxicity -> exact dedup -> near dedup -> PII -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet to the shared folder and reads it again as the next stage's documents. All
stages but the last return the columns of documents.

Null texts count as empty and are kept (of several null, empty or equal texts the row with the
smallest id stays; null ids come last); repeated rows are equal texts; very long texts are
read whole; an empty table gives no rows; extra columns are kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import exact_dedup, near_dedup, pii, queries, toxicity
from trawl.session import scratch_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, rejects go. Null and empty texts
    match nothing and stay; without labels the model rejects nothing."""
    return toxicity.without_toxic(docs, toxicity.fitted(docs, queries.table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays (null ids last, of repeated ids the
    first row); null equals empty."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays; texts without words
    are near nothing and stay."""
    return near_dedup.near_dedup(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; no document goes, null texts stay null."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, packed into windows: one row per piece. A null or empty text is
    its end id alone."""
    return queries.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the toxicity model nor min-max hashing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the packed pieces. An empty table gives none."""
    docs = queries.table(spark, sf_dir, "documents")
    path = scratch_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{path}/{k}-{name}")
            docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
