"""Bindings from the driver's tables to the retrieval data model.

V (vectors)   ``embeddings``: every vector is a query against all other vectors
              (self excluded); relevant = same ``label``.
T (text)      ``benchmark`` items are queries, ``documents`` the collection;
              relevant = the document text contains the item text.
C (calibration) ``labels`` joined to ``documents``.
U (user turns) ``conversations`` rows with ``role = 'user'``.

Every binding reads its whole table; nothing is subset by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.util import spread


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read a driver table; prune to ``columns`` before spreading it over the cluster."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df)


# ---- V binding -------------------------------------------------------------------------
def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, qvec, qlabel``."""
    return table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]).select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))


def v_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docid, dvec, dlabel``."""
    return table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]).select(
        F.col("vec_id").alias("docid"), F.col("embedding").alias("dvec"), F.col("label").alias("dlabel"))


def v_query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_queries(spark, sf_dir).select("qid", F.col("qlabel").alias("cls"))


def v_doc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_passages(spark, sf_dir).select("docid", F.col("dlabel").alias("cls"))


# ---- T binding -------------------------------------------------------------------------
def t_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of benchmark items."""
    return table(spark, sf_dir, "benchmark", ["item_id", "text"]).select(F.col("item_id").alias("id"), "text")


def t_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of documents."""
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), "text")


# ---- C binding -------------------------------------------------------------------------
def c_labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, score, is_pos``: length-based score in [0, 1] against ``labels.quality``."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).cast("double").alias("score"),
        (F.col("quality") == 1).alias("is_pos"))


# ---- U binding -------------------------------------------------------------------------
def u_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, text`` of user turns."""
    return (table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
            .where(F.col("role") == "user").select("conv_id", "turn", "text"))


# ---- SQL text of the same bindings (DuckDB oracle) -------------------------------------
SQL_V = """vq AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec, label AS qlabel FROM embeddings),
vp AS (SELECT vec_id AS docid, CAST(embedding AS DOUBLE[]) AS dvec, label AS dlabel FROM embeddings)"""

SQL_C = """cdocs AS (SELECT l.doc_id, CAST(least(d.n_chars / 5000.0, 1.0) AS DOUBLE) AS score,
                 (l.quality = 1) AS is_pos
          FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
