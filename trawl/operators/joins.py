"""Lookup joins of the evaluation and mining pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eval_query_set(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries (``id, text``) that also have judgments."""
    return queries.join(qrels.select(F.col("qid").alias("id")).distinct(), "id", "left_semi")


def needed_passages(collection: DataFrame, candidates: DataFrame) -> DataFrame:
    """Collection rows referenced by any candidate list.

    A semi join: the planner broadcasts the distinct candidate ids when they are small
    (checked at runtime by AQE) and otherwise shuffles; the collection is only filtered.
    """
    return collection.join(candidates.select(F.col("docid").alias("id")).distinct(), "id", "left_semi")


def candidate_pairs(candidates: DataFrame, queries: DataFrame, collection: DataFrame) -> DataFrame:
    """``qid, docid, query, passage``; a missing passage text becomes ''."""
    q = queries.select(F.col("id").alias("qid"), F.col("text").alias("query"))
    p = collection.select(F.col("id").alias("docid"), F.col("text").alias("passage"))
    return (candidates.join(q, "qid").join(p, "docid", "left")
            .withColumn("passage", F.coalesce("passage", F.lit(""))))


def resume_remaining(prior: DataFrame | None, todo_queries: DataFrame, compute) -> DataFrame:
    """Skip queries already present in ``prior`` output, compute the rest, union.

    ``compute(remaining_queries) -> DataFrame`` with the same columns as ``prior``;
    queries are keyed by ``qid`` in ``todo_queries`` and ``query_id`` in the output.
    """
    if prior is None:
        return compute(todo_queries)
    done = prior.select(F.col("query_id").alias("qid")).distinct()
    remaining = todo_queries.join(done, "qid", "left_anti")
    return prior.unionByName(compute(remaining))


def pair_systems(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Align two systems' per-query values: ``qid, a, b``; unequal query sets fail."""
    x = a.select("qid", F.col(metric).alias("a"))
    y = b.select("qid", F.col(metric).alias("b"))
    both = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), "qid", "full_outer")
    only = both.where(F.col("_a").isNull() | F.col("_b").isNull())
    if not only.isEmpty():
        raise ValueError("a query is missing from one of the two systems")
    return both.select("qid", "a", "b")


def qrels_coverage(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with judgments and judged pair counts."""
    judged = qrels.join(queries.select(F.col("id").alias("qid")), "qid", "left_semi")
    return judged.agg(F.count_distinct("qid").alias("queries_with_qrels"),
                      F.count(F.lit(1)).alias("judged_pairs"),
                      F.count_distinct("docid").alias("judged_docs"))


def normalise_text(c):
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def split_overlap(train: DataFrame, evals: DataFrame) -> DataFrame:
    """Texts (normalised) present in both splits, with per-split counts.

    Aggregates per normalised-text key before joining, so a text repeated many times
    costs one row per split, never a pair per duplicate.
    """
    def keyed(df, name):
        return (df.select(F.md5(normalise_text(F.col("text"))).alias("text_key"))
                .groupBy("text_key").agg(F.count(F.lit(1)).alias(name)))

    return keyed(train, "n_train").join(keyed(evals, "n_eval"), "text_key")


def split_id_overlap(train: DataFrame, evals: DataFrame, id_col: str = "id") -> DataFrame:
    """J13 by id: ids present in both splits, with their number of rows in each.

    Counted per id before the join, so repeated ids cost one row per split; null ids
    match nothing.
    """
    def counted(df, name):
        return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias(name))

    return counted(train, "n_train").join(counted(evals, "n_eval"), id_col)
