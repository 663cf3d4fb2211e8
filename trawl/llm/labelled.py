"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators.selection import first_rows
from trawl.session import scratch_dir


def id_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod`` (null ids: 0, so they are held out or not like any)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out
    remainder, written once to the shared folder.

    Rows are chosen by a hash of the id, so the choice does not depend on order. Null ids
    and labels are left out; an id labelled both ways counts as 1; of repeated documents
    one row is used.
    """
    known = (labels.select("doc_id", F.col(label_col).cast("int").alias("label")).dropna()
             .where(id_remainder("doc_id", mod) != held_out)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = first_rows(known, [F.xxhash64("doc_id"), "doc_id"], most)
    found = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
             .join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    path = scratch_dir(docs.sparkSession, f"sample-{label_col}")
    found.write.parquet(path)
    return docs.sparkSession.read.parquet(path)
