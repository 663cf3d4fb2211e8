"""Text-format inputs derived from the driver tables.

The reference reads qrels, id triples and runs as text files. We derive those files
from the tables with Spark (so they grow with the data), write them into a fresh folder
under the shared checkpoint folder, and read them back with the scanners. Each file mixes
well-formed lines with lines the format rules must skip or override, all produced by
a fixed rule from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.lexical import containment_qrels
from trawl.operators.util import written
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.session import scratch_dir
from trawl.sources.textformats import write_lines

OFFSET = 1_000_000_000  # docid offset of the extra 5-field qrels line per item


def t_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T binding judgments: ``qid, docid, rel`` (document contains item text).

    Judgments are few next to the corpus they are derived from, and queries read them in
    several branches (labels, ideal DCG, judged-query sets), so they are materialised
    once instead of re-scanning the collection per branch."""
    return containment_qrels(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)).checkpoint(eager=True)


def write_qrels_text(spark: SparkSession, sf_dir: str, qrels: DataFrame | None = None) -> str:
    """Text of ``qrels`` (``t_qrels`` unless given). Lines per judged pair: stale ``q 0 d 0`` then ``q\\t0\\td\\t1`` (last wins);
    per item: a 2-field line (skipped) and a 5-field line ``q 0 q+OFFSET 2 x``."""
    q = t_qrels(spark, sf_dir) if qrels is None else qrels
    items = B.t_queries(spark, sf_dir).select(F.col("id").alias("qid"))
    s = lambda c: F.col(c).cast("string")
    rows = (q.select("qid", "docid", F.lit(0).alias("seq"), F.concat_ws(" ", s("qid"), F.lit("0"), s("docid"), F.lit("0")).alias("l"))
            .unionByName(q.select("qid", "docid", F.lit(1).alias("seq"),
                                  F.concat_ws("\t", s("qid"), F.lit("0"), s("docid"), s("rel")).alias("l")))
            .unionByName(items.select("qid", F.lit(-1).cast("long").alias("docid"), F.lit(2).alias("seq"),
                                      F.concat_ws(" ", s("qid"), F.lit("0")).alias("l")))
            .unionByName(items.select("qid", (F.col("qid") + OFFSET).alias("docid"), F.lit(3).alias("seq"),
                                      F.concat_ws(" ", s("qid"), F.lit("0"), (F.col("qid") + OFFSET).cast("string"),
                                                  F.lit("2"), F.lit("x")).alias("l")))
            .unionByName(items.select("qid", (F.col("qid") + 2 * OFFSET).alias("docid"), F.lit(4).alias("seq"),
                                      F.concat_ws(" ", s("qid"), F.lit("0"), (F.col("qid") + 2 * OFFSET).cast("string"),
                                                  F.lit("0")).alias("l"))))
    return write_lines(rows, F.col("l"), ["qid", "docid", "seq"], scratch_dir(spark, "qrels"))


def v_id_triples(spark: SparkSession, sf_dir: str, k: int = 100, lab: DataFrame | None = None) -> DataFrame:
    """Per V query: first same-label and first other-label neighbour in its top k."""
    lab = lab if lab is not None else E.v_labelled_run(spark, sf_dir, k)
    t = lab.groupBy("qid").agg(
        F.min_by(F.when(F.col("is_pos"), F.col("docid")), F.when(F.col("is_pos"), F.col("rank"))).alias("pos"),
        F.min_by(F.when(~F.col("is_pos"), F.col("docid")), F.when(~F.col("is_pos"), F.col("rank"))).alias("neg"))
    return t.where(F.col("pos").isNotNull() & F.col("neg").isNotNull())


def write_triples_text(spark: SparkSession, sf_dir: str) -> str:
    """``q\\tpos\\tneg`` per query plus 2-field, 4-field and space-separated lines (skipped)."""
    t = written(v_id_triples(spark, sf_dir), "id-triples")  # read for each kind of line
    s = lambda c: F.col(c).cast("string")
    rows = (t.select("qid", F.lit(0).alias("seq"), F.concat_ws("\t", s("qid"), s("pos"), s("neg")).alias("l"))
            .unionByName(t.select("qid", F.lit(1).alias("seq"), F.concat_ws("\t", s("qid"), s("pos")).alias("l")))
            .unionByName(t.select("qid", F.lit(2).alias("seq"),
                                  F.concat_ws("\t", s("qid"), s("pos"), s("neg"), F.lit("x")).alias("l")))
            .unionByName(t.select("qid", F.lit(3).alias("seq"), F.concat_ws(" ", s("qid"), s("pos"), s("neg")).alias("l"))))
    return write_lines(rows, F.col("l"), ["qid", "seq"], scratch_dir(spark, "triples"))


def write_run_text(spark: SparkSession, sf_dir: str, k: int = 100) -> str:
    """V top-k run: 6-column lines for even docids, 3-column for odd, one 4-column line per query."""
    run = written(E.v_dense_run(spark, sf_dir, k), "dense-run")  # read for each kind of line, and to find ranges
    s = lambda c: F.col(c).cast("string")
    six = F.concat_ws(" ", s("qid"), F.lit("Q0"), s("docid"), s("rank"), s("score"), F.lit("dense"))
    three = F.concat_ws(" ", s("qid"), s("docid"), s("rank"))
    rows = run.select("qid", "rank", F.when(F.col("docid") % 2 == 0, six).otherwise(three).alias("l"))
    bad = run.where(F.col("rank") == 1).select("qid", F.lit(0).cast("long").alias("rank"),
                                               F.concat_ws(" ", s("qid"), F.lit("Q0"), s("docid"), s("rank")).alias("l"))
    return write_lines(rows.unionByName(bad), F.col("l"), ["qid", "rank"], scratch_dir(spark, "run"))


SQL_T_QRELS = """tq AS (SELECT b.item_id AS qid, d.doc_id AS docid, 1 AS rel
       FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

SQL_V_TRIPLES = """vt AS (SELECT qid, min_by(docid, rank) FILTER (WHERE is_pos) AS pos,
              min_by(docid, rank) FILTER (WHERE NOT is_pos) AS neg
       FROM lab GROUP BY qid HAVING pos IS NOT NULL AND neg IS NOT NULL)"""
