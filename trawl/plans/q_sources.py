"""Registered source queries (S1-S8) and the lexical first stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators.lexical import bm25_first_stage
from trawl.operators.selection import first_rows
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.plans import fixtures as X
from trawl.plans.registry import register
from trawl.session import scratch_dir
from trawl.sources import tables as TB
from trawl.sources import textformats as TF


@register("scan_id_text", "SELECT doc_id AS id, text FROM documents")
def scan_id_text(spark, sf_dir):
    return TB.scan_id_text(spark, f"{sf_dir}/documents.parquet", id_col="doc_id")


@register("containment_qrels", f"WITH {X.SQL_T_QRELS} SELECT qid, docid, rel FROM tq")
def containment_qrels(spark, sf_dir):
    return X.t_qrels(spark, sf_dir)


@register("scan_qrels_graded", f"""WITH {X.SQL_T_QRELS}
SELECT qid, docid, rel FROM tq
UNION ALL SELECT item_id AS qid, item_id + {X.OFFSET} AS docid, 2 AS rel FROM benchmark
UNION ALL SELECT item_id AS qid, item_id + 2 * {X.OFFSET} AS docid, 0 AS rel FROM benchmark""")
def scan_qrels_graded(spark, sf_dir):
    return TF.scan_qrels_graded(spark, X.write_qrels_text(spark, sf_dir))


@register("scan_qrels_positive", f"""WITH {X.SQL_T_QRELS}
SELECT DISTINCT qid, docid FROM tq
UNION SELECT item_id AS qid, item_id + 2 * {X.OFFSET} AS docid FROM benchmark""")
def scan_qrels_positive(spark, sf_dir):
    return TF.scan_qrels_positive(spark, X.write_qrels_text(spark, sf_dir))


@register("scan_id_triples", f"""WITH {E.sql_v_knn(100)}, {E.SQL_V_LABELLED}, {X.SQL_V_TRIPLES}
SELECT qid AS query_id, pos AS positive_id, neg AS negative_id FROM vt""")
def scan_id_triples(spark, sf_dir):
    return TF.scan_id_triples(spark, X.write_triples_text(spark, sf_dir))


@register("scan_run", f"""WITH {E.sql_v_knn(100)}
SELECT k.qid, k.docid, CAST(k.rank AS INTEGER) AS rank FROM knn k JOIN vq q ON k.qid = q.qid
WHERE q.qlabel < 5 AND k.rank <= 50""")
def scan_run(spark, sf_dir):
    wanted = B.v_queries(spark, sf_dir).where(F.col("qlabel") < 5).select("qid")
    return TF.scan_run(spark, X.write_run_text(spark, sf_dir), query_ids=wanted, top_k=50)


_BLANK = r"[\t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}\p{Zs}]+"


@register("scan_passage_lines", rf"""SELECT id, line_no, line FROM (
  SELECT id, line_no, regexp_replace(raw, '^{_BLANK}|{_BLANK}$', '', 'g') AS line
  FROM (SELECT doc_id AS id, CAST(unnest(range(len(arr))) AS BIGINT) AS line_no,
               unnest(arr) AS raw
        FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0B\f\r\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]') AS arr FROM documents)))
WHERE line <> ''""")
def scan_passage_lines(spark, sf_dir):
    return TF.scan_passage_lines(TB.scan_id_text(spark, f"{sf_dir}/documents.parquet", id_col="doc_id"))


@register("slice_shards", """SELECT doc_id AS id, text FROM documents ORDER BY doc_id LIMIT 100""")
def slice_shards(spark, sf_dir):
    return (TB.slice_shards(spark, [f"{sf_dir}/documents.parquet"], 100, id_col="doc_id")
            .select(F.col("doc_id").alias("id"), "text"))


def _shards(spark, sf_dir, rows, kind):
    """``rows`` of documents cut into three shards by doc_id, each a folder of files in id order."""
    path = scratch_dir(spark, f"shards-{kind}")
    for k in range(3):
        shard = rows.where(F.col("doc_id") % 3 == k)
        if kind == "text":
            TF.write_lines(shard, F.concat_ws("\t", "doc_id", "n_chars"), ["doc_id"], f"{path}/{k}")
        else:
            shard.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/{k}")
    return [f"{path}/{k}" for k in range(3)]


_THREE_FIFTHS = "QUALIFY row_number() OVER (ORDER BY doc_id % 3, doc_id) <= (SELECT count(*) * 3 // 5 FROM documents)"


@register("slice_shards_in_order", f"SELECT doc_id, text FROM documents {_THREE_FIFTHS}")
def slice_shards_in_order(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return TB.slice_in_order(spark, _shards(spark, sf_dir, docs, "parquet"), docs.count() * 3 // 5)


@register("slice_line_shards", f"SELECT doc_id || chr(9) || n_chars AS value FROM documents {_THREE_FIFTHS}")
def slice_line_shards(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    return TB.slice_in_order(spark, _shards(spark, sf_dir, docs, "text"), docs.count() * 3 // 5, "text")


@register("slice_shards_half", """SELECT doc_id, text FROM documents
QUALIFY row_number() OVER (ORDER BY source, doc_id) <= (SELECT count(*) // 2 FROM documents)""")
def slice_shards_half(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return first_rows(docs, ["source", "doc_id"], docs.count() // 2).drop("source")


def sql_bm25(qsrc: str = "SELECT item_id AS qid, text FROM benchmark", k: int = 1000, name: str = "bm") -> str:
    """DuckDB BM25 over ``documents`` for the queries of ``qsrc`` (``qid, text``); CTE ``name``."""
    tok = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]+)', 1)"
    return f"""{name}_dt AS (SELECT doc_id AS docid, {tok.format('text')} AS toks FROM documents),
{name}_ds AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {name}_dt),
{name}_qt AS (SELECT qid, term, count(*) AS qtf FROM (
         SELECT qid, unnest({tok.format('text')}) AS term FROM ({qsrc})) GROUP BY qid, term),
{name}_hits AS (SELECT docid, len(toks) AS dl, unnest(toks) AS term FROM {name}_dt),
{name}_tf AS (SELECT docid, term, dl, count(*) AS tf FROM {name}_hits
              WHERE term IN (SELECT term FROM {name}_qt) GROUP BY docid, term, dl),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_w AS (SELECT q.qid, q.term, q.qtf * ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS w
      FROM {name}_qt q JOIN {name}_df d ON q.term = d.term, {name}_ds s),
{name}_sc AS (SELECT w.qid, tf.docid,
              round(sum(w.w * tf.tf * (0.9 + 1.0) / (tf.tf + 0.9 * (1.0 - 0.4 + 0.4 * tf.dl / s.avgdl))), 6) AS score
       FROM {name}_w w JOIN {name}_tf tf ON w.term = tf.term, {name}_ds s GROUP BY w.qid, tf.docid),
{name} AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank
       FROM {name}_sc QUALIFY rank <= {k})"""


SQL_BM25 = sql_bm25()


@register("bm25_first_stage", f"WITH {SQL_BM25} SELECT qid, docid, score, rank FROM bm")
def bm25(spark, sf_dir):
    return bm25_first_stage(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), 1000)
