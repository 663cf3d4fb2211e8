"""Evaluation pipelines: candidates -> (score) -> rank -> label -> per-query -> aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.operators import metrics as M
from trawl.operators.knn import knn_join_exact
from trawl.plans import bindings as B

EVAL_TOP_K = 1000


def v_dense_run(spark: SparkSession, sf_dir: str, k: int = EVAL_TOP_K) -> DataFrame:
    """J9 on the V binding: ``qid, docid, score, rank``."""
    q = B.v_queries(spark, sf_dir).select("qid", "qvec")
    p = B.v_passages(spark, sf_dir).select("docid", "dvec")
    return knn_join_exact(q, p, k, exclude_self=True)


def v_labelled_run(spark: SparkSession, sf_dir: str, k: int = EVAL_TOP_K) -> DataFrame:
    run = v_dense_run(spark, sf_dir, k)
    return M.label_pairs_by_class(run, B.v_query_classes(spark, sf_dir), B.v_doc_classes(spark, sf_dir))


def v_ideal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ideal_from_classes(B.v_query_classes(spark, sf_dir), B.v_doc_classes(spark, sf_dir))


def v_per_query(spark: SparkSession, sf_dir: str, k: int = EVAL_TOP_K) -> DataFrame:
    return M.per_query_metrics(v_labelled_run(spark, sf_dir, k), v_ideal(spark, sf_dir))


def v_aggregate(spark: SparkSession, sf_dir: str, k: int = EVAL_TOP_K) -> DataFrame:
    """Flagship: dense retrieval evaluated end to end on the V binding."""
    return M.aggregate_metrics(v_per_query(spark, sf_dir, k))


# ---- SQL counterparts ------------------------------------------------------------------
def sql_v_knn(k: int = EVAL_TOP_K) -> str:
    return f"""{B.SQL_V},
knn AS (SELECT qid, docid, score,
               row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank
        FROM (SELECT q.qid, p.docid, round(list_inner_product(q.qvec, p.dvec), 9) AS score
              FROM vq q JOIN vp p ON q.qid <> p.docid)
        QUALIFY rank <= {k})"""


SQL_V_LABELLED = """lab AS (SELECT k.qid, k.docid, k.score, k.rank, (q.qlabel = p.dlabel) AS is_pos,
                   CASE WHEN q.qlabel = p.dlabel THEN 1.0 ELSE 0.0 END::DOUBLE AS gain
            FROM knn k JOIN vq q ON k.qid = q.qid JOIN vp p ON k.docid = p.docid)"""

SQL_IDCG_TABLE = """idcg_n AS (SELECT i AS n, sum(1.0 / log2(i + 1)) OVER (ORDER BY i) AS idcg
             FROM range(1, 11) t(i))"""

SQL_V_IDEAL = SQL_IDCG_TABLE + """,
ideal AS (SELECT q.qid, c.n - 1 AS num_rel, coalesce(g.idcg, 0.0)::DOUBLE AS idcg_10
          FROM vq q JOIN (SELECT dlabel, count(*) AS n FROM vp GROUP BY dlabel) c ON q.qlabel = c.dlabel
               LEFT JOIN idcg_n g ON g.n = least(c.n - 1, 10))"""

# needs CTEs ``lab`` (qid, docid, rank, gain) and ``ideal`` (qid, num_rel, idcg_10)
SQL_PER_QUERY = """x AS (SELECT *, sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM lab),
per AS (SELECT qid,
               min(CASE WHEN gain > 0 AND rank <= 10 THEN rank END) AS first_rel,
               sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) END) AS dcg,
               sum(CASE WHEN gain > 0 THEN cum / rank END) AS ap,
               count(*) FILTER (WHERE gain > 0 AND rank <= 100) AS h100,
               count(*) FILTER (WHERE gain > 0 AND rank <= 1000) AS h1000
        FROM x GROUP BY qid),
pq AS (SELECT per.qid,
              round(coalesce(ap / nullif(num_rel, 0), 0.0)::DOUBLE, 6) AS map,
              round(coalesce(dcg / nullif(idcg_10, 0), 0.0)::DOUBLE, 6) AS ndcg_at_10,
              round(coalesce(1.0 / first_rel, 0.0)::DOUBLE, 6) AS mrr_at_10,
              round(coalesce(h100 / nullif(num_rel, 0), 0.0)::DOUBLE, 6) AS recall_at_100,
              round(coalesce(h1000 / nullif(num_rel, 0), 0.0)::DOUBLE, 6) AS recall_at_1000
       FROM per JOIN ideal ON per.qid = ideal.qid)"""

SQL_AGGREGATE = """SELECT round(avg(map), 6) AS map, round(avg(ndcg_at_10), 6) AS ndcg_at_10,
       round(avg(mrr_at_10), 6) AS mrr_at_10, round(avg(recall_at_100), 6) AS recall_at_100,
       round(avg(recall_at_1000), 6) AS recall_at_1000, count(*) AS num_queries FROM pq"""


def sql_v_per_query_ctes(k: int = EVAL_TOP_K) -> str:
    return f"WITH {sql_v_knn(k)},\n{SQL_V_LABELLED},\n{SQL_V_IDEAL},\n{SQL_PER_QUERY}"
