"""Registered evaluation queries on the V binding (flagship and its stages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import metrics as M
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.plans.registry import register

K = E.EVAL_TOP_K


@register("knn_join_exact", f"""WITH {E.sql_v_knn(100)}
SELECT qid, docid, score, rank FROM knn""")
def knn_join_exact(spark, sf_dir):
    return E.v_dense_run(spark, sf_dir, 100)


@register("label_pairs_by_class", f"""WITH {E.sql_v_knn(100)}, {E.SQL_V_LABELLED}
SELECT qid, docid, score, rank, is_pos, gain FROM lab""")
def label_pairs_by_class(spark, sf_dir):
    return E.v_labelled_run(spark, sf_dir, 100).select("qid", "docid", "score", "rank", "is_pos", "gain")


@register("ideal_from_classes", f"""WITH {B.SQL_V}, {E.SQL_V_IDEAL}
SELECT qid, num_rel, round(idcg_10, 6) AS idcg_10 FROM ideal""")
def ideal_from_classes(spark, sf_dir):
    return E.v_ideal(spark, sf_dir).withColumn("idcg_10", F.round("idcg_10", 6))


@register("per_query_metrics", f"""{E.sql_v_per_query_ctes(K)}
SELECT * FROM pq""")
def per_query_metrics(spark, sf_dir):
    return E.v_per_query(spark, sf_dir, K)


@register("aggregate_metrics", f"""{E.sql_v_per_query_ctes(K)}
{E.SQL_AGGREGATE}""")
def aggregate_metrics(spark, sf_dir):
    return E.v_aggregate(spark, sf_dir, K)


@register("mrr_at_k", f"""{E.sql_v_per_query_ctes(K)}
SELECT qid, mrr_at_10 FROM pq""")
def mrr_at_k(spark, sf_dir):
    run = E.v_labelled_run(spark, sf_dir, K)
    return M.mrr_at_k(run, 10).join(E.v_ideal(spark, sf_dir).select("qid"), "qid")


@register("ndcg_at_10", f"""{E.sql_v_per_query_ctes(K)}
SELECT qid, ndcg_at_10 FROM pq""")
def ndcg_at_10(spark, sf_dir):
    return M.ndcg_at_k(E.v_labelled_run(spark, sf_dir, K), E.v_ideal(spark, sf_dir), 10)


@register("average_precision", f"""{E.sql_v_per_query_ctes(K)}
SELECT qid, map FROM pq""")
def average_precision(spark, sf_dir):
    return M.average_precision(E.v_labelled_run(spark, sf_dir, K), E.v_ideal(spark, sf_dir))


@register("recall_at_k", f"""{E.sql_v_per_query_ctes(K)}
SELECT qid, recall_at_100, recall_at_1000 FROM pq""")
def recall_at_k(spark, sf_dir):
    return M.recall_at_k(E.v_labelled_run(spark, sf_dir, K), E.v_ideal(spark, sf_dir), (100, 1000))
