"""Registered ranking, per-system metric, release and sink queries
(R2-R5, R7-R8, E7-E10, C9-C10, J10, S9-S11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trawl.functions import text as TX
from trawl.operators import joins as J
from trawl.operators import metrics as M
from trawl.operators import quality as Q
from trawl.operators import ranking as R
from trawl.operators.encoding import encode_texts, letter_counts
from trawl.operators.knn import knn_join_ivf, knn_recall
from trawl.operators.lexical import bm25_first_stage
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.plans import fixtures as X
from trawl.plans import sqlgen as G
from trawl.plans.q_mining import two_stage_sql_pair, two_systems
from trawl.plans.q_quality import SEED, SQL_DROPS, _drop_inputs
from trawl.plans.q_sources import sql_bm25
from trawl.operators.util import scalars
from trawl.plans.registry import register
from trawl.session import scratch_dir
from trawl.sources import sinks as SK

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


# ---- T systems: BM25 and the overlap reranker of its top 100 ------------------------------
def t_systems(spark, sf_dir):
    """BM25 (materialised once: both systems and their metrics read it) and its reranking."""
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    bm = bm25_first_stage(q, c, 1000).checkpoint(eager=True)
    ov = R.overlap_rerank(bm.where(F.col("rank") <= 100), q, c)
    return bm, ov


SQL_OV = f"""ovs AS (SELECT t.qid, t.docid, {G.overlap('b.text', 'd.text')}::DOUBLE AS score
        FROM bm t JOIN benchmark b ON t.qid = b.item_id JOIN documents d ON t.docid = d.doc_id WHERE t.rank <= 100),
ov AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM ovs)"""

SQL_T_SYS = f"WITH {sql_bm25()}, {X.SQL_T_QRELS}, {SQL_OV}"


@register("rerank", f"{SQL_T_SYS} SELECT qid, docid, score, rank FROM ov WHERE rank <= 10")
def rerank(spark, sf_dir):
    _, ov = t_systems(spark, sf_dir)
    return ov.where(F.col("rank") <= 10)


@register("rerank_numbered", f"{SQL_T_SYS} SELECT qid, docid, round(score, 4) AS score, rank FROM ov")
def rerank_numbered(spark, sf_dir):
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    bm = bm25_first_stage(q, c, 100)
    pairs = J.candidate_pairs(bm.select("qid", "docid"), q, c)
    return R.rerank_numbered(R.score_pairs(pairs).select("qid", "docid", "score"))


@register("two_stage", f"""WITH {sql_bm25()},
ts AS (SELECT t.qid, t.docid, {G.overlap('b.text', 'd.text')}::DOUBLE AS score
       FROM bm t JOIN benchmark b ON t.qid = b.item_id JOIN documents d ON t.docid = d.doc_id WHERE t.rank <= 50)
SELECT qid, docid, score, rank FROM (
  SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM ts)
WHERE rank <= 10""")
def two_stage(spark, sf_dir):
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    return R.two_stage(bm25_first_stage(q, c, 1000), q, c, k=50, top_n=10)


@register("top1_per_query", f"{SQL_T_SYS} SELECT qid, docid, score FROM ov WHERE rank = 1")
def top1_per_query(spark, sf_dir):
    _, ov = t_systems(spark, sf_dir)
    return R.top1_per_query(ov.drop("rank"))


SQL_T_LAB = f"""{SQL_T_SYS},
runs AS (SELECT 'bm25' AS system, qid, docid, score, rank FROM bm WHERE rank <= 100
         UNION ALL SELECT 'overlap', qid, docid, score, rank FROM ov),
lab AS (SELECT r.*, (t.rel IS NOT NULL) AS is_pos FROM runs r LEFT JOIN tq t ON r.qid = t.qid AND r.docid = t.docid),
judged AS (SELECT DISTINCT qid FROM tq),
mrr AS (SELECT system, qid, round(coalesce(1.0 / min(rank) FILTER (WHERE is_pos AND rank <= 10), 0.0), 6)::DOUBLE AS m
        FROM lab WHERE qid IN (SELECT qid FROM judged) GROUP BY system, qid),
p3 AS (SELECT s.system, j.qid, coalesce(max(CASE WHEN l.is_pos AND l.rank <= 3 THEN 1 ELSE 0 END), 0) AS hit
       FROM (SELECT DISTINCT system FROM runs) s CROSS JOIN judged j
       LEFT JOIN lab l ON l.system = s.system AND l.qid = j.qid GROUP BY s.system, j.qid)"""


def _t_ranked_by_system(spark, sf_dir):
    bm, ov = t_systems(spark, sf_dir)
    return (bm.where(F.col("rank") <= 100).withColumn("system", F.lit("bm25"))
            .unionByName(ov.withColumn("system", F.lit("overlap"))))


@register("hit_at_1", f"""{SQL_T_LAB}
SELECT system, round(avg(CASE WHEN is_pos THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_at_1, count(*) AS num_queries
FROM lab WHERE rank = 1 AND qid IN (SELECT qid FROM judged) GROUP BY system""")
def hit_at_1(spark, sf_dir):
    return R.hit_at_1(_t_ranked_by_system(spark, sf_dir), X.t_qrels(spark, sf_dir))


@register("pass_rate_top3", f"""{SQL_T_LAB}
SELECT round(avg(hit::DOUBLE), 6) AS pass_rate, count(*) AS num_cases, round(avg(hit::DOUBLE), 6) >= 0.8 AS passed
FROM p3 WHERE system = 'bm25'""")
def pass_rate_top3(spark, sf_dir):
    bm, _ = t_systems(spark, sf_dir)
    return R.pass_rate_top3(bm, X.t_qrels(spark, sf_dir))


# ---- E on T with explicit qrels ------------------------------------------------------------
SQL_T_PQ = f"""WITH {sql_bm25()}, {X.SQL_T_QRELS}, {E.SQL_IDCG_TABLE},
jq AS (SELECT qid, docid, rel FROM tq UNION ALL SELECT item_id, item_id + {2 * X.OFFSET}, 0 FROM benchmark),
lab AS (SELECT b.qid, b.docid, b.rank, coalesce(CAST(t.rel AS DOUBLE), 0.0) AS gain
        FROM bm b LEFT JOIN jq t ON b.qid = t.qid AND b.docid = t.docid),
rr AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS i FROM jq),
ideal AS (SELECT qid, count(*) FILTER (WHERE rel > 0) AS num_rel,
                 coalesce(sum(CASE WHEN rel > 0 AND i <= 10 THEN rel / log2(i + 1) END), 0.0) AS idcg_10
          FROM rr GROUP BY qid),
{E.SQL_PER_QUERY}"""


def t_judged(spark, sf_dir):
    """The containment judgments and one negative judgment per item, so that items that no
    document contains are judged queries without a positive."""
    items = B.t_queries(spark, sf_dir).select(F.col("id").alias("qid"))
    qrels = X.t_qrels(spark, sf_dir).select("qid", "docid", F.col("rel").cast("int").alias("rel"))
    return qrels.unionByName(items.select("qid", (F.col("qid") + 2 * X.OFFSET).alias("docid"), F.lit(0).alias("rel")))


def t_per_query(spark, sf_dir):
    bm, _ = t_systems(spark, sf_dir)
    qrels = t_judged(spark, sf_dir)
    return M.per_query_metrics(M.label_pairs(bm, qrels), M.ideal_from_qrels(qrels))


@register("per_query_metrics_bm25", f"{SQL_T_PQ} SELECT * FROM pq")
def per_query_metrics_bm25(spark, sf_dir):
    return t_per_query(spark, sf_dir)


@register("aggregate_metrics_bm25", f"{SQL_T_PQ} {E.SQL_AGGREGATE}")
def aggregate_metrics_bm25(spark, sf_dir):
    return M.aggregate_metrics(t_per_query(spark, sf_dir))


@register("ideal_from_qrels", f"""{SQL_T_PQ} SELECT qid, num_rel, round(idcg_10, 6) AS idcg_10 FROM ideal""")
def ideal_from_qrels(spark, sf_dir):
    return M.ideal_from_qrels(t_judged(spark, sf_dir)).withColumn("idcg_10", F.round("idcg_10", 6))


_AGG_COLS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in M.METRIC_COLUMNS)


@register("metrics_by_stratum", f"""{E.sql_v_per_query_ctes(E.EVAL_TOP_K)}
SELECT coalesce(CAST(q.qlabel AS VARCHAR), 'all') AS stratum, {_AGG_COLS}, count(*) AS num_queries
FROM pq JOIN vq q ON pq.qid = q.qid GROUP BY ROLLUP (CAST(q.qlabel AS VARCHAR))""")
def metrics_by_stratum(spark, sf_dir):
    strata = B.v_queries(spark, sf_dir).select("qid", F.col("qlabel").cast("string").alias("stratum"))
    return M.metrics_by_stratum(E.v_per_query(spark, sf_dir), strata)


@register("compare_systems", f"""{two_stage_sql_pair()},
agg AS (SELECT 'dense' AS system, round(avg(a), 6) AS mrr_at_10 FROM pr
        UNION ALL SELECT 'random', round(avg(b), 6) FROM pr)
SELECT system, mrr_at_10, round(mrr_at_10 - (SELECT mrr_at_10 FROM agg WHERE system = 'dense'), 6) AS delta
FROM agg""")
def compare_systems(spark, sf_dir):
    a, b = two_systems(spark, sf_dir)
    agg = (a.agg(F.round(F.avg("mrr_at_10"), 6).alias("mrr_at_10")).withColumn("system", F.lit("dense"))
           .unionByName(b.agg(F.round(F.avg("mrr_at_10"), 6).alias("mrr_at_10")).withColumn("system", F.lit("random"))))
    return M.compare_systems(agg, "dense")


def _t_mrr_judged(run, qrels):
    lab = M.label_pairs(run, qrels)
    return M.mrr_at_k(lab, 10).join(qrels.select("qid").distinct(), "qid", "left_semi")


@register("variant_gap", f"""WITH {sql_bm25(k=10)},
{sql_bm25("SELECT item_id AS qid, strip_accents(text) AS text FROM benchmark", k=10, name="bv")},
{X.SQL_T_QRELS},
ma AS (SELECT b.qid, round(coalesce(1.0 / min(b.rank) FILTER (WHERE t.rel IS NOT NULL), 0.0), 6)::DOUBLE AS m
       FROM bm b LEFT JOIN tq t ON b.qid = t.qid AND b.docid = t.docid
       WHERE b.qid IN (SELECT qid FROM tq) GROUP BY b.qid),
mb AS (SELECT b.qid, round(coalesce(1.0 / min(b.rank) FILTER (WHERE t.rel IS NOT NULL), 0.0), 6)::DOUBLE AS m
       FROM bv b LEFT JOIN tq t ON b.qid = t.qid AND b.docid = t.docid
       WHERE b.qid IN (SELECT qid FROM tq) GROUP BY b.qid)
SELECT round(avg(ma.m), 6) AS mean_a, round(avg(mb.m), 6) AS mean_b, round(abs(avg(ma.m) - avg(mb.m)), 6) AS gap,
       count(*) AS num_pairs, round(abs(avg(ma.m) - avg(mb.m)), 6) < 0.05 AS passed
FROM ma JOIN mb ON ma.qid = mb.qid""")
def variant_gap(spark, sf_dir):
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    qrels = X.t_qrels(spark, sf_dir)
    qv = q.select("id", TX.strip_accents(F.col("text")).alias("text"))
    a = _t_mrr_judged(bm25_first_stage(q, c, 10), qrels)
    b = _t_mrr_judged(bm25_first_stage(qv, c, 10), qrels)
    return M.variant_gap(a, b, "mrr_at_10", 0.05)


# ---- C9 metric drop: BM25 MRR@10 under each query perturbation ------------------------------
_PERT_NAMES = list(TX.SCORE_DROP_THRESHOLD)
_TP = G.perturbations("text", SEED, ["item_id"])
_VARIANTS_SQL = " UNION ALL ".join(
    ["SELECT item_id * 8 AS qid, text FROM benchmark"]
    + [f"SELECT item_id * 8 + {i + 1} AS qid, {_TP[k]} AS text FROM benchmark" for i, k in enumerate(_PERT_NAMES)])
_KIND_SQL = " UNION ALL ".join(["SELECT 0 AS k, 'original' AS perturbation"]
                               + [f"SELECT {i + 1}, '{k}'" for i, k in enumerate(_PERT_NAMES)])


@register("metric_drop", f"""WITH {sql_bm25(_VARIANTS_SQL, k=10, name='bp')},
{X.SQL_T_QRELS},
kinds AS ({_KIND_SQL}),
per AS (SELECT j.qid AS base_qid, kk.k, round(coalesce(1.0 / min(b.rank) FILTER (WHERE t.rel IS NOT NULL), 0.0), 6)::DOUBLE AS m
        FROM (SELECT DISTINCT qid FROM tq) j CROSS JOIN kinds kk
        LEFT JOIN bp b ON b.qid = j.qid * 8 + kk.k
        LEFT JOIN tq t ON t.qid = j.qid AND t.docid = b.docid
        GROUP BY j.qid, kk.k),
means AS (SELECT k, avg(m) AS mm FROM per GROUP BY k)
SELECT kk.perturbation, round(o.mm, 6) AS mrr_original, round(p.mm, 6) AS mrr_perturbed,
       round(CASE WHEN o.mm > 0 THEN (o.mm - p.mm) / o.mm ELSE 0.0 END, 6) AS rel_drop
FROM means p JOIN kinds kk ON p.k = kk.k, (SELECT mm FROM means WHERE k = 0) o WHERE p.k > 0""")
def metric_drop(spark, sf_dir):
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    qrels = X.t_qrels(spark, sf_dir)
    reg = TX.perturbations(F.col("text"), SEED, F.col("id"))
    variants = [q.select((F.col("id") * 8).alias("id"), "text")] + [
        q.select((F.col("id") * 8 + i + 1).alias("id"), reg[k].alias("text")) for i, k in enumerate(_PERT_NAMES)]
    vq = reduce(lambda a, b: a.unionByName(b), variants)
    run = bm25_first_stage(vq, c, 10)
    run = run.select((F.floor(F.col("qid") / 8)).cast("long").alias("base_qid"), F.pmod("qid", F.lit(8)).alias("k"),
                     "docid", "rank")
    names = ["original"] + _PERT_NAMES
    judged = qrels.select(F.col("qid").alias("base_qid")).distinct()
    # every judged query under every variant k (a query with no hit scores 0)
    grid = judged.select("base_qid", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)).cast("array<long>")).alias("k"))
    rel = qrels.select(F.col("qid").alias("base_qid"), "docid", F.lit(True).alias("_rel"))
    lab = (grid.join(run, ["base_qid", "k"], "left").join(rel, ["base_qid", "docid"], "left"))
    per = lab.groupBy("base_qid", "k").agg(
        F.round(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("_rel"), F.col("rank"))), F.lit(0.0)), 6).alias("m")).checkpoint(eager=True)
    means = per.groupBy("k").agg(F.avg("m").alias("mm"))
    o = scalars(means.where(F.col("k") == 0).select(F.col("mm").alias("o")))["o"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") + 1).cast("int"))
    return means.where(F.col("k") > 0).select(
        name.alias("perturbation"), F.round(F.lit(o), 6).alias("mrr_original"), F.round("mm", 6).alias("mrr_perturbed"),
        F.round(F.when(F.lit(o) > 0, (F.lit(o) - F.col("mm")) / F.lit(o)).otherwise(F.lit(0.0)), 6).alias("rel_drop"))


# ---- C10 release gate --------------------------------------------------------------------
def gate_metrics(spark, sf_dir):
    """Long ``system, metric, value`` table for the release gate, computed per system with
    grouped aggregates over the union of the systems' runs (no per-system plans)."""
    ranked = _t_ranked_by_system(spark, sf_dir).checkpoint(eager=True)
    qrels = X.t_qrels(spark, sf_dir)
    lab = M.label_pairs(ranked, qrels)
    judged = qrels.select("qid").distinct()
    systems = ["bm25", "overlap"]
    # every judged query under every system (a query without candidates scores 0)
    grid = judged.select("qid", F.explode(F.array(*[F.lit(x) for x in systems])).alias("system"))
    per_q = (grid.join(lab, ["system", "qid"], "left").groupBy("system", "qid").agg(
        F.round(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("is_pos") & (F.col("rank") <= 10), F.col("rank"))),
                           F.lit(0.0)), 6).alias("mrr"),
        F.coalesce(F.max(F.when(F.col("is_pos") & (F.col("rank") <= 3), F.lit(1))), F.lit(0)).alias("hit3")))
    by_sys = per_q.groupBy("system").agg(F.avg("mrr").alias("mrr"),
                                         F.round(F.avg(F.col("hit3").cast("double")), 6).alias("pass_rate"))
    base = scalars(by_sys.where(F.col("system") == "bm25").select("mrr"))["mrr"]
    n_sys = lab.groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    bins = (lab.select("system", Q.bin_index(F.col("score")).alias("bin"), "score", "is_pos")
            .where(F.col("bin").isNotNull()).groupBy("system", "bin")
            .agg(F.count(F.lit(1)).alias("nb"),
                 F.abs(F.avg("score") - F.avg(F.col("is_pos").cast("double"))).alias("g")))
    ece = (n_sys.join(bins, "system", "left").groupBy("system")
           .agg(F.round(F.coalesce(F.sum(F.col("nb") / F.col("n") * F.col("g")), F.lit(0.0)), 6).alias("v")))
    rows = [by_sys.select("system", F.lit("qualitative_pass_rate").alias("metric"), F.col("pass_rate").alias("v")),
            ece.select("system", F.lit("ece").alias("metric"), "v"),
            by_sys.select("system", F.lit("mrr10_gain_over_baseline").alias("metric"),
                          (F.col("mrr") - F.lit(base)).alias("v"))]
    orig, pert = _drop_inputs(spark, sf_dir)
    drops = Q.score_drop(orig, pert, ["conv_id", "turn"], TX.SCORE_DROP_THRESHOLD)
    rob = drops.select(
        F.when(F.col("perturbation") == "no_accent", "robustness_drop_no_accents")
        .when(F.col("perturbation") == "typo_2chars", "robustness_drop_typos")
        .when(F.col("perturbation").isin("case_lower", "case_upper"), "robustness_drop_case").alias("metric"),
        F.col("mean_rel_drop").alias("v")).where(F.col("metric").isNotNull())
    rows.append(rob.groupBy("metric").agg(F.max("v").alias("v")).select(F.lit("overlap").alias("system"), "metric", "v"))
    return reduce(lambda a, b: a.unionByName(b), rows).withColumnRenamed("v", "value")


_THR_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, {t}::DOUBLE AS threshold, '{k}' AS kind"
                              for m, t, k in Q.RELEASE_THRESHOLDS)
_BINS_L = G.bin_expr("score")


@register("release_gate", f"""{SQL_T_LAB}, {SQL_DROPS},
eb AS (SELECT system, score, is_pos, {_BINS_L} AS bin FROM lab),
eper AS (SELECT system, bin, count(*) AS nb, abs(avg(score) - avg(is_pos::INTEGER::DOUBLE)) AS g
         FROM eb WHERE bin IS NOT NULL GROUP BY system, bin),
etot AS (SELECT system, count(*) AS n FROM lab GROUP BY system),
ece AS (SELECT t.system, round(coalesce(sum(e.nb / t.n * e.g), 0.0), 6) AS v FROM etot t
        LEFT JOIN eper e ON e.system = t.system GROUP BY t.system),
mm AS (SELECT system, avg(m) AS v FROM mrr GROUP BY system),
metrics AS (
  SELECT system, 'qualitative_pass_rate' AS metric, round(avg(hit::DOUBLE), 6) AS value FROM p3 GROUP BY system
  UNION ALL SELECT system, 'ece', v FROM ece
  UNION ALL SELECT system, 'mrr10_gain_over_baseline', v - (SELECT v FROM mm WHERE system = 'bm25') FROM mm
  UNION ALL SELECT 'overlap', metric, max(v) FROM (
      SELECT CASE WHEN perturbation = 'no_accent' THEN 'robustness_drop_no_accents'
                  WHEN perturbation = 'typo_2chars' THEN 'robustness_drop_typos'
                  WHEN perturbation IN ('case_lower', 'case_upper') THEN 'robustness_drop_case' END AS metric,
             round(avg(rel_drop), 6) AS v
      FROM dd GROUP BY perturbation) WHERE metric IS NOT NULL GROUP BY metric),
thr AS ({_THR_SQL}),
need AS (SELECT s.system, t.* FROM (SELECT DISTINCT system FROM metrics) s CROSS JOIN thr t),
chk AS (SELECT n.system, n.metric,
               CASE WHEN m.value IS NULL THEN false WHEN n.kind = 'min' THEN m.value >= n.threshold
                    ELSE m.value < n.threshold END AS ok
        FROM need n LEFT JOIN metrics m ON m.system = n.system AND m.metric = n.metric)
SELECT system, bool_and(ok) AS passed, list_sort(list(metric) FILTER (WHERE NOT ok)) AS failures
FROM chk GROUP BY system""")
def release_gate(spark, sf_dir):
    return Q.release_gate(gate_metrics(spark, sf_dir))


# ---- J10 / E10 (approximate search: rows-only check) ---------------------------------------
@register("knn_join_ivf")
def knn_join_ivf_q(spark, sf_dir):
    q = B.v_queries(spark, sf_dir).select("qid", "qvec")
    p = B.v_passages(spark, sf_dir).select("docid", "dvec")
    return knn_join_ivf(q, p, 100, exclude_self=True)


@register("knn_recall")
def knn_recall_q(spark, sf_dir):
    q = B.v_queries(spark, sf_dir).select("qid", "qvec")
    p = B.v_passages(spark, sf_dir).select("docid", "dvec")
    # two fifths of the passages, in fewer than half of the cells: an approximate search
    approx = knn_join_ivf(q, p, 10, exclude_self=True, probe_rows=p.count() * 2 // 5)
    return knn_recall(approx, E.v_dense_run(spark, sf_dir, 10), 10)


@register("knn_join_ivf_all_cells", f"""WITH {E.sql_v_knn(100)} SELECT qid, docid, rank FROM knn""")
def knn_join_ivf_all_cells(spark, sf_dir):
    """Every cell is probed, so the result is the exact one."""
    q = B.v_queries(spark, sf_dir).select("qid", "qvec")
    p = B.v_passages(spark, sf_dir).select("docid", "dvec")
    return knn_join_ivf(q, p, 100, exclude_self=True, nlist=16, nprobe=16).select("qid", "docid", "rank")


@register("two_stage_dense", f"""WITH {B.SQL_V},
c AS (SELECT q.qid, p.docid, round(list_inner_product(q.qvec, p.dvec), 9) AS score,
             row_number() OVER (PARTITION BY q.qid ORDER BY
               round(list_inner_product(q.qvec[1:16], p.dvec[1:16]), 9) DESC, p.docid) AS r
      FROM vq q JOIN vp p ON q.qid <> p.docid QUALIFY r <= 100)
SELECT qid, docid, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM c) WHERE rank <= 10""")
def two_stage_dense(spark, sf_dir):
    q = B.v_queries(spark, sf_dir).select("qid", "qvec")
    p = B.v_passages(spark, sf_dir).select("docid", "dvec")
    return R.two_stage_dense(q, p, 16, 100, 10, exclude_self=True).withColumn("score", F.round("score", 6))


_LETTERS = "etaoinsh"


@register("encode_texts", "SELECT doc_id, " + ", ".join(
    f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')))::DOUBLE AS v{i}"
    for i, c in enumerate(_LETTERS)) + " FROM documents")
def encode_texts_q(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return encode_texts(docs, letter_counts).select(
        "doc_id", *[F.col("vec")[i].cast("double").alias(f"v{i}") for i in range(len(_LETTERS))])


# ---- S9-S11 -------------------------------------------------------------------------------
@register("sink_parquet", f"""{E.sql_v_per_query_ctes(E.EVAL_TOP_K)}
SELECT * FROM pq""")
def sink_parquet(spark, sf_dir):
    out = scratch_dir(spark, "sink")
    per_q = E.v_per_query(spark, sf_dir)
    SK.sink_parquet(per_q, f"{out}/per_query.parquet")
    SK.sink_json(M.aggregate_metrics(spark.read.parquet(f"{out}/per_query.parquet")), f"{out}/aggregate.json")
    return spark.read.parquet(f"{out}/per_query.parquet")


_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in TABLES)


def _manifest(spark, sf_dir):
    path = scratch_dir(spark, "manifest")
    tables = {t: f"{sf_dir}/{t}.parquet" for t in TABLES}
    SK.snapshot_manifest(spark, tables, path, "small")
    SK.snapshot_manifest(spark, tables, path, "full")
    return path


@register("snapshot_manifest", f"""SELECT 1::BIGINT AS snapshot, 'small' AS mode, table_name, num_rows FROM ({_COUNTS_SQL})
UNION ALL SELECT 2::BIGINT, 'full', table_name, num_rows FROM ({_COUNTS_SQL})""")
def snapshot_manifest(spark, sf_dir):
    path = _manifest(spark, sf_dir)
    return spark.read.parquet(path).select("snapshot", "mode", "table_name", "num_rows")


@register("check_row_counts", f"""WITH c AS ({_COUNTS_SQL}),
e AS (SELECT table_name, num_rows + CASE WHEN table_name = 'lineitem' THEN 1 ELSE 0 END AS expected_rows FROM c
      UNION ALL SELECT 'queries_dev', 100)
SELECT e.table_name, e.expected_rows, c.num_rows, 'full' AS mode, coalesce(c.num_rows = e.expected_rows, false) AS ok
FROM e LEFT JOIN c ON e.table_name = c.table_name""")
def check_row_counts(spark, sf_dir):
    path = _manifest(spark, sf_dir)
    counts = spark.read.parquet(path).where(F.col("snapshot") == 1).select("table_name", "num_rows")
    expected = counts.select("table_name", (F.col("num_rows") + F.when(F.col("table_name") == "lineitem", 1)
                                            .otherwise(0)).alias("expected_rows"))
    expected = expected.unionByName(spark.createDataFrame([("queries_dev", 100)], "table_name string, expected_rows long"))
    return SK.check_row_counts(spark, path, expected)



# ---- streaming: resumable scoring of candidate files ----------------------------------------
@register("stream_score_pairs", f"""WITH {sql_bm25()}
SELECT t.qid, t.docid, round({G.overlap('b.text', 'd.text')}, 6)::DOUBLE AS score
FROM bm t JOIN benchmark b ON t.qid = b.item_id JOIN documents d ON t.docid = d.doc_id WHERE t.rank <= 100""")
def stream_score_pairs(spark, sf_dir):
    from trawl.streaming.incremental import stream_score

    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    cands = J.candidate_pairs(bm25_first_stage(q, c, 100).select("qid", "docid"), q, c)
    base = scratch_dir(spark, "stream")
    # candidate files land in chunks (by a hash of the pair, so no query is one file), as a long scoring job would receive them
    cands.repartition("qid", "docid").write.mode("overwrite").parquet(f"{base}/candidates")
    return stream_score(spark, f"{base}/candidates", f"{base}/scores", f"{base}/checkpoint",
                        cands.schema, max_files_per_trigger=1)
