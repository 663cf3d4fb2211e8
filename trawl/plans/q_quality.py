"""Registered statistics, calibration, robustness and text-function queries
(T1-T2, C1-C11, F1-F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import text as TX
from trawl.functions import vectors as VX
from trawl.functions.hashing import sql_hash_key
from trawl.operators import quality as Q
from trawl.operators import stats as S
from trawl.operators.lexical import bm25_first_stage
from trawl.operators.ranking import score_pairs, token_overlap, top1_per_query
from trawl.operators.resample import MEAN
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.plans import sqlgen as G
from trawl.plans.q_mining import two_stage_sql_pair, two_systems
from trawl.plans.q_sources import sql_bm25
from trawl.plans.registry import register

SEED = 42
B_RESAMPLES = 1000


def u_pairs(spark, sf_dir):
    """U binding pairs: each user turn with the assistant reply that follows it."""
    c = B.table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("passage"))
    return u.join(a, ["conv_id", "turn"])


def _sql_draws(n_expr_cte: str) -> str:
    h = sql_hash_key(SEED, "id // n", "id % n")
    return f"""dr AS (SELECT id // n AS b, {h} % n AS idx
       FROM (SELECT unnest(range(n * {B_RESAMPLES})) AS id, n FROM {n_expr_cte}))"""


# ---- T1 / T2 ---------------------------------------------------------------------------
@register("bootstrap_ci", f"""{E.sql_v_per_query_ctes(E.EVAL_TOP_K)},
ix AS (SELECT mrr_at_10 AS v, row_number() OVER (ORDER BY qid) - 1 AS idx FROM pq),
nn AS (SELECT count(*) AS n FROM ix),
{_sql_draws('nn')},
res AS (SELECT b, avg(v) AS m FROM dr JOIN ix ON dr.idx = ix.idx GROUP BY b)
SELECT round((SELECT avg(v) FROM ix), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low,
       round(quantile_cont(m, 0.975), 6) AS ci_high, {B_RESAMPLES} AS n_resamples, 0.95::DOUBLE AS confidence
FROM res""")
def bootstrap_ci(spark, sf_dir):
    return S.bootstrap_ci(E.v_per_query(spark, sf_dir), "mrr_at_10", n_resamples=B_RESAMPLES, seed=SEED)


@register("paired_bootstrap", f"""{two_stage_sql_pair()},
d AS (SELECT qid, a - b AS d FROM pr),
ob AS (SELECT avg(d) AS obs FROM d),
ix AS (SELECT d.d - ob.obs AS c, row_number() OVER (ORDER BY qid) - 1 AS idx FROM d, ob),
nn AS (SELECT count(*) AS n FROM ix),
{_sql_draws('nn')},
res AS (SELECT b, avg(c) AS m FROM dr JOIN ix ON dr.idx = ix.idx GROUP BY b),
cnt AS (SELECT count(*) FILTER (WHERE m >= (SELECT obs FROM ob)) AS c FROM res)
SELECT round(obs, 6) AS observed_diff,
       round(CASE WHEN obs <= 0 THEN 1.0 ELSE (c + 1) / {float(B_RESAMPLES + 1)} END, 6)::DOUBLE AS p_value,
       {B_RESAMPLES} AS n_resamples, (SELECT n FROM nn) AS num_queries FROM ob, cnt""")
def paired_bootstrap(spark, sf_dir):
    from trawl.operators.joins import pair_systems

    a, b = two_systems(spark, sf_dir)
    return S.paired_bootstrap(pair_systems(a, b, "mrr_at_10"), n_resamples=B_RESAMPLES, seed=SEED)


# ---- C1-C7 on the C binding -------------------------------------------------------------
SQL_CB = f"""{B.SQL_C},
cb AS (SELECT score, is_pos, {G.bin_expr('score')} AS bin FROM cdocs)"""


@register("reliability_bins", f"""WITH {SQL_CB},
per AS (SELECT bin, count(*) AS n, avg(score) AS ms, avg(is_pos::INTEGER::DOUBLE) AS pr FROM cb
        WHERE bin IS NOT NULL GROUP BY bin),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT bins.bin, round(bins.bin * 0.1::DOUBLE, 2) AS lo, round((bins.bin + 1) * 0.1::DOUBLE, 2) AS hi,
       coalesce(per.n, 0) AS n, round(ms, 6) AS mean_score, round(pr, 6) AS pos_rate, round(abs(ms - pr), 6) AS gap
FROM bins LEFT JOIN per ON bins.bin = per.bin""")
def reliability_bins(spark, sf_dir):
    return Q.reliability_bins(B.c_labelled_docs(spark, sf_dir))


@register("ece_brier", f"""WITH {SQL_CB},
per AS (SELECT bin, count(*) AS nb, abs(avg(score) - avg(is_pos::INTEGER::DOUBLE)) AS g FROM cb
        WHERE bin IS NOT NULL GROUP BY bin),
tot AS (SELECT count(*) AS n, avg(pow(score - is_pos::INTEGER::DOUBLE, 2)) AS brier FROM cdocs)
SELECT round(coalesce((SELECT sum(nb / n * g) FROM per, tot), 0.0), 6) AS ece, round(brier, 6) AS brier, n FROM tot""")
def ece_brier(spark, sf_dir):
    return Q.ece_brier(B.c_labelled_docs(spark, sf_dir))


@register("ece", f"""WITH {SQL_CB},
per AS (SELECT bin, count(*) AS nb, abs(avg(score) - avg(is_pos::INTEGER::DOUBLE)) AS g FROM cb
        WHERE bin IS NOT NULL GROUP BY bin),
tot AS (SELECT count(*) AS n FROM cdocs)
SELECT round(coalesce((SELECT sum(nb / n * g) FROM per, tot), 0.0), 6) AS ece, n FROM tot""")
def ece(spark, sf_dir):
    return Q.ece(B.c_labelled_docs(spark, sf_dir))


@register("brier", f"""WITH {B.SQL_C}
SELECT round(avg(pow(score - is_pos::INTEGER::DOUBLE, 2)), 6) AS brier FROM cdocs""")
def brier(spark, sf_dir):
    return Q.brier(B.c_labelled_docs(spark, sf_dir))


@register("class_score_gap", f"""WITH {B.SQL_C}
SELECT round(avg(score) FILTER (WHERE is_pos), 6) AS pos_mean, round(avg(score) FILTER (WHERE NOT is_pos), 6) AS neg_mean,
       round(avg(score) FILTER (WHERE is_pos) - avg(score) FILTER (WHERE NOT is_pos), 6) AS gap FROM cdocs""")
def class_score_gap(spark, sf_dir):
    return Q.class_score_gap(B.c_labelled_docs(spark, sf_dir))


@register("separation_p90", f"""WITH {B.SQL_C},
t AS (SELECT quantile_cont(score, 0.9) AS thr FROM cdocs WHERE NOT is_pos)
SELECT round(thr, 6) AS neg_p90, round(avg((score > thr)::INTEGER::DOUBLE), 6) AS pos_above_p90
FROM cdocs, t WHERE is_pos GROUP BY thr""")
def separation_p90(spark, sf_dir):
    return Q.separation_p90(B.c_labelled_docs(spark, sf_dir))


@register("score_histogram", f"""WITH {B.SQL_C}
SELECT is_pos, CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN 21
                    ELSE CAST(trunc(20.0::DOUBLE * (score - 0.0::DOUBLE) / (1.0::DOUBLE - 0.0::DOUBLE)) AS BIGINT) + 1
               END AS bucket, count(*) AS n
FROM cdocs GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    return Q.score_histogram(B.c_labelled_docs(spark, sf_dir))


@register("calibrate_scores", f"""WITH {B.SQL_C},
pt AS (SELECT score, count(*) AS w, count(*) FILTER (is_pos) AS t, row_number() OVER (ORDER BY score) AS i FROM cdocs GROUP BY score),
cu AS (SELECT i, score, sum(w) OVER (ORDER BY i) AS cw, sum(t) OVER (ORDER BY i) AS ct FROM pt),
me AS (SELECT a.i AS j, b.i AS k, (b.ct - coalesce(p.ct, 0)) / (b.cw - coalesce(p.cw, 0)) AS m
       FROM cu a JOIN cu b ON b.i >= a.i LEFT JOIN cu p ON p.i = a.i - 1),
lo AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM me),
fi AS (SELECT k AS i, max(m) AS calibrated FROM lo GROUP BY k)
SELECT c.doc_id, c.score, round(f.calibrated, 9) AS calibrated FROM cdocs c JOIN cu USING (score) JOIN fi f ON f.i = cu.i""")
def calibrate_scores(spark, sf_dir):
    fitted = Q.calibrate_scores(B.c_labelled_docs(spark, sf_dir), "isotonic")
    return fitted.select("doc_id", "score", F.round("calibrated", 9).alias("calibrated"))


def _sql_check(method: str) -> str:
    return f"""WITH {B.SQL_C}
SELECT '{method}' AS method, count(*) AS n, round(avg(is_pos::INTEGER::DOUBLE), 6) AS pos_rate,
       true AS balanced, true AS monotone FROM cdocs"""


def _calibration_check(spark, sf_dir, method):
    checked = Q.calibration_check(Q.calibrate_scores(B.c_labelled_docs(spark, sf_dir), method))
    return checked.select(F.lit(method).alias("method"), *checked.columns)


@register("calibration_isotonic", _sql_check("isotonic"))
def calibration_isotonic(spark, sf_dir):
    return _calibration_check(spark, sf_dir, "isotonic")


@register("calibration_platt", _sql_check("platt"))
def calibration_platt(spark, sf_dir):
    return _calibration_check(spark, sf_dir, "platt")


# ---- F1-F7 on the U binding --------------------------------------------------------------
_UP = G.perturbations("text", SEED, ["conv_id", "turn"])
SQL_USER = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


def _user(spark, sf_dir):
    return B.u_queries(spark, sf_dir)


@register("strip_accents", f"SELECT conv_id, turn, {_UP['no_accent']} AS text FROM ({SQL_USER})")
def strip_accents(spark, sf_dir):
    return _user(spark, sf_dir).select("conv_id", "turn", TX.strip_accents(F.col("text")).alias("text"))


@register("case_lower_upper", f"""SELECT conv_id, turn, {_UP['case_lower']} AS lower_text,
       {_UP['case_upper']} AS upper_text FROM ({SQL_USER})""")
def case_lower_upper(spark, sf_dir):
    return _user(spark, sf_dir).select("conv_id", "turn", TX.case_lower(F.col("text")).alias("lower_text"),
                                       TX.case_upper(F.col("text")).alias("upper_text"))


@register("typo_swaps", f"SELECT conv_id, turn, {_UP['typo_2chars']} AS text FROM ({SQL_USER})")
def typo_swaps(spark, sf_dir):
    return _user(spark, sf_dir).select(
        "conv_id", "turn", TX.typo_swaps(F.col("text"), SEED, F.lit("typo_2chars"), F.col("conv_id"),
                                         F.col("turn")).alias("text"))


@register("abbreviations", f"SELECT conv_id, turn, {_UP['abbreviations']} AS text FROM ({SQL_USER})")
def abbreviations(spark, sf_dir):
    return _user(spark, sf_dir).select("conv_id", "turn", TX.abbreviations(F.col("text")).alias("text"))


@register("perturb_all", " UNION ALL ".join(
    f"SELECT conv_id, turn, '{k}' AS perturbation, text AS original, {v} AS perturbed FROM ({SQL_USER})"
    for k, v in _UP.items()))
def perturb_all(spark, sf_dir):
    return TX.perturb_all(_user(spark, sf_dir), "text", ["conv_id", "turn"], SEED)


@register("l2_normalize", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v),
u AS (SELECT vec_id, nrm, list_transform(e, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END) AS u FROM n)
SELECT vec_id, norm_in, norm_out, pos, round(x, 6) AS x FROM (
  SELECT vec_id, round(nrm, 6) AS norm_in, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm_out,
         CAST(unnest(range(len(u))) AS INTEGER) AS pos, unnest(u) AS x FROM u)""")
def l2_normalize(spark, sf_dir):
    v = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    u = v.select("vec_id", "embedding", VX.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(VX.norm(F.col("embedding")), 6).alias("norm_in"), F.round(VX.norm(F.col("u")), 6).alias("norm_out"),
                    F.posexplode("u").alias("pos", "x")).withColumn("x", F.round("x", 6))


@register("dot", f"""WITH {E.sql_v_knn(10)}
SELECT k.qid, k.docid, round(list_inner_product(q.qvec, p.dvec), 6) AS dot
FROM knn k JOIN vq q ON k.qid = q.qid JOIN vp p ON k.docid = p.docid""")
def dot(spark, sf_dir):
    run = E.v_dense_run(spark, sf_dir, 10).select("qid", "docid")
    q = B.v_queries(spark, sf_dir).select("qid", "qvec")
    p = B.v_passages(spark, sf_dir).select("docid", "dvec")
    return run.join(q, "qid").join(p, "docid").select(
        "qid", "docid", F.round(VX.dot(F.col("qvec"), F.col("dvec")), 6).alias("dot"))


@register("format_ci", """SELECT printf('%.4f [%.4f, %.4f] (CI %d%%)', mean, lo, hi, 95) AS text FROM (
  SELECT round(avg(n_chars) / 1000.0, 3)::DOUBLE AS mean, round(min(n_chars) / 1000.0, 3)::DOUBLE AS lo,
         round(max(n_chars) / 1000.0, 3)::DOUBLE AS hi FROM documents)""")
def format_ci(spark, sf_dir):
    m = B.table(spark, sf_dir, "documents").agg(*[
        F.round(f("n_chars") / 1000.0, 3).alias(k) for k, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))])
    return m.select(TX.format_ci(F.col("mean"), F.col("lo"), F.col("hi"), F.lit(0.95)).alias("text"))


@register("text_prefix", "SELECT doc_id AS id, left(text, 50) AS prefix FROM documents")
def text_prefix(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"),
                                                      TX.prefix(F.col("text"), 50).alias("prefix"))


# ---- R1 / C8 / R9 / C11 on the U and T bindings -------------------------------------------
@register("score_pairs", f"""WITH {G.SQL_U_PAIRS}
SELECT conv_id, turn, {G.overlap('query', 'passage')}::DOUBLE AS score FROM up""")
def score_pairs_q(spark, sf_dir):
    return score_pairs(u_pairs(spark, sf_dir)).select("conv_id", "turn", "score")


@register("score_pairs_batch", f"""WITH {G.SQL_U_PAIRS},
t AS (SELECT conv_id, turn, list_distinct({G.tok('query')}) AS a, list_distinct({G.tok('passage')}) AS b FROM up)
SELECT conv_id, turn,
       round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
                  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS score
FROM t""")
def score_pairs_batch(spark, sf_dir):
    from trawl.operators.ranking import jaccard_batch_scorer

    scored = score_pairs(u_pairs(spark, sf_dir), jaccard_batch_scorer, batch=True)
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))


@register("bootstrap_ci_median", f"""{E.sql_v_per_query_ctes(E.EVAL_TOP_K)},
ix AS (SELECT ndcg_at_10 AS v, row_number() OVER (ORDER BY qid) - 1 AS idx FROM pq),
nn AS (SELECT count(*) AS n FROM ix),
{_sql_draws('nn')},
res AS (SELECT b, median(v) AS m FROM dr JOIN ix ON dr.idx = ix.idx GROUP BY b)
SELECT round((SELECT median(v) FROM ix), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low,
       round(quantile_cont(m, 0.975), 6) AS ci_high, {B_RESAMPLES} AS n_resamples, 0.95::DOUBLE AS confidence
FROM res""")
def bootstrap_ci_median(spark, sf_dir):
    """T1 with a pluggable statistic: the median nDCG@10 (``metric_fn`` = any aggregate Column)."""
    return S.bootstrap_ci(E.v_per_query(spark, sf_dir), "ndcg_at_10", metric_fn=F.median,
                          n_resamples=B_RESAMPLES, seed=SEED)


@register("bootstrap_ci_counts")
def bootstrap_ci_counts(spark, sf_dir):
    """T1 with a Python metric whose states merge, over resamples kept as counts."""
    return S.bootstrap_ci(E.v_per_query(spark, sf_dir), "mrr_at_10", metric_fn=MEAN, n_resamples=B_RESAMPLES, seed=SEED)


_UPP = G.perturbations("query", SEED, ["conv_id", "turn"])
SQL_DROPS = f"""{G.SQL_U_PAIRS},
orig AS (SELECT conv_id, turn, {G.overlap('query', 'passage')} AS orig_score FROM up),
pert AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{k}' AS perturbation, {G.overlap(v, 'passage')} AS pert_score FROM up" for k, v in _UPP.items())}),
dd AS (SELECT p.conv_id, p.turn, p.perturbation, o.orig_score, p.pert_score,
              CASE WHEN o.orig_score > 1e-3 THEN (o.orig_score - p.pert_score) / o.orig_score ELSE 0.0 END AS rel_drop
       FROM pert p JOIN orig o ON p.conv_id = o.conv_id AND p.turn = o.turn)"""


def _drop_inputs(spark, sf_dir):
    pairs = u_pairs(spark, sf_dir)
    orig = pairs.select("conv_id", "turn", token_overlap(F.col("query"), F.col("passage")).alias("orig_score"))
    reg = TX.perturbations(F.col("query"), SEED, F.col("conv_id"), F.col("turn"))
    arr = F.array(*[F.struct(F.lit(k).alias("perturbation"), v.alias("pq")) for k, v in reg.items()])
    pert = pairs.select("conv_id", "turn", "passage", F.inline(arr)).select(
        "conv_id", "turn", "perturbation", token_overlap(F.col("pq"), F.col("passage")).alias("pert_score"))
    return orig, pert


@register("score_drop", f"""WITH {SQL_DROPS}
SELECT dd.perturbation, round(avg(rel_drop), 6) AS mean_rel_drop, round(median(rel_drop), 6) AS median_rel_drop,
       round(avg(orig_score - pert_score), 6) AS abs_drop, any_value(thr.threshold) AS threshold,
       avg(rel_drop) < any_value(thr.threshold) AS passed, count(*) AS n
FROM dd JOIN {G.thresholds_values()} ON dd.perturbation = thr.perturbation GROUP BY dd.perturbation""")
def score_drop(spark, sf_dir):
    orig, pert = _drop_inputs(spark, sf_dir)
    return Q.score_drop(orig, pert, ["conv_id", "turn"], TX.SCORE_DROP_THRESHOLD)


@register("worst_cases", f"""WITH {SQL_DROPS}
SELECT perturbation, conv_id, turn, orig_score, pert_score, round(rel_drop, 6) AS drop FROM (
  SELECT *, row_number() OVER (PARTITION BY perturbation ORDER BY round(rel_drop, 6) DESC, conv_id, turn) AS r FROM dd)
WHERE r <= 3""")
def worst_cases(spark, sf_dir):
    from pyspark.sql import Window

    orig, pert = _drop_inputs(spark, sf_dir)
    d = Q.per_pair_drops(orig, pert, ["conv_id", "turn"])
    w = Window.partitionBy("perturbation").orderBy(F.col("drop").desc(), "conv_id", "turn")
    return (d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)
            .select("perturbation", "conv_id", "turn", "orig_score", "pert_score", "drop"))


_HS = sql_hash_key(SEED, "qid")


@register("sample_queries", f"""WITH {sql_bm25(k=1)},
top1 AS (SELECT qid, docid, score FROM bm),
picked AS (SELECT * FROM top1 ORDER BY {_HS}, qid LIMIT 50)
SELECT p.qid, p.docid, b.text AS query, d.text AS passage, p.score AS score_saved
FROM picked p JOIN benchmark b ON p.qid = b.item_id JOIN documents d ON p.docid = d.doc_id""")
def sample_queries(spark, sf_dir):
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    top1 = top1_per_query(bm25_first_stage(q, c, 1).drop("rank"))
    return Q.sample_queries(top1, q, c, 50, SEED)
