"""Registered mining, join and triple queries.

V mining: candidates = exact kNN top 200; positives = the id-triples source (nearest
same-label neighbour per query); collection = all vectors.
T mining: candidates = BM25 top 200; positives = graded qrels text with rel > 0
(includes judged ids that are not in the collection); collection = documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions.hashing import sql_hash_key
from trawl.operators import joins as J
from trawl.operators import metrics as M
from trawl.operators import mining as MN
from trawl.operators import triples as TR
from trawl.operators.knn import rank_topk
from trawl.operators.lexical import bm25_first_stage
from trawl.operators.ranking import overlap_rerank
from trawl.operators.resume import run_in_buckets
from trawl.operators.util import written
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.plans import fixtures as X
from trawl.plans.q_sources import SQL_BM25
from trawl.plans.registry import register
from trawl.session import scratch_dir
from trawl.sources import textformats as TF

CFG = MN.MiningConfig(top_k=200, num_negatives=7, rank_min=10, rank_max=100, seed=42)
MIX_RATIO = 0.3
MAX_TRIPLES = 50

# ---- Spark inputs ---------------------------------------------------------------------


def v_inputs(spark, sf_dir):
    """Candidates, positives and collection; the run and the positives are computed once and written."""
    lab = written(E.v_labelled_run(spark, sf_dir, CFG.top_k).select("qid", "docid", "score", "rank", "is_pos"), "labelled-run")
    trip = X.v_id_triples(spark, sf_dir, lab=lab)
    pos = MN.positives_by_query(triples=trip.select(F.col("qid").alias("query_id"), F.col("pos").alias("positive_id")))
    coll = B.v_passages(spark, sf_dir).select("docid")
    return lab.select("qid", "docid", "score", "rank"), written(pos, "positives"), coll


def t_graded(spark, sf_dir, qrels=None):
    return TF.scan_qrels_graded(spark, X.write_qrels_text(spark, sf_dir, qrels))


def t_run(spark, sf_dir, k=1000):
    """BM25 run of the T binding, materialised once for queries that read it several times."""
    return bm25_first_stage(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), k).checkpoint(eager=True)


def t_inputs(spark, sf_dir, run=None, qrels=None):
    cands = (run.where(F.col("rank") <= CFG.top_k) if run is not None
             else bm25_first_stage(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), CFG.top_k))
    pos = MN.positives_by_query(qrels=TR.filter_relevant(t_graded(spark, sf_dir, qrels)))
    coll = B.t_collection(spark, sf_dir).select(F.col("id").alias("docid"))
    return cands, pos, coll


def v_mined(spark, sf_dir):
    cands, pos, coll = v_inputs(spark, sf_dir)
    return MN.mine_hard_negatives(cands, pos, coll, CFG)


def t_mined(spark, sf_dir, run=None, qrels=None):
    cands, pos, coll = t_inputs(spark, sf_dir, run, qrels)
    return MN.mine_hard_negatives(cands, pos, coll, CFG)


def t_official(spark, sf_dir, run=None, qrels=None):
    """Official-style T id triples: each judged pair with the query's best BM25 non-positive,
    plus one row per item whose positive id is unknown (dropped when resolving)."""
    run = run if run is not None else bm25_first_stage(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), 1000)
    q = (X.t_qrels(spark, sf_dir) if qrels is None else qrels).select("qid", "docid")
    negs = (MN.exclude_positives(run, q).groupBy("qid")
            .agg(F.min_by("docid", "rank").alias("negative_id")))
    known = q.join(negs, "qid").select(F.col("qid").alias("query_id"), F.col("docid").alias("positive_id"),
                                       "negative_id")
    unknown = negs.select(F.col("qid").alias("query_id"), (F.col("qid") + X.OFFSET).alias("positive_id"),
                          "negative_id")
    return known.unionByName(unknown)


def t_sources(spark, sf_dir):
    """Official and mined T triples from one run and one table of judgments."""
    run, qrels = t_run(spark, sf_dir), X.t_qrels(spark, sf_dir)
    return t_official(spark, sf_dir, run, qrels), TR.explode_mined(t_mined(spark, sf_dir, run, qrels))


def t_mixed(spark, sf_dir):
    official, mined = t_sources(spark, sf_dir)
    return TR.mix_sources(official, mined, MIX_RATIO,
                          official_order=F.struct("query_id", "positive_id"),
                          mined_order=F.struct("query_id", "positive_id", "neg_pos"))


def t_built(spark, sf_dir, cap=None):
    official, mined = t_sources(spark, sf_dir)
    return TR.build_triples(official, mined, B.t_queries(spark, sf_dir),
                            B.t_collection(spark, sf_dir), ratio_official=MIX_RATIO, max_triples=cap,
                            official_order=F.struct("query_id", "positive_id"),
                            mined_order=F.struct("query_id", "positive_id", "neg_pos"))


# ---- SQL pieces -------------------------------------------------------------------------
SQL_V_IN = f"""{E.sql_v_knn(CFG.top_k)}, {E.SQL_V_LABELLED}, {X.SQL_V_TRIPLES},
cands AS (SELECT qid, docid, score, rank FROM knn),
pos AS (SELECT DISTINCT qid, pos AS docid FROM vt),
coll AS (SELECT docid FROM vp)"""

SQL_T_GRADED = f"""{X.SQL_T_QRELS},
tg AS (SELECT qid, docid, rel FROM tq
       UNION ALL SELECT item_id, item_id + {X.OFFSET}, 2 FROM benchmark
       UNION ALL SELECT item_id, item_id + 2 * {X.OFFSET}, 0 FROM benchmark)"""

SQL_T_IN = f"""{SQL_BM25}, {SQL_T_GRADED},
cands AS (SELECT qid, docid, score, rank FROM bm WHERE rank <= {CFG.top_k}),
pos AS (SELECT DISTINCT qid, docid FROM tg WHERE rel > 0),
coll AS (SELECT doc_id AS docid FROM documents)"""

SQL_POOL_ONLY = """pool AS (SELECT c.qid, c.docid, c.rank, c.score FROM cands c
         WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.qid = c.qid AND p.docid = c.docid))"""

SQL_POOL = SQL_POOL_ONLY + """,
win AS (SELECT qid, docid, pool_rank, score FROM (
          SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY rank, docid) - 1 AS pool_rank
          FROM pool) WHERE pool_rank >= {rmin} AND pool_rank < {rmax})""".format(rmin=CFG.rank_min, rmax=CFG.rank_max)

_H = sql_hash_key(CFG.seed, "qid", "docid")

SQL_MINE = f"""present AS (SELECT qid, docid FROM pos WHERE docid IN (SELECT docid FROM coll)),
mpool AS (SELECT c.qid, c.docid, c.rank FROM cands c
          WHERE c.qid IN (SELECT qid FROM present)
            AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.qid = c.qid AND p.docid = c.docid)),
mwin AS (SELECT qid, docid FROM (
           SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY rank, docid) - 1 AS pool_rank FROM mpool)
         WHERE pool_rank >= {CFG.rank_min} AND pool_rank < {CFG.rank_max}),
samp AS (SELECT qid, docid FROM (
           SELECT qid, docid, count(*) OVER (PARTITION BY qid) AS n,
                  row_number() OVER (PARTITION BY qid ORDER BY {_H}, docid) AS s FROM mwin)
         WHERE n >= {CFG.num_negatives} AND s <= {CFG.num_negatives}),
negs AS (SELECT qid, list_sort(list(docid)) AS negative_ids FROM samp GROUP BY qid),
mined AS (SELECT p.qid AS query_id, p.docid AS positive_id, n.negative_ids FROM present p JOIN negs n ON p.qid = n.qid)"""

SQL_EXPLODED = """ex AS (SELECT query_id, positive_id, CAST(unnest(range(len(negative_ids))) AS INTEGER) AS neg_pos,
                unnest(negative_ids) AS negative_id FROM mined)"""

SQL_T_OFFICIAL = f"""ofneg AS (SELECT b.qid, min_by(b.docid, b.rank) AS negative_id FROM bm b
          WHERE NOT EXISTS (SELECT 1 FROM tq WHERE tq.qid = b.qid AND tq.docid = b.docid) GROUP BY b.qid),
official AS (SELECT tq.qid AS query_id, tq.docid AS positive_id, o.negative_id FROM tq JOIN ofneg o ON tq.qid = o.qid
             UNION ALL SELECT qid, qid + {X.OFFSET}, negative_id FROM ofneg)"""

SQL_MIX = f"""mix AS (
  SELECT 'official' AS source, query_id, positive_id, negative_id,
         (row_number() OVER (ORDER BY query_id, positive_id) - 1 + 0.5)::DOUBLE / {MIX_RATIO}::DOUBLE AS mix_key
  FROM official
  UNION ALL
  SELECT 'mined' AS source, query_id, positive_id, negative_id,
         (row_number() OVER (ORDER BY query_id, positive_id, neg_pos) - 1 + 0.5)::DOUBLE / {1.0 - MIX_RATIO}::DOUBLE
  FROM ex)"""

SQL_RESOLVED = """resolved AS (SELECT m.query_id, q.text AS query_text, p.text AS positive_text, n.text AS negative_text,
                     m.source, m.mix_key
              FROM mix m JOIN benchmark q ON m.query_id = q.item_id
                   JOIN documents p ON m.positive_id = p.doc_id JOIN documents n ON m.negative_id = n.doc_id)"""

SQL_BUILT = "built AS (SELECT * FROM resolved)"
SQL_CAPPED = f"built AS (SELECT * FROM resolved ORDER BY mix_key, source LIMIT {MAX_TRIPLES})"

SQL_T_ALL = f"WITH {SQL_T_IN}, {SQL_MINE}, {SQL_EXPLODED}, {SQL_T_OFFICIAL}, {SQL_MIX}"


# ---- M1 / J5 / J6 / M2 / M3 / M4 / M5 ------------------------------------------------
@register("positives_by_query", f"""WITH {X.SQL_T_QRELS}
SELECT qid, list_sort(list(DISTINCT docid)) AS positives FROM (
  SELECT qid, docid FROM tq UNION ALL SELECT item_id, item_id + 2 * {X.OFFSET} FROM benchmark) GROUP BY qid""")
def positives_by_query(spark, sf_dir):
    pos = MN.positives_by_query(qrels=TF.scan_qrels_positive(spark, X.write_qrels_text(spark, sf_dir)))
    return MN.positive_sets(pos)


@register("positives_from_triples", f"""WITH {E.sql_v_knn(100)}, {E.SQL_V_LABELLED}, {X.SQL_V_TRIPLES}
SELECT qid, [pos] AS positives FROM vt""")
def positives_from_triples(spark, sf_dir):
    trip = TF.scan_id_triples(spark, X.write_triples_text(spark, sf_dir))
    return MN.positive_sets(MN.positives_by_query(triples=trip))


@register("exclude_positives", f"""WITH {SQL_V_IN}, {SQL_POOL}
SELECT qid, docid, rank FROM pool""")
def exclude_positives(spark, sf_dir):
    cands, pos, _ = v_inputs(spark, sf_dir)
    return MN.exclude_positives(cands.select("qid", "docid", "rank"), pos)


@register("positives_in_collection", f"""WITH {SQL_T_GRADED}
SELECT DISTINCT qid, docid FROM tg WHERE rel > 0 AND docid IN (SELECT doc_id FROM documents)""")
def positives_in_collection(spark, sf_dir):
    pos = MN.positives_by_query(qrels=TR.filter_relevant(t_graded(spark, sf_dir)))
    return MN.positives_in_collection(pos, B.t_collection(spark, sf_dir).select(F.col("id").alias("docid")))


@register("rank_window", f"""WITH {SQL_V_IN}, {SQL_POOL}
SELECT qid, docid, pool_rank FROM win""")
def rank_window(spark, sf_dir):
    cands, pos, _ = v_inputs(spark, sf_dir)
    pool = MN.exclude_positives(cands.select("qid", "docid", "rank"), pos)
    return MN.rank_window(pool, CFG.rank_min, CFG.rank_max).select("qid", "docid", "pool_rank")


@register("sample_negatives", f"""WITH {SQL_V_IN}, {SQL_POOL}
SELECT qid, docid FROM (SELECT qid, docid, count(*) OVER (PARTITION BY qid) AS n,
                               row_number() OVER (PARTITION BY qid ORDER BY {_H}, docid) AS s FROM win)
WHERE n >= {CFG.num_negatives} AND s <= {CFG.num_negatives}""")
def sample_negatives(spark, sf_dir):
    cands, pos, _ = v_inputs(spark, sf_dir)
    win = MN.rank_window(MN.exclude_positives(cands.select("qid", "docid", "rank"), pos), CFG.rank_min, CFG.rank_max)
    return MN.sample_negatives(win, CFG.num_negatives, CFG.seed).select("qid", "docid")


@register("mine_hard_negatives", f"""WITH {SQL_V_IN}, {SQL_MINE}
SELECT query_id, positive_id, negative_ids FROM mined""")
def mine_hard_negatives(spark, sf_dir):
    return v_mined(spark, sf_dir)


@register("mine_hard_negatives_bm25", f"""WITH {SQL_T_IN}, {SQL_MINE}
SELECT query_id, positive_id, negative_ids FROM mined""")
def mine_hard_negatives_bm25(spark, sf_dir):
    return t_mined(spark, sf_dir)


@register("mining_skip_report", f"""WITH {SQL_T_IN}, {SQL_POOL},
wsize AS (SELECT qid, count(*) AS w FROM win GROUP BY qid),
flags AS (SELECT b.item_id AS qid,
                 b.item_id NOT IN (SELECT qid FROM pos) AS no_qrel,
                 b.item_id IN (SELECT qid FROM pos) AND b.item_id NOT IN
                   (SELECT qid FROM pos WHERE docid IN (SELECT docid FROM coll)) AS off,
                 coalesce(ws.w, 0) AS w
          FROM benchmark b LEFT JOIN wsize ws ON b.item_id = ws.qid)
SELECT count(*) FILTER (WHERE no_qrel) AS skipped_no_qrel,
       count(*) FILTER (WHERE off) AS skipped_positive_not_in_collection,
       count(*) FILTER (WHERE NOT no_qrel AND NOT off AND w < {CFG.num_negatives}) AS skipped_insufficient_pool,
       count(*) FILTER (WHERE NOT no_qrel AND NOT off AND w >= {CFG.num_negatives}) AS mined_queries
FROM flags""")
def mining_skip_report(spark, sf_dir):
    cands, pos, coll = t_inputs(spark, sf_dir)
    queries = B.t_queries(spark, sf_dir).select(F.col("id").alias("qid"))
    return MN.mining_skip_report(queries, cands, pos, coll, CFG)


@register("write_mined", f"""WITH {SQL_T_IN}, {SQL_MINE},
skips AS (SELECT b.item_id AS qid, b.item_id NOT IN (SELECT qid FROM pos) AS no_qrel,
                 b.item_id IN (SELECT qid FROM pos) AND b.item_id NOT IN (SELECT qid FROM present) AS off,
                 b.item_id IN (SELECT query_id FROM mined) AS done FROM benchmark b)
SELECT (SELECT count(*) FROM mined) AS rows, count(*) FILTER (done) AS mined_queries,
       count(*) FILTER (no_qrel) AS skipped_no_qrel, count(*) FILTER (off) AS skipped_positive_not_in_collection,
       count(*) FILTER (NOT no_qrel AND NOT off AND NOT done) AS skipped_insufficient_pool,
       (SELECT coalesce(sum(len(negative_ids)), 0)::BIGINT FROM mined) AS negatives FROM skips""")
def write_mined(spark, sf_dir):
    """M4 written with its report (M5) counted by the writing job; ``negatives`` is read back."""
    cands, pos, coll = t_inputs(spark, sf_dir)
    path = scratch_dir(spark, "mined")
    found = MN.write_mined(B.t_queries(spark, sf_dir).select(F.col("id").alias("qid")), cands, pos, coll, path, CFG)
    negatives = spark.read.parquet(path).agg(F.coalesce(F.sum(F.size("negative_ids").cast("long")), F.lit(0).cast("long")).alias("negatives"))
    return negatives.select(*(F.lit(v).cast("long").alias(k) for k, v in found.items()), "negatives")


@register("scan_mined_explode", f"""WITH {SQL_V_IN}, {SQL_MINE}, {SQL_EXPLODED}
SELECT query_id, positive_id, neg_pos, negative_id FROM ex""")
def scan_mined_explode(spark, sf_dir):
    return TR.explode_mined(v_mined(spark, sf_dir))


_HQ = sql_hash_key(CFG.seed, "b.item_id")


@register("synthetic_qrels", f"""WITH head AS (
  SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS pos
  FROM (SELECT doc_id AS docid FROM documents ORDER BY doc_id LIMIT 1000))
SELECT b.item_id AS qid, h.docid, 1 AS rel FROM benchmark b
JOIN head h ON h.pos = {_HQ} % (SELECT count(*) FROM head)""")
def synthetic_qrels(spark, sf_dir):
    q = B.t_queries(spark, sf_dir).select(F.col("id").alias("qid"))
    c = B.t_collection(spark, sf_dir).select(F.col("id").alias("docid"))
    return MN.synthetic_qrels(q, c, seed=CFG.seed)


@register("score_gap_filter", f"""WITH {SQL_V_IN}, {SQL_MINE}, {SQL_EXPLODED}
SELECT e.query_id, e.positive_id, list_sort(list(e.negative_id)) AS negative_ids
FROM ex e LEFT JOIN cands c ON c.qid = e.query_id AND c.docid = e.negative_id
WHERE coalesce(c.score, 0.0) <= 0.3 GROUP BY e.query_id, e.positive_id""")
def score_gap_filter(spark, sf_dir):
    cands, pos, coll = v_inputs(spark, sf_dir)
    mined = MN.mine_hard_negatives(cands, pos, coll, CFG)
    return MN.score_gap_filter(mined, cands, 0.3)


@register("mid_band_negatives", f"""WITH {SQL_V_IN}, {SQL_POOL_ONLY},
band AS (SELECT qid, docid FROM pool WHERE score BETWEEN 0.1 AND 0.3),
bs AS (SELECT qid, docid FROM (SELECT qid, docid, count(*) OVER (PARTITION BY qid) AS n,
                                      row_number() OVER (PARTITION BY qid ORDER BY {_H}, docid) AS s FROM band)
       WHERE n >= 7 AND s <= 7)
SELECT qid, list_sort(list(docid)) AS negative_ids FROM bs GROUP BY qid""")
def mid_band_negatives(spark, sf_dir):
    cands, pos, _ = v_inputs(spark, sf_dir)
    return MN.mid_band_negatives(cands, pos, 0.1, 0.3, 7, CFG.seed)


# ---- J1 / J2 / J3 / J7 / J8 / J11 / J12 / J13 ------------------------------------------
@register("eval_query_set", f"""WITH {X.SQL_T_QRELS}
SELECT item_id AS id, text FROM benchmark WHERE item_id IN (SELECT qid FROM tq)""")
def eval_query_set(spark, sf_dir):
    return J.eval_query_set(B.t_queries(spark, sf_dir), X.t_qrels(spark, sf_dir))


@register("needed_passages", f"""WITH {SQL_BM25}
SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT docid FROM bm WHERE rank <= 10)""")
def needed_passages(spark, sf_dir):
    run = bm25_first_stage(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), 10)
    return J.needed_passages(B.t_collection(spark, sf_dir), run)


@register("candidate_pairs", f"""WITH {SQL_T_GRADED},
g AS (SELECT qid, docid FROM tg)
SELECT g.qid, g.docid, b.text AS query, coalesce(d.text, '') AS passage
FROM g JOIN benchmark b ON g.qid = b.item_id LEFT JOIN documents d ON g.docid = d.doc_id""")
def candidate_pairs(spark, sf_dir):
    cands = t_graded(spark, sf_dir).select("qid", "docid")
    return J.candidate_pairs(cands, B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir))


@register("label_pairs", f"""WITH {SQL_BM25}, {X.SQL_T_QRELS}
SELECT b.qid, b.docid, b.score, b.rank, coalesce(CAST(t.rel AS DOUBLE), 0.0) AS gain,
       coalesce(t.rel, 0) > 0 AS is_pos
FROM bm b LEFT JOIN tq t ON b.qid = t.qid AND b.docid = t.docid WHERE b.rank <= 100""")
def label_pairs(spark, sf_dir):
    run = bm25_first_stage(B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), 100)
    return M.label_pairs(run, X.t_qrels(spark, sf_dir))


@register("resume_remaining", f"""WITH {SQL_V_IN}, {SQL_MINE}
SELECT query_id, positive_id, negative_ids FROM mined""")
def resume_remaining(spark, sf_dir):
    cands, pos, coll = v_inputs(spark, sf_dir)
    labels = B.v_queries(spark, sf_dir).select("qid", "qlabel")
    # a prior, interrupted run finished the queries of labels 0-4 and wrote them out
    done_q = labels.where(F.col("qlabel") < 5).select("qid")
    prior_path = scratch_dir(spark, "mined-prior")
    (MN.mine_hard_negatives(cands.join(done_q, "qid", "left_semi"), pos, coll, CFG)
     .write.mode("overwrite").parquet(prior_path))
    prior = spark.read.parquet(prior_path)

    def compute(remaining):
        return MN.mine_hard_negatives(cands.join(remaining, "qid", "left_semi"), pos, coll, CFG)

    return J.resume_remaining(prior, labels.select("qid"), compute)


@register("mine_in_buckets", f"""WITH {SQL_V_IN}, {SQL_MINE}
SELECT query_id, positive_id, negative_ids FROM mined""")
def mine_in_buckets(spark, sf_dir):
    """Mining flushed by query bucket; the first run is cut off, the second goes on."""
    cands, pos, coll = v_inputs(spark, sf_dir)
    path = scratch_dir(spark, "mined-buckets")
    queries = written(cands.select("qid").distinct(), "queries")

    def mined(todo):
        return MN.mine_hard_negatives(cands.join(todo, "qid", "left_semi"), pos, coll, CFG)

    flushed = []

    def cut_off(todo):
        if len(flushed) == 2:
            raise InterruptedError("the driver went away")
        flushed.append(todo)
        return mined(todo)

    try:
        run_in_buckets(queries, cut_off, path, buckets=4)
    except InterruptedError:
        pass
    return run_in_buckets(queries, mined, path, buckets=4)


_HR = sql_hash_key(CFG.seed, "qid", "docid")


def two_stage_sql_pair() -> str:
    """SQL of the two V systems' per-query MRR@10: CTE ``pr(qid, a, b)``."""
    return f"""WITH {E.sql_v_knn(100)}, {E.SQL_V_LABELLED},
ra AS (SELECT qid, coalesce(1.0 / min(CASE WHEN is_pos AND rank <= 10 THEN rank END), 0.0)::DOUBLE AS m
       FROM lab GROUP BY qid),
rb0 AS (SELECT qid, is_pos, row_number() OVER (PARTITION BY qid ORDER BY {_HR} DESC, docid) AS r FROM lab),
rb AS (SELECT qid, coalesce(1.0 / min(CASE WHEN is_pos AND r <= 10 THEN r END), 0.0)::DOUBLE AS m
       FROM rb0 GROUP BY qid),
pr AS (SELECT ra.qid, round(ra.m, 6) AS a, round(rb.m, 6) AS b FROM ra JOIN rb ON ra.qid = rb.qid)"""


@register("pair_systems", two_stage_sql_pair() + "\nSELECT qid, a, b FROM pr")
def pair_systems(spark, sf_dir):
    a, b = two_systems(spark, sf_dir)
    return J.pair_systems(a, b, "mrr_at_10")


def two_systems(spark, sf_dir):
    """Per-query MRR@10 of dense ranking (A) and of the same top-100 reranked by an md5 key (B)."""
    from trawl.functions.hashing import hash_key

    lab = written(E.v_labelled_run(spark, sf_dir, 100).select("qid", "docid", "rank", "is_pos", "gain"), "labelled-run")
    a = M.mrr_at_k(lab, 10)
    rnd = lab.withColumn("score", hash_key(CFG.seed, F.col("qid"), F.col("docid"))).drop("rank")
    b = M.mrr_at_k(rank_topk(rnd, None), 10)
    return written(a, "system"), written(b, "system")


@register("qrels_coverage", f"""WITH {X.SQL_T_QRELS}
SELECT count(DISTINCT qid) AS queries_with_qrels, count(*) AS judged_pairs, count(DISTINCT docid) AS judged_docs
FROM tq WHERE qid IN (SELECT item_id FROM benchmark)""")
def qrels_coverage(spark, sf_dir):
    return J.qrels_coverage(B.t_queries(spark, sf_dir), X.t_qrels(spark, sf_dir))


@register("split_overlap", r"""WITH k AS (SELECT source, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_key
           FROM documents),
tr AS (SELECT text_key, count(*) AS n_train FROM k WHERE source < 'src5' GROUP BY text_key),
ev AS (SELECT text_key, count(*) AS n_eval FROM k WHERE source >= 'src5' GROUP BY text_key)
SELECT tr.text_key, n_train, n_eval FROM tr JOIN ev ON tr.text_key = ev.text_key""")
def split_overlap(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("source", "text")
    return J.split_overlap(docs.where(F.col("source") < "src5"), docs.where(F.col("source") >= "src5"))


@register("split_id_overlap", """SELECT a.conv_id, a.n_train, b.n_eval
FROM (SELECT conv_id, count(*) AS n_train FROM conversations WHERE role = 'user' GROUP BY conv_id) a
JOIN (SELECT conv_id, count(*) AS n_eval FROM conversations WHERE role <> 'user' GROUP BY conv_id) b USING (conv_id)""")
def split_id_overlap(spark, sf_dir):
    turns = B.table(spark, sf_dir, "conversations", ["conv_id", "role"])
    return J.split_id_overlap(turns.where(F.col("role") == "user"), turns.where(F.col("role") != "user"), "conv_id")


# ---- M6 / M7 / J4 / P1-P4 --------------------------------------------------------------
@register("mix_sources", f"""{SQL_T_ALL}
SELECT source, query_id, positive_id, negative_id, mix_key FROM mix""")
def mix_sources(spark, sf_dir):
    return t_mixed(spark, sf_dir)


@register("resolve_triples", f"""{SQL_T_ALL}, {SQL_RESOLVED}
SELECT query_id, query_text, positive_text, negative_text, source FROM resolved""")
def resolve_triples(spark, sf_dir):
    r = TR.resolve_triples(t_mixed(spark, sf_dir), B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir))
    return r.select("query_id", "query_text", "positive_text", "negative_text", "source")


@register("resolve_drop_count", f"""{SQL_T_ALL}, {SQL_RESOLVED}
SELECT (SELECT count(*) FROM mix) AS total, (SELECT count(*) FROM resolved) AS kept,
       (SELECT count(*) FROM mix) - (SELECT count(*) FROM resolved) AS dropped_unknown_ids""")
def resolve_drop_count(spark, sf_dir):
    return TR.resolve_drop_count(t_mixed(spark, sf_dir), B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir))


@register("build_triples", f"""{SQL_T_ALL}, {SQL_RESOLVED}, {SQL_BUILT}
SELECT query_id, query_text, positive_text, negative_text, source, mix_key FROM built""")
def build_triples(spark, sf_dir):
    return t_built(spark, sf_dir)


@register("write_triples", f"""{SQL_T_ALL}, {SQL_RESOLVED},
half AS (SELECT * FROM resolved QUALIFY row_number() OVER (ORDER BY mix_key, source) <= (SELECT count(*) // 2 FROM mix))
SELECT h.*, (SELECT count(*) FROM mix) AS total, (SELECT count(*) FROM mix) - (SELECT count(*) FROM resolved) AS dropped_unknown_ids
FROM half h""")
def write_triples(spark, sf_dir):
    """M7 written under a cap of half the mixed triples, with the counts of the writing jobs."""
    official, mined = (x.checkpoint(eager=True) for x in t_sources(spark, sf_dir))
    path = scratch_dir(spark, "triples-table")
    found = TR.write_triples(official, mined, B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir), path,
                             ratio_official=MIX_RATIO, max_triples=(official.count() + mined.count()) // 2,
                             official_order=F.struct("query_id", "positive_id"),
                             mined_order=F.struct("query_id", "positive_id", "neg_pos"))
    return spark.read.parquet(path).select(
        "query_id", "query_text", "positive_text", "negative_text", "source", "mix_key",
        F.lit(found["total"]).cast("long").alias("total"), F.lit(found["dropped_unknown_ids"]).cast("long").alias("dropped_unknown_ids"))


@register("build_triples_capped", f"""{SQL_T_ALL}, {SQL_RESOLVED}, {SQL_CAPPED}
SELECT query_id, query_text, positive_text, negative_text, source, mix_key FROM built""")
def build_triples_capped(spark, sf_dir):
    return t_built(spark, sf_dir, cap=MAX_TRIPLES)


@register("triples_to_pairs", f"""{SQL_T_ALL}, {SQL_RESOLVED}, {SQL_BUILT}
SELECT query_text AS sentence_A, positive_text AS sentence_B, CAST(1.0 AS FLOAT) AS label FROM built
UNION ALL
SELECT query_text AS sentence_A, negative_text AS sentence_B, CAST(0.0 AS FLOAT) AS label FROM built""")
def triples_to_pairs(spark, sf_dir):
    return TR.triples_to_pairs(t_built(spark, sf_dir))


@register("triples_to_triplets", f"""{SQL_T_ALL}, {SQL_RESOLVED}, {SQL_BUILT}
SELECT query_text AS query, positive_text AS positive, negative_text AS negative FROM built""")
def triples_to_triplets(spark, sf_dir):
    return TR.triples_to_triplets(t_built(spark, sf_dir))


@register("cap_rows", f"""WITH {X.SQL_T_QRELS}
SELECT item_id AS id, text FROM benchmark WHERE item_id IN (SELECT qid FROM tq) ORDER BY item_id LIMIT 10""")
def cap_rows(spark, sf_dir):
    return TR.cap_rows(J.eval_query_set(B.t_queries(spark, sf_dir), X.t_qrels(spark, sf_dir)), 10, id_col="id")


@register("filter_relevant", f"""WITH {SQL_T_GRADED}
SELECT qid, docid, rel FROM tg WHERE rel > 0""")
def filter_relevant(spark, sf_dir):
    return TR.filter_relevant(t_graded(spark, sf_dir))


@register("dual_agree_negatives", f"""WITH {SQL_BM25}, {X.SQL_T_QRELS},
top AS (SELECT qid, docid, rank FROM bm WHERE rank <= 100),
ov AS (SELECT t.qid, t.docid,
              round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '([\\p{{L}}\\p{{N}}]+)', 1)),
                                       list_distinct(regexp_extract_all(lower(d.text), '([\\p{{L}}\\p{{N}}]+)', 1))))
                    / len(list_distinct(regexp_extract_all(lower(b.text), '([\\p{{L}}\\p{{N}}]+)', 1))), 6) AS score
       FROM top t JOIN benchmark b ON t.qid = b.item_id JOIN documents d ON t.docid = d.doc_id),
ovr AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank_b FROM ov)
SELECT t.qid, t.docid, t.rank AS rank_a, o.rank_b FROM top t JOIN ovr o ON t.qid = o.qid AND t.docid = o.docid
WHERE t.rank <= 30 AND o.rank_b <= 30
  AND NOT EXISTS (SELECT 1 FROM tq WHERE tq.qid = t.qid AND tq.docid = t.docid)""")
def dual_agree_negatives(spark, sf_dir):
    q, c = B.t_queries(spark, sf_dir), B.t_collection(spark, sf_dir)
    run = bm25_first_stage(q, c, 100)
    b = overlap_rerank(run, q, c)
    return MN.dual_agree_negatives(run.where(F.col("rank") <= 30), b.where(F.col("rank") <= 30),
                                   X.t_qrels(spark, sf_dir))
