"""Hard-negative mining as DataFrame composition.

candidates (qid, docid, score, rank) from any first stage (dense kNN or BM25)
  -> left_anti known positives (J5)
  -> 0-based pool rank, keep [rank_min, rank_max) (M2)
  -> seeded sample of N per query; windows with fewer than N skip the query (M3)
  -> one row per positive present in the collection (J6), same negatives (M4).

Every per-query step is a window or aggregate keyed by qid over at most ``top_k``
candidates per query, so no step gathers more than one query's pool in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.hashing import hash_key
from trawl.sources.sinks import sink_counted


@dataclass(frozen=True)
class MiningConfig:
    top_k: int = 200
    num_negatives: int = 7
    rank_min: int = 10
    rank_max: int = 100
    seed: int = 42

    def __post_init__(self) -> None:
        window = range(self.rank_min, self.rank_max)
        problems = {
            "the rank window starts below 0": self.rank_min < 0,
            "the rank window is empty": not window,
            "the rank window ends beyond the candidates": self.rank_max > self.top_k,
            "the rank window holds fewer ranks than negatives are asked for": self.num_negatives > len(window),
        }
        if any(problems.values()):
            raise ValueError("; ".join(p for p, found in problems.items() if found) + f" in {self}")


def positives_by_query(qrels: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """M1: ``qid, docid`` positives from qrels (``qid, docid``) or triples
    (``query_id, positive_id``) — exactly one source."""
    if (qrels is None) == (triples is None):
        raise ValueError("give exactly one positives source: qrels or triples")
    if qrels is not None:
        return qrels.select("qid", "docid").distinct()
    return triples.select(F.col("query_id").alias("qid"), F.col("positive_id").alias("docid")).distinct()


def positive_sets(positives: DataFrame) -> DataFrame:
    """M1 as sets: ``qid, positives array<long>`` (sorted)."""
    return positives.groupBy("qid").agg(F.array_sort(F.collect_set("docid")).alias("positives"))


def exclude_positives(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Drop every known positive of the query (even one outside the collection)."""
    return candidates.join(positives.select("qid", "docid"), ["qid", "docid"], "left_anti")


def positives_in_collection(positives: DataFrame, collection_ids: DataFrame) -> DataFrame:
    """Positives whose passage exists in the collection (``docid``)."""
    return positives.join(collection_ids.select("docid").distinct(), "docid", "left_semi")


def rank_window(pool: DataFrame, rank_min: int, rank_max: int) -> DataFrame:
    """M2: 0-based ``pool_rank`` by original rank; keep ``[rank_min, rank_max)``."""
    w = Window.partitionBy("qid").orderBy("rank", "docid")
    ranked = pool.withColumn("pool_rank", (F.row_number().over(w) - 1).cast("long"))
    return ranked.where((F.col("pool_rank") >= rank_min) & (F.col("pool_rank") < rank_max))


def sample_negatives(window: DataFrame, n: int, seed: int) -> DataFrame:
    """M3: ``n`` per query without replacement, ordered by a seeded md5 key; queries whose
    window holds fewer than ``n`` rows are dropped."""
    key = hash_key(seed, F.col("qid"), F.col("docid"))
    w = Window.partitionBy("qid").orderBy(key, F.col("docid"))
    size = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    s = window.withColumn("_n", size).withColumn("_s", F.row_number().over(w))
    return s.where((F.col("_n") >= n) & (F.col("_s") <= n)).drop("_n", "_s")


def _pool(candidates: DataFrame, positives: DataFrame, present: DataFrame, top_k: int) -> DataFrame:
    """Candidates without positives, of the queries that may emit rows only. These are picked after
    the positives are gone: so rows are dealt by query once, for this and for the windows that follow."""
    return (exclude_positives(candidates.where(F.col("rank") <= top_k), positives)
            .join(present.select("qid").distinct(), "qid", "left_semi"))


def mine_hard_negatives(candidates: DataFrame, positives: DataFrame, collection_ids: DataFrame,
                        config: MiningConfig = MiningConfig()) -> DataFrame:
    """M4: ``query_id, positive_id, negative_ids array<long>`` (negatives sorted by id).

    ``candidates`` must already be the first stage's top ``config.top_k`` per query.
    """
    present = positives_in_collection(positives, collection_ids)
    win = rank_window(_pool(candidates, positives, present, config.top_k), config.rank_min, config.rank_max)
    negs = (sample_negatives(win, config.num_negatives, config.seed)
            .groupBy("qid").agg(F.array_sort(F.collect_list("docid")).alias("negative_ids")))
    return present.join(negs, "qid").select(F.col("qid").alias("query_id"), F.col("docid").alias("positive_id"),
                                            "negative_ids")


def mining_skip_report(queries: DataFrame, candidates: DataFrame, positives: DataFrame,
                       collection_ids: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """M5: per-reason counts of queries that produce no mined rows."""
    q = queries.select("qid").distinct()
    has_pos = positives.select("qid").distinct().withColumn("_hp", F.lit(True))
    present = positives_in_collection(positives, collection_ids).select("qid").distinct().withColumn("_pr", F.lit(True))
    pool = exclude_positives(candidates.where(F.col("rank") <= config.top_k), positives)
    win = rank_window(pool, config.rank_min, config.rank_max)
    wsize = win.groupBy("qid").agg(F.count(F.lit(1)).alias("_w"))
    j = q.join(has_pos, "qid", "left").join(present, "qid", "left").join(wsize, "qid", "left")
    no_qrel = F.col("_hp").isNull()
    off = ~no_qrel & F.col("_pr").isNull()
    small = ~no_qrel & ~off & (F.coalesce(F.col("_w"), F.lit(0)) < config.num_negatives)
    return j.agg(F.count_if(no_qrel).alias("skipped_no_qrel"),
                 F.count_if(off).alias("skipped_positive_not_in_collection"),
                 F.count_if(small).alias("skipped_insufficient_pool"),
                 F.count_if(~no_qrel & ~off & ~small).alias("mined_queries"))


def write_mined(queries: DataFrame, candidates: DataFrame, positives: DataFrame, collection_ids: DataFrame,
                path: str, config: MiningConfig = MiningConfig()) -> dict[str, int]:
    """M4 to a table, with M5 counted by the job that writes it.

    Writes ``query_id, positive_id, negative_ids`` to ``path`` and returns ``rows`` (written),
    ``mined_queries`` and the queries skipped by reason. ValueError with those counts if
    nothing was mined. Every query of ``queries`` (``qid``) is counted once.
    """
    present = positives_in_collection(positives, collection_ids).select("qid", "docid").distinct()
    win = rank_window(_pool(candidates, positives, present, config.top_k), config.rank_min, config.rank_max)
    negs = (sample_negatives(win, config.num_negatives, config.seed)
            .groupBy("qid").agg(F.array_sort(F.collect_list("docid")).alias("negative_ids")))
    status = (queries.select("qid").distinct()
              .join(positives.select("qid").distinct().withColumn("_positive", F.lit(True)), "qid", "left")
              .join(present.groupBy("qid").agg(F.min("docid").alias("_first")), "qid", "left")
              .join(negs, "qid", "left"))
    rows = status.join(present, "qid", "left").select(
        F.col("qid").alias("query_id"), F.col("docid").alias("positive_id"), "negative_ids", "_positive", "_first")
    none = F.col("_positive").isNull()
    off = ~none & F.col("_first").isNull()
    once = F.col("positive_id") == F.col("_first")  # of a query's positives one row counts
    return sink_counted(rows, path, "mining", keep=F.col("negative_ids").isNotNull() & F.col("positive_id").isNotNull(),
                        counts={"skipped_no_qrel": none, "skipped_positive_not_in_collection": off,
                                "skipped_insufficient_pool": once & F.col("negative_ids").isNull(),
                                "mined_queries": once & F.col("negative_ids").isNotNull()},
                        drop=("_positive", "_first"))


def synthetic_qrels(queries: DataFrame, collection: DataFrame, *, seed: int = 42, first_n: int = 1000) -> DataFrame:
    """M8: each query gets one seeded random passage among the first ``first_n`` ids.

    The first ``first_n`` ids are a bounded top-n (TakeOrderedAndProject); their
    positions are numbered within that bounded set.
    """
    head = collection.select("docid").orderBy("docid").limit(first_n)
    head = head.withColumn("_pos", (F.row_number().over(Window.orderBy("docid")) - 1).cast("long"))
    n = head.count()
    if n == 0:
        raise ValueError("empty collection")
    pick = queries.select("qid", F.pmod(hash_key(seed, F.col("qid")), F.lit(n)).alias("_pos"))
    return pick.join(F.broadcast(head), "_pos").select("qid", "docid", F.lit(1).alias("rel"))


def score_gap_filter(mined: DataFrame, scores: DataFrame, max_score: float = 0.8) -> DataFrame:
    """M9: drop mined negatives whose query-negative score exceeds ``max_score``.

    ``scores``: ``qid, docid, score`` (e.g. the kNN run that produced the pool).
    """
    ex = mined.select("query_id", "positive_id", F.explode("negative_ids").alias("docid"))
    sc = scores.select(F.col("qid").alias("query_id"), "docid", "score")
    kept = ex.join(sc, ["query_id", "docid"], "left").where(F.coalesce(F.col("score"), F.lit(0.0)) <= max_score)
    return (kept.groupBy("query_id", "positive_id")
            .agg(F.array_sort(F.collect_list("docid")).alias("negative_ids")))


def mid_band_negatives(candidates: DataFrame, positives: DataFrame, lo: float, hi: float, n: int,
                       seed: int = 42) -> DataFrame:
    """Sample ``n`` negatives per query from candidates scored in ``[lo, hi]``."""
    pool = exclude_positives(candidates, positives).where(F.col("score").between(lo, hi))
    return (sample_negatives(pool, n, seed).groupBy("qid")
            .agg(F.array_sort(F.collect_list("docid")).alias("negative_ids")))


def dual_agree_negatives(cands_a: DataFrame, cands_b: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates both scorers retrieved, minus positives: ``qid, docid, rank_a, rank_b``."""
    a = cands_a.select("qid", "docid", F.col("rank").alias("rank_a"))
    b = cands_b.select("qid", "docid", F.col("rank").alias("rank_b"))
    return exclude_positives(a.join(b, ["qid", "docid"]), positives)
