"""Lexical operators: tokenisation, BM25 first stage (R6), containment judgments.

Tokens are maximal runs of Unicode letters/digits. Neither operator is a nested loop over
(query, document):

* BM25 keeps only document tokens that occur in some query and scores blocks of
  documents that can still change a query's top k (see ``bm25``).
* Containment judgments pick one *interior* token of each item (a token with separators
  on both sides inside the item text). Any document that contains the item text must
  contain that token as a whole token, so an equi-join on it yields a superset of the
  true pairs, and ``contains`` then checks each candidate exactly. Items without an
  interior token are joined on their first characters instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators import bm25
from trawl.operators.knn import rank_topk
from trawl.operators.util import broadcast_if_small
from trawl.session import scratch_dir

# fixed values: token pattern and BM25 parameters (Anserini defaults for MS MARCO runs)
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SEPARATOR_PATTERN = r"[^\p{L}\p{N}]+"
BM25_K1 = 0.9
BM25_B = 0.4
#: Characters that key an item without an interior token; shares of the documents for an empty item.
GRAM = 3
EMPTY_SALTS = 64


def tokens(text: Column, lower: bool = True) -> Column:
    """Maximal runs of letters/digits, in order. Splitting on separator runs and dropping
    the empty edge fields gives exactly the matches of TOKEN_PATTERN, ~5x faster than
    extracting them."""
    t = F.lower(text) if lower else text
    return F.array_remove(F.split(t, SEPARATOR_PATTERN), "")


def _query_pairs(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``orig_qid, qid`` and ``qid, term, qtf``): queries of the same tokens share one id, so
    that they are scored once."""
    qtok = queries.select(F.col("id").cast("long").alias("orig_qid"), tokens(F.col("text")).alias("toks"))
    qtok = qtok.withColumn("bag", F.array_join(F.array_sort("toks"), " "))
    reps = qtok.groupBy("bag").agg(F.min("orig_qid").alias("qid"))
    members = qtok.select("orig_qid", "bag").join(reps, "bag").select("orig_qid", "qid")
    pairs = (reps.select("qid", F.explode(F.split("bag", " ")).alias("term")).where("term <> ''")
             .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))
    return members, pairs


def bm25_first_stage(queries: DataFrame, docs: DataFrame, top_k: int = 1000, *, k1: float = BM25_K1,
                     b: float = BM25_B, digits: int = 6, max_broadcast_terms: int = 2_000_000) -> DataFrame:
    """``qid, docid, score, rank`` — BM25 top-k per query over ``docs(id, text)``.

    Queries with the same token multiset are scored once and their ranked list is shared.
    The collection is read once per ``bm25.PAIRS`` (query, term) pairs and scored with exact
    block skipping (``bm25``). Null texts have no tokens. No query term or no document: no
    rows.
    """
    spark = docs.sparkSession
    members, pairs = _query_pairs(queries)
    path = scratch_dir(spark, "queries")
    pairs.write.parquet(path)  # counted and then read group by group
    scored = spark.createDataFrame([], "qid long, docid long, score double")
    for group in bm25.passes(spark.read.parquet(path)):
        scored = scored.unionByName(bm25.scored_pairs(group, docs, tokens(F.col("text")), top_k, k1, b))
    top = rank_topk(scored.withColumn("score", F.round("score", digits)), top_k)
    # fan out: every query id receives its bag's ranked list (k rows per query id)
    return (broadcast_if_small(members, max_broadcast_terms).join(top, "qid")
            .select(F.col("orig_qid").alias("qid"), "docid", "score", "rank"))


def bm25_postings_read(queries: DataFrame, docs: DataFrame, top_k: int = 1000) -> DataFrame:
    """One row: ``read``, the postings of query terms that ``bm25_first_stage`` scores, and
    ``postings``, all of them."""
    out = docs.sparkSession.createDataFrame([(0, 0)], "read long, postings long")
    for group in bm25.passes(_query_pairs(queries)[1]):
        out = out.unionByName(bm25.scored_pairs(group, docs, tokens(F.col("text")), top_k, BM25_K1, BM25_B, report=True))
    return out.agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))


def _candidates_by_gram(short: DataFrame, d: DataFrame, n: int) -> DataFrame:
    """(qid, docid) of documents that hold the first ``n`` characters of a short item.

    The empty item (n = 0) is in every text: its rows are dealt by a hash of the document
    id, so no task receives all documents.
    """
    if n == 0:
        salt = F.pmod(F.xxhash64("docid"), F.lit(EMPTY_SALTS))
        return (d.where(F.col("dtext").isNotNull()).select("docid", salt.alias("gram"))
                .join(short.select("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(EMPTY_SALTS - 1).cast("long"))).alias("gram")), "gram")
                .select("qid", "docid"))
    grams = F.array_distinct(F.regexp_extract_all("dtext", F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
    return (d.select("docid", F.explode(grams).alias("gram"))
            .join(short.select("qid", F.substring("itext", 1, n).alias("gram")), "gram")
            .select("qid", "docid"))


def containment_qrels(items: DataFrame, docs: DataFrame, *, max_broadcast_items: int = 100_000) -> DataFrame:
    """``qid, docid, rel=1`` for every document whose text contains the item text.

    Items with an interior token are matched on it; the others (at most two tokens) on
    their first characters, up to GRAM of them. Null texts contain nothing and are in
    nothing.
    """
    it = items.select(F.col("id").alias("qid"), F.col("text").alias("itext"),
                      tokens(F.col("text"), lower=False).alias("_t")).where(F.col("itext").isNotNull())
    # interior tokens: drop the first and last token (they may continue outside the item)
    interior = F.slice(F.col("_t"), 2, F.greatest(F.size("_t") - 2, F.lit(0)))
    longest = F.aggregate(interior, F.lit(None).cast("string"),
                          lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc))
                                                | ((F.length(x) == F.length(acc)) & (x < acc)), x).otherwise(acc))
    it = it.select("qid", "itext", longest.alias("anchor"))
    d = docs.select(F.col("id").alias("docid"), F.col("text").alias("dtext"))
    dterms = d.select("docid", F.explode(F.array_distinct(tokens(F.col("dtext"), lower=False))).alias("anchor"))
    anchored = it.where(F.col("anchor").isNotNull()).select("qid", "anchor")
    cands = dterms.join(broadcast_if_small(anchored, max_broadcast_items), "anchor").select("qid", "docid")
    short = it.where(F.col("anchor").isNull()).select("qid", "itext", F.least(F.length("itext"), F.lit(GRAM)).alias("n"))
    for row in short.select("n").distinct().orderBy("n").collect():  # at most GRAM + 1 numbers
        cands = cands.unionByName(_candidates_by_gram(short.where(F.col("n") == row.n), d, row.n))
    return (cands.join(d, "docid").join(it.select("qid", "itext"), "qid")
            .where(F.col("dtext").contains(F.col("itext")))
            .select("qid", "docid").distinct().withColumn("rel", F.lit(1)))
