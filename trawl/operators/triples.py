"""Training-triple building and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators.selection import first_rows
from trawl.operators.util import dense_index, literal_row
from trawl.session import scratch_dir
from trawl.sources.sinks import sink_counted


def explode_mined(mined: DataFrame) -> DataFrame:
    """``query_id, positive_id, negative_ids[]`` -> one row per negative
    (``neg_pos`` keeps the list position)."""
    return mined.select("query_id", "positive_id",
                        F.posexplode("negative_ids").alias("neg_pos", "negative_id"))


def mix_sources(official: DataFrame | None, mined: DataFrame | None, ratio_official: float,
                official_order: Column | str | None = None, mined_order: Column | str | None = None) -> DataFrame:
    """M6: deterministic weighted interleave of two triple sources.

    Each source keeps its own order (ties by ids); its i-th row (0-based) gets ``mix_key = (i + 0.5) /
    weight``. Sorting the union by ``(mix_key, source)`` interleaves the sources in the
    ratio of their weights and lets one source continue alone once the other ends. A
    source of weight 0 contributes nothing. Output: ``source, query_id, positive_id,
    negative_id, mix_key`` (unordered; sort by mix_key, source to consume in order).
    """
    if not 0.0 <= ratio_official <= 1.0:
        raise ValueError(f"mix_ratio_official must be in [0, 1], got {ratio_official}")
    parts = []
    if official is not None:
        w = ratio_official if mined is not None else 1.0
        parts.append(("official", 0, official, official_order, w))
    if mined is not None:
        w = (1.0 - ratio_official) if official is not None else 1.0
        parts.append(("mined", 1, mined, mined_order, w))
    if not parts:
        raise ValueError("no triple source given")
    out = None
    for name, tag, df, order, w in parts:
        if w <= 0.0:
            continue
        ids = F.struct("query_id", "positive_id", "negative_id")
        o = F.col(order) if isinstance(order, str) else order
        # rows that tie in the caller's order go by their ids, so positions are the same on every run
        o = ids if o is None else F.struct(o.alias("first"), ids.alias("then"))
        idx = dense_index(df.withColumn("_ord", o), "_ord", "_i")
        part = idx.select(F.lit(name).alias("source"), F.lit(tag).alias("_tag"), "query_id", "positive_id",
                          "negative_id", ((F.col("_i") + F.lit(0.5)) / F.lit(w)).alias("mix_key"))
        out = part if out is None else out.unionByName(part)
    return out.drop("_tag")


def resolve_triples(triples: DataFrame, queries: DataFrame, collection: DataFrame) -> DataFrame:
    """Ids -> text. Rows with an unknown query or passage id are dropped.

    ``queries``/``collection``: ``id, text``. Extra columns of ``triples`` are kept.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("text").alias("query_text"))
    p = collection.select(F.col("id").alias("positive_id"), F.col("text").alias("positive_text"))
    n = collection.select(F.col("id").alias("negative_id"), F.col("text").alias("negative_text"))
    return triples.join(q, "query_id").join(p, "positive_id").join(n, "negative_id")


def build_triples(official: DataFrame | None, mined: DataFrame | None, queries: DataFrame, collection: DataFrame,
                  *, ratio_official: float = 0.5, max_triples: int | None = None,
                  official_order: Column | str | None = None, mined_order: Column | str | None = None) -> DataFrame:
    """M7: mix -> resolve -> cap. Only resolved rows count towards ``max_triples``.

    The cap is settled on ids: triples whose ids exist are written, the first
    ``max_triples`` of them chosen, and texts joined to those alone. Ids of queries and
    passages are unique. Returns ``query_id, query_text, positive_text, negative_text,
    source, mix_key``.
    """
    mixed = mix_sources(official, mined, ratio_official, official_order, mined_order)
    if max_triples:
        path = scratch_dir(mixed.sparkSession, "resolvable")
        resolvable_triples(mixed, queries, collection).write.parquet(path)
        mixed = first_rows(mixed.sparkSession.read.parquet(path), ["mix_key", "source"], max_triples)
    return resolve_triples(mixed, queries, collection).select(
        "query_id", "query_text", "positive_text", "negative_text", "source", "mix_key")


def resolvable_triples(triples: DataFrame, queries: DataFrame, collection: DataFrame) -> DataFrame:
    """The rows of ``triples`` whose three ids exist (semi joins on ids; no text is read)."""
    for ids, name in ((queries, "query_id"), (collection, "positive_id"), (collection, "negative_id")):
        triples = triples.join(ids.select(F.col("id").alias(name)), name, "left_semi")
    return triples


def _flagged(triples: DataFrame, queries: DataFrame, collection: DataFrame, text: bool) -> DataFrame:
    """``triples`` with ``known`` (all three ids exist) and, with ``text``, their texts."""
    found = []
    for ids, name in ((queries, "query"), (collection, "positive"), (collection, "negative")):
        cols = [F.col("text").alias(f"{name}_text")] if text else []
        side = ids.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(f"_has_{name}"), *cols)
        triples = triples.join(side, f"{name}_id", "left")
        found.append(F.col(f"_has_{name}").isNotNull())
    return triples.withColumn("known", found[0] & found[1] & found[2]).drop("_has_query", "_has_positive", "_has_negative")


def write_triples(official: DataFrame | None, mined: DataFrame | None, queries: DataFrame, collection: DataFrame,
                  path: str, *, ratio_official: float = 0.5, max_triples: int | None = None,
                  official_order: Column | str | None = None, mined_order: Column | str | None = None) -> dict[str, int]:
    """M7 to a table: mix -> resolve -> cap, written to ``path`` as ``query_id, query_text,
    positive_text, negative_text, source, mix_key``.

    Returns ``rows`` (written), ``total`` (mixed) and ``dropped_unknown_ids``, counted by the
    jobs that write (with a cap, by the one that writes ids). ValueError if no row is left.
    Ids of queries and passages are unique; a null id is unknown.
    """
    mixed = mix_sources(official, mined, ratio_official, official_order, mined_order)
    known = F.col("known")
    report = {"total": F.lit(True), "dropped_unknown_ids": ~known}
    if not max_triples:
        return sink_counted(_flagged(mixed, queries, collection, True), path, "building triples", keep=known,
                            counts=report, drop=("known", "positive_id", "negative_id"))
    spark = mixed.sparkSession
    ids = scratch_dir(spark, "resolvable")
    counts = sink_counted(_flagged(mixed, queries, collection, False), ids, "building triples", keep=known,
                          counts=report, drop=("known",))
    capped = first_rows(spark.read.parquet(ids), ["mix_key", "source"], max_triples)
    texts = resolve_triples(capped, queries, collection).drop("positive_id", "negative_id")
    return counts | sink_counted(texts, path, "building triples")


def resolve_drop_count(triples: DataFrame, queries: DataFrame, collection: DataFrame) -> DataFrame:
    """J4 report: ``total, kept, dropped_unknown_ids``, counted by one job that writes the ids
    that resolve. ValueError if none does."""
    spark = triples.sparkSession
    flagged = _flagged(triples.select("query_id", "positive_id", "negative_id"), queries, collection, False)
    found = sink_counted(flagged, scratch_dir(spark, "resolved"), "resolving triples", keep=F.col("known"),
                         counts={"total": F.lit(True), "dropped_unknown_ids": ~F.col("known")}, drop=("known",))
    return literal_row(spark, {"total": found["total"], "kept": found["rows"], "dropped_unknown_ids": found["dropped_unknown_ids"]},
                       {"total": "long", "kept": "long", "dropped_unknown_ids": "long"})


def triples_to_pairs(text_triples: DataFrame) -> DataFrame:
    """Each triple -> (query, positive, 1.0) then (query, negative, 0.0)."""
    pairs = F.array(
        F.struct(F.col("query_text").alias("sentence_A"), F.col("positive_text").alias("sentence_B"),
                 F.lit(1.0).cast("float").alias("label")),
        F.struct(F.col("query_text").alias("sentence_A"), F.col("negative_text").alias("sentence_B"),
                 F.lit(0.0).cast("float").alias("label")))
    return text_triples.select(F.inline(pairs))


def triples_to_triplets(text_triples: DataFrame) -> DataFrame:
    """Rename to ``query, positive, negative`` keeping the ones present."""
    names = {"query_text": "query", "positive_text": "positive", "negative_text": "negative"}
    return text_triples.select(*[F.col(k).alias(v) for k, v in names.items() if k in text_triples.columns])


def cap_rows(df: DataFrame, n: int | None, id_col: str = "qid") -> DataFrame:
    """First ``n`` rows by numeric id (see ``first_rows``); all rows when ``n`` is None."""
    return first_rows(df, [F.col(id_col).cast("long")], n) if n is not None else df


def filter_relevant(qrels: DataFrame) -> DataFrame:
    """Judgments with ``rel > 0``."""
    return qrels.where(F.col("rel") > 0)
