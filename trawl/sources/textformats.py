"""Scans of the line-oriented formats of the retrieval world.

All scans use ``spark.read.text`` + ``split`` rather than the CSV reader, so malformed
lines are skipped by an explicit field-count predicate that column pruning cannot
change. ``read_lines`` attaches a file-order key (file path, split start, position in
the split) so that "last duplicate wins" rules are defined by line order in the input,
the way a sequential reader sees it, while the files are still read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: whitespace trimmed the way str.strip()/str.split() do for ASCII input
_WS_EDGES = r"^[ \t\r\f\n\u000B]+|[ \t\r\f\n\u000B]+$"
# fixed values: what ends a line and what is white space at its edges, over all of Unicode
_LINE_END = r"\r\n|[\n\u000B\f\r\u001C\u001D\u001E\u0085\u2028\u2029]"
_BLANK = r"[\t\n\u000B\f\r\u001C-\u001F\u0085\u2028\u2029\p{Zs}]+"
_WS_RUN = r"[ \t\r\f\n\u000B]+"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line`` plus ``_order`` (struct sortable in file order)."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.text(paths)
    return df.select(
        F.col("value").alias("line"),
        F.struct(F.col("_metadata.file_path").alias("f"),
                 F.col("_metadata.file_block_start").alias("b"),
                 F.monotonically_increasing_id().alias("m")).alias("_order"))


def ws_fields(line: Column) -> Column:
    """``str.split()`` semantics: split on whitespace runs, no empty edge fields."""
    stripped = F.regexp_replace(line, _WS_EDGES, "")
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, _WS_RUN))


def tab_fields(line: Column) -> Column:
    """``line.rstrip('\\n').split('\\t')`` (the reader already removed the newline)."""
    return F.split(line, "\t", -1)


def scan_qrels_graded(spark: SparkSession, path) -> DataFrame:
    """``qid docid rel`` from ``qid iter docid rel`` lines (>= 4 fields, else skipped).

    A repeated (qid, docid) keeps the rel of its last line.
    """
    lines = read_lines(spark, path).select(ws_fields(F.col("line")).alias("p"), "_order")
    ok = lines.where(F.size("p") >= 4).select(
        F.col("p")[0].cast("long").alias("qid"), F.col("p")[2].cast("long").alias("docid"),
        F.col("p")[3].cast("int").alias("rel"), "_order")
    return ok.groupBy("qid", "docid").agg(F.max_by("rel", "_order").alias("rel"))


def scan_qrels_positive(spark: SparkSession, path) -> DataFrame:
    """S3: exactly 4 fields; ``rel`` is ignored, every listed pair is a positive."""
    lines = read_lines(spark, path).select(ws_fields(F.col("line")).alias("p"))
    return (lines.where(F.size("p") == 4)
            .select(F.col("p")[0].cast("long").alias("qid"), F.col("p")[2].cast("long").alias("docid"))
            .distinct())


def scan_id_triples(spark: SparkSession, path, *, with_order: bool = False) -> DataFrame:
    """Tab separated ``qid pos neg``; lines without exactly 3 fields are skipped."""
    lines = read_lines(spark, path).select(tab_fields(F.col("line")).alias("p"), "_order")
    cols = [F.col("p")[0].cast("long").alias("query_id"), F.col("p")[1].cast("long").alias("positive_id"),
            F.col("p")[2].cast("long").alias("negative_id")]
    if with_order:
        cols.append("_order")
    return lines.where(F.size("p") == 3).select(*cols)


def scan_run(spark: SparkSession, path, *, query_ids: DataFrame | None = None,
             top_k: int | None = None) -> DataFrame:
    """First-stage run, 6-column TREC or 3-column ``qid docid rank`` lines.

    Other widths are skipped. Keeps queries in ``query_ids`` (column ``qid``) and, per
    query, the first ``top_k`` candidates ordered by (rank, docid).
    Returns ``qid, docid, rank``.
    """
    p = read_lines(spark, path).select(ws_fields(F.col("line")).alias("p"))
    n = F.size("p")
    six = n >= 6
    three = n == 3
    rows = p.where(six | three).select(
        F.col("p")[0].cast("long").alias("qid"),
        F.when(six, F.col("p")[2]).otherwise(F.col("p")[1]).cast("long").alias("docid"),
        F.when(six, F.col("p")[3]).otherwise(F.col("p")[2]).cast("int").alias("rank"))
    if query_ids is not None:
        rows = rows.join(query_ids.select("qid").distinct(), "qid", "left_semi")
    if top_k:
        w = Window.partitionBy("qid").orderBy("rank", "docid")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).drop("_n")
    return rows


def scan_passage_lines(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Every text -> its lines, stripped, blanks dropped: ``id, line_no, line``."""
    x = texts.select(F.col(id_col).alias("id"),
                     F.posexplode(F.split(F.col(text_col), _LINE_END, -1)).alias("line_no", "raw"))
    x = x.select("id", F.col("line_no").cast("long").alias("line_no"),
                 F.regexp_replace("raw", f"^{_BLANK}|{_BLANK}$", "").alias("line"))
    return x.where(F.col("line") != "")


def write_lines(df: DataFrame, line: Column, order: list[str], path: str) -> str:
    """Write one text line per row so that file order follows ``order``.

    Range partitioning puts key ranges in partition order and Spark names part files by
    partition index, so (file name, position) reproduces the global order. The session's
    shuffle partitions, merged by their bytes, give the number of files.
    """
    (df.select(*order, line.alias("value"))
       .repartitionByRange(*order).sortWithinPartitions(*order)
       .select("value").write.mode("overwrite").text(path))
    return path
