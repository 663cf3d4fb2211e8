"""Exact dedup by deterministic block naming.

Every normalised text is cut into fixed-size blocks. Distinct blocks are sorted and get
integer names; then adjacent names are paired and the distinct pairs named again, until
each text has one name. Two texts have the same (number of blocks, name) exactly when
they are identical: names stand for sorted distinct contents, never for hash values.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.arrays import released
from trawl.llm.skew import join_sized
from trawl.session import scratch_dir

#: Names are sorted within buckets of equal content checksum, so naming needs no global sort.
BUCKETS = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def normalise(text: bytes) -> bytes:
    """Replace every run of space and 0x09-0x0D by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    lead, tail = b" " if text[0] in _SPACES else b"", b" " if text[-1] in _SPACES else b""
    return lead + b" ".join(words) + tail


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int, places: bool) -> Iterator[tuple[dict[bytes, int], dict[bytes, list]]]:
    """Of each Arrow batch its distinct blocks, numbered through the table, and (with ``places``) where they are."""
    task, seen = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        found: dict[bytes, list] = {}
        for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            text = normalise(text.as_py() or b"")
            sha = hashlib.sha256(text).hexdigest() if places else None
            n = max(1, -(-len(text) // block_bytes))
            for pos in range(n):
                at = found.setdefault(text[pos * block_bytes:(pos + 1) * block_bytes], [])
                if places:
                    at.append({"row": row, "pos": pos, "blocks": n, "id": doc, "sha": None if pos else sha})
        yield {b: task + seen + k for k, b in enumerate(found)}, found
        seen += len(found)


def _cut(block_bytes: int):
    """The distinct blocks of each Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, _ in _blocks(batches, block_bytes, False):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(numbers.values()), pa.int64()), pa.array([zlib.crc32(b) % BUCKETS for b in numbers], pa.int64()),
                 pa.array(list(numbers), pa.binary())], names=["number", "bucket", "block"])

    return released(run)


def _places(block_bytes: int):
    """The places of the distinct blocks of each Arrow batch."""
    place = pa.struct([("row", pa.int64()), ("pos", pa.int32()), ("blocks", pa.int32()), ("id", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, found in _blocks(batches, block_bytes, True):
            yield pa.RecordBatch.from_arrays([pa.array(list(numbers.values()), pa.int64()), pa.array(list(found.values()), pa.list_(place))],
                                             names=["number", "places"])

    return released(run)


def _names(df: DataFrame, *content: str) -> DataFrame:
    """``df`` with the integer ``name`` of its content columns; needs the column ``bucket``."""
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*content))
    return df.withColumn("name", F.col("bucket") * (1 << 31) + rank)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "row_id",
               block_bytes: int = 4096) -> DataFrame:
    """(row, id, sha, blocks, name) of every row: equal (blocks, name) means equal text.

    ``row_col`` tells rows apart (ids may repeat or be null). A block is sorted once per Arrow
    batch that holds it, without its places; names then go to the places by a number that no
    two share. Pairs of names are named once each, and joins on large keys broadcast them.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "blocks")
    read = docs.select(row_col, F.col(id_col).cast("long"), text_col)
    names = _names(read.mapInArrow(_cut(block_bytes), "number long, bucket long, block binary"), "block").select("number", "name")
    places = read.mapInArrow(_places(block_bytes), "number long, places array<struct<row: long, pos: int, blocks: int, id: long, sha: string>>")
    places.join(names, "number").select(F.explode("places").alias("p"), "name").select("p.*", "name").write.parquet(f"{path}/0")
    named = spark.read.parquet(f"{path}/0")
    heads = named.where("pos = 0").select("row", "id", "sha", "blocks")
    done = [named.where("blocks = 1").select("row", "name")]
    live = named.where("blocks > 1").select("row", "pos", "name")
    longest = named.agg(F.max("blocks")).first()[0] or 1
    for level in range(1, (longest - 1).bit_length() + 1):
        pairs = live.groupBy("row", F.expr("div(pos, 2)").cast("int").alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(0)).alias("b"))
        pairs.write.parquet(f"{path}/{level}")
        pairs = spark.read.parquet(f"{path}/{level}")
        distinct = (pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size"))
                    .withColumn("bucket", F.expr(f"pmod(xxhash64(a, b), {BUCKETS})")))
        _names(distinct, "a", "b").select("a", "b", "size", "name").write.parquet(f"{path}/{level}-names")
        live = join_sized(pairs, spark.read.parquet(f"{path}/{level}-names"), ["a", "b"], "size").select("row", "pos", "name")
        live.write.parquet(f"{path}/{level}-named")
        live = spark.read.parquet(f"{path}/{level}-named")
        # a text is done when its pairs have become one
        last = heads.where((F.col("blocks") > 1 << (level - 1)) & (F.col("blocks") <= 1 << level)).select("row")
        done.append(live.join(last, "row").select("row", "name"))
        live = live.join(last, "row", "left_anti") if level < (longest - 1).bit_length() else live
    all_done = done[0]
    for more in done[1:]:
        all_done = all_done.unionByName(more)
    return heads.join(all_done, "row")


def with_rows(docs: DataFrame, row_col: str = "row_id") -> DataFrame:
    """``docs`` with a row number that is the same whenever the same files are read again.

    ``docs`` must come straight from files (a table, a written stage), as retried tasks
    must number rows alike.
    """
    return docs.withColumn(row_col, F.monotonically_increasing_id())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts equal each other. The row with the smallest id
    stays (null ids come last; of repeated ids the first row). An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "identities")
    identities(with_rows(docs.select(id_col, text_col)), id_col, text_col, "row_id", block_bytes).write.parquet(f"{path}/rows")
    named = spark.read.parquet(f"{path}/rows")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    named.groupBy("blocks", "name").agg(best, F.count(F.lit(1)).alias("group_size")).write.parquet(f"{path}/groups")
    return join_sized(named, spark.read.parquet(f"{path}/groups"), ["blocks", "name"], "group_size").select(
        F.col("row").alias("row_id"), F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` (row_id, kept) keeps, whatever their columns are called."""
    keep = groups.where("kept").select("row_id")
    rows = with_rows(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")))
    return rows.join(keep, "row_id", "left_semi").select("doc.*")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return kept_rows(docs, exact_groups(docs, id_col, text_col))
