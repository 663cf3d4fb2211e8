"""Line dedup by levelled sorted runs of line hashes.

Documents arrive in batches, largest ids first. A batch's lines are counted, merge-anti-joined
with the keys that the runs already hold often enough, and written as a new sorted run; when a
level has FANOUT runs they are compacted into one run of the next level. In the end the runs
say which keys too many documents hold and which document may keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.exact_dedup import with_rows
from trawl.operators.util import broadcast_if_small
from trawl.session import remove_dir, scratch_dir

#: A key has at least this many code points, and is repeated if at least MIN_DOCS documents hold it.
MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 8, 4
#: Repeated keys up to this number (24 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """16 hash bytes of a line's key (stripped, A-Z lower-cased), None if the key is short."""
    if len(line) < MIN_CHARS:
        return None
    line = line.strip(_SPACES)
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= MIN_CHARS else None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            mine = {line_key(x) for x in (text or "").split("\n")} - {None}
            rows.extend([k] * len(mine))
            found.extend(mine)
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.binary())],
                                         names=["row_id", "doc_id", "key"])


class LineRuns:
    """Sorted runs of (key, docs, keep): a line's key, the documents that hold it and the largest
    id among them, in the shared folder. Batches must come largest ids first, as a key
    that a run holds ``enough`` times is not written again."""

    def __init__(self, spark: SparkSession, enough: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.levels: list[list[str]] = [[]]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key binary, docs long, keep long").parquet(*paths)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = scratch_dir(self.spark, f"run-{level}")
        rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, key), a key once per document."""
        own = lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep"))
        if self.runs():
            full = self._read(self.runs()).where(F.col("docs") >= self.enough).select("key")
            own = own.join(full.hint("merge"), "key", "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for path in old:
                remove_dir(self.spark, path)
            level += 1

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("key").agg(F.sum("docs").alias("docs"), F.max("keep").alias("keep"))

    def repeated(self) -> DataFrame:
        """(key, keep) of the keys that enough documents hold."""
        if not self.runs():
            return self.spark.createDataFrame([], "key binary, keep long")
        return self._merged(self.runs()).where(F.col("docs") >= self.enough).select("key", "keep")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, drops) to (doc, text, n_lines, n_dropped)."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
        drops = batch.column(2)
        hit = np.flatnonzero(pc.fill_null(pc.list_value_length(drops), 0).to_numpy(zero_copy_only=False))
        gone = np.zeros(len(batch), np.int64)
        if len(hit):
            kept = texts.to_pylist()
            for k in hit:
                # the keys of one document's own lines
                bad = set(drops[int(k)].as_py())
                every = kept[k].split("\n")
                stay = [x for x in every if line_key(x) not in bad]
                gone[k] = len(every) - len(stay)
                kept[k] = "\n".join(stay)
            texts = pa.array(kept, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, lines, pa.array(gone)], names=["doc", "text", "n_lines", "n_dropped"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc, text, n_lines, n_dropped) per row of ``docs``: its other columns as a struct, the
    text without repeated lines, its lines before and how many of them went.

    A line goes if at least MIN_DOCS rows hold its key, except from the rows of the largest
    id that holds it. Null text is one empty line and comes back as an empty text; null ids
    are below all others. A key counts once per row, so repeated rows count each; rows that
    repeat the largest id all keep the line. Two keys with the same 16 hash bytes would be
    taken for equal. An empty table gives no rows. ``docs`` must come straight from files.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text_col]
    whole = with_rows(docs.select(F.struct(*others).alias("doc"), F.col(text_col).alias("text")))
    doc_id = F.col("doc")[id_col].cast("long")
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [k / batches for k in range(1, batches)])).first()[0] or []
    path = scratch_dir(spark, "lines")
    lines = whole.select("row_id", doc_id.alias("doc_id"), "text").mapInArrow(_keys, "row_id long, doc_id long, key binary")
    later = sum((F.coalesce(F.col("doc_id") <= c, F.lit(True)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    lines.withColumn("batch", later).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("row_id long, doc_id long, key binary, batch int").parquet(path)
    runs = LineRuns(spark)
    for k in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == k).drop("batch"))
    found = scratch_dir(spark, "repeated")
    runs.repeated().write.parquet(found)
    repeated = broadcast_if_small(spark.read.parquet(found), MOST_BROADCAST)
    drops = (lines.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
             .groupBy("row_id").agg(F.collect_list("key").alias("drops")))
    joined = whole.join(drops, "row_id", "left").select("doc", "text", "drops")
    kind = T.StructType([joined.schema["doc"], joined.schema["text"]]).add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_drop, kind)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns and ``text_col`` without its repeated lines; see ``deduplicated``."""
    done = deduplicated(docs, id_col, text_col)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
