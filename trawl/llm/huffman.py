"""Token-id files by canonical length-limited Huffman coding.

Code lengths come from the global counts of ids (package-merge), codes are canonical. A
file holds independent blocks of whole documents; every document starts at a byte, and
every ``STEP``-th token's bit offset is kept as a checkpoint, so a block decodes by table
look-ups in many places at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.arrays import binary_lists

#: Longest code, tokens between checkpoints, and tokens from which a block is closed.
LIMIT, STEP, BLOCK = 16, 128, 1 << 17
#: Bytes of ids of a part of the files, and rows whose ids are counted at once.
PART_BYTES, COUNTED = 8 << 20, 200


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``limit`` bits; ids with
    no count get 0. A single id gets 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, rows = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = row[:len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        row = both[by]
        rows.append(by < len(leaves))
    take = 2 * len(leaves) - 2
    for leaf in reversed(rows):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): consecutive numbers, doubled at each step in length."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[k])
        if n:
            code <<= n - last
            codes[k] = code
            code, last = code + 1, n
    return codes


class Codec:
    """Encoding and decoding tables for the code lengths of ids 0, 1, ..."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        self.codes = canonical(self.lengths)
        self.width = max(1, int(self.lengths.max(initial=1)))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.ones(1 << self.width, np.int64)
        used = np.flatnonzero(self.lengths)
        by = used[np.lexsort((used, self.lengths[used]))]  # canonical codes ascend in this order
        spans = 1 << (self.width - self.lengths[by])
        total = int(spans.sum())
        self.symbol[:total] = np.repeat(by, spans)
        self.length[:total] = np.repeat(self.lengths[by], spans)

    def encode(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(payload, first byte of each document, checkpoints) of documents ids[ptr[i]:ptr[i+1]].

        Checkpoints are bit offsets of each document's tokens 0, STEP, 2 STEP, ...
        """
        n = np.diff(ptr)
        size = self.lengths[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        whole = -(-(at[ptr[1:]] - at[ptr[:-1]]) // 8)  # bytes of each document
        first = np.cumsum(whole) - whole
        bits = at[:-1] + np.repeat(first * 8 - at[ptr[:-1]], n)
        word, off = bits >> 6, bits & 63
        out = np.zeros((int(whole.sum()) + 7) // 8 + 2, np.uint64)
        if len(ids):
            over = off + size - 64
            code = self.codes[ids]
            main = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[starts]] = np.add.reduceat(main, starts)
            late = np.flatnonzero(over > 0)
            out[word[late] + 1] |= code[late] << (64 - over[late]).astype(np.uint64)
        within = np.arange(len(ids)) - np.repeat(ptr[:-1], n)
        return out.astype(">u8").tobytes()[:int(whole.sum())], first, bits[within % STEP == 0]

    def decode(self, payload: bytes, lengths: np.ndarray, checkpoints: np.ndarray) -> np.ndarray:
        """The ids of documents of the given token counts, in order."""
        lengths = np.asarray(lengths, np.int64)
        out = np.zeros(int(lengths.sum()), np.uint32)
        if not len(out):
            return out
        raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint64)
        seen = raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]
        lanes = -(-lengths // STEP)
        lane_in_doc = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        todo = np.minimum(STEP, np.repeat(lengths, lanes) - lane_in_doc * STEP)
        place = np.repeat(np.cumsum(lengths) - lengths, lanes) + lane_in_doc * STEP
        by = np.argsort(-todo, kind="stable")  # longest lanes first: those still running are a prefix
        todo, place, pos = todo[by], place[by], np.asarray(checkpoints, np.int64)[by]
        running = np.searchsorted(-todo, -np.arange(1, STEP + 1), "right")
        mask, room = np.uint64((1 << self.width) - 1), 40 - self.width
        for step in range(STEP):
            n = int(running[step])
            if not n:
                break
            p = pos[:n]
            code = (seen[p >> 3] >> (room - (p & 7)).astype(np.uint64)) & mask
            out[place[:n] + step] = self.symbol[code]
            p += self.length[code]
        return out


def count_ids(encoded: DataFrame, dtype: str) -> np.ndarray:
    """How often each id occurs, counted over all rows (at most one number per id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED):  # a count of all ids costs as much for one row
                found = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(lo, COUNTED).to_pylist()), dtype))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_files(encoded: DataFrame, path: str, dtype: str, order: tuple[str, ...] = ("doc_id", "row_id"),
                partitions: int | None = None) -> None:
    """Write ``encoded`` (doc_id, row_id, ids as binary of ``dtype``) in ascending order.

    ``path``/code holds the code lengths, ``path``/blocks one row per block: part, block,
    start (tokens before it in its part), doc_ids, lengths, payload, checkpoints. Parts
    ascend with the order and hold about PART_BYTES of ids, unless ``partitions`` says how many
    they are. Null ids come first; repeated ids follow row_id; rows without
    tokens are kept. ``encoded`` is read twice: pass a written table.
    """
    spark = encoded.sparkSession
    lengths = code_lengths(count_ids(encoded, dtype))
    spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths) if n], "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)  # one number per id
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, start, block = Codec(shared.value), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        rows: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal start, block, docs, rows
            ptr = np.cumsum([0, *map(len, rows)])
            payload, _, marks = codec.encode(np.concatenate(rows), ptr)
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(doc_type)),
                pa.array([[len(r) for r in rows]], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                binary_lists(marks.astype("<u4"), np.array([0, len(marks)]))],
                names=["part", "block", "start", "doc_ids", "lengths", "payload", "checkpoints"])
            start, block, docs, rows = start + int(ptr[-1]), block + 1, [], []
            return out

        size = 0
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                rows.append(np.frombuffer(ids, dtype))
                size += len(rows[-1])
                if size >= BLOCK or len(rows) >= BLOCK:
                    yield close()
                    size = 0
        if rows:
            yield close()

    size = F.col("n_tokens") * np.dtype(dtype).itemsize if "n_tokens" in encoded.columns else F.octet_length("ids")
    n = partitions or -(-(encoded.agg(F.sum(size)).first()[0] or 1) // PART_BYTES)
    (encoded.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids")
     .mapInArrow(run, f"part long, block long, start long, doc_ids array<{kind}>, lengths array<long>, payload binary, checkpoints binary")
     .write.parquet(f"{path}/blocks"))


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are binary,
    little-endian unsigned 32-bit; start counts the tokens of all documents before."""
    table = spark.read.parquet(f"{path}/code").collect()  # one row per id of the vocabulary
    lengths = np.zeros(max((r.id for r in table), default=0) + 1, np.int64)
    for r in table:
        lengths[r.id] = r.length
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select("part", before.alias("before"))  # one row per part of the files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                first, docs, n, payload, marks = (batch.column(c)[k].as_py() for c in range(5))
                n = np.array(n, np.int64)
                ids = codec.decode(payload, n, np.frombuffer(marks, "<u4"))
                ptr = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, batch.schema.field(1).type.value_type), pa.array(first + ptr[:-1]), pa.array(n),
                    binary_lists(ids.astype("<u4"), ptr)], names=["doc_id", "start", "n_tokens", "ids"])

    return (blocks.join(F.broadcast(parts), "part")
            .select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "lengths", "payload", "checkpoints")
            .mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary"))
