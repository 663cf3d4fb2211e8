"""Importance resampling towards a target table.

Texts are bags of hashed word n-grams. A bucket's gain is the logarithm of how much likelier
it is in the target than in the corpus; a document's weight is the sum of its gains, and a
Gumbel key drawn from its id turns the highest weights into a sample without replacement.
Weights are computed by numpy over whole batches of texts. The cutoff is found by counting
jobs over the written scores, each of which cuts the interval by sixteen; only the drawn rows
are then range-partitioned for their ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrays import chunks, text_buffer
from trawl.llm.exact_dedup import with_rows
from trawl.llm.order import numbered
from trawl.session import scratch_dir

BUCKETS = 10_000
MIN_WORDS = 20
#: Words up to this many bytes are hashed a byte position at a time, longer ones one by one.
SHORT = 32
#: A counting job splits the interval it searches in so many parts.
PARTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[0x80:] = True


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32, and for 0 to SHORT + 1 following bytes the four byte tables
    that move a checksum past them (checksums of joined parts combine by exclusive or)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    moved = [np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(SHORT + 1):
        moved.append(step[moved[-1] & 255] ^ (moved[-1] >> 8))
    return step, np.stack(moved)


_STEP, _MOVED = _crc_tables()
_FLAT = np.ascontiguousarray(_MOVED).reshape(-1)
#: Checksum of one space, moved past a word of each length.
_SPACE = np.array([zlib.crc32(b" ")], np.uint32)


def _past(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved past ``length`` (at most SHORT + 1) bytes."""
    at = length.astype(np.int64) << 10
    out = _FLAT[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= _FLAT[at + (k << 8) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, second, third, ptr): buckets[k, i] is the bucket of the run of k + 1 words
    that begins at word i; second and third say whether that row has such a run there; row r
    has the words ptr[r] to ptr[r + 1]."""
    data = _LOWER[data]
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = _WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    n = len(starts)
    ptr = np.searchsorted(starts, offsets)
    size = ends - starts
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(size <= SHORT)
    for j in range(SHORT):
        live = live[size[live] > j]
        if not len(live):
            break
        c = crc[live]
        crc[live] = _STEP[(c ^ data[starts[live] + j]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    long = np.flatnonzero(size > SHORT)
    for i in long:
        crc[i] = zlib.crc32(data[starts[i]:ends[i]])
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    grams = np.zeros((3, n), np.uint32)
    grams[0] = crc
    if n > 1:
        after = np.minimum(size, SHORT)  # long words are mended below
        spaced = crc ^ _past(np.broadcast_to(_SPACE, n), after)
        for k in (1, 2):
            if n > k:
                grams[k, :n - k] = _past(grams[k - 1, :n - k], after[k:] + 1) ^ spaced[k:]
                for i in long[long >= k]:
                    grams[k, i - k] = zlib.crc32(data[starts[i]:ends[i]], zlib.crc32(b" ", int(grams[k - 1, i - k])))
    second, third = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    second[:-1] = row[1:] == row[:-1]
    third[:-2] = row[2:] == row[:-2]
    return (grams % BUCKETS).astype(np.int64), second, third, ptr


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        for lo, hi in chunks(offsets, 1 << 20):
            a = offsets[lo]
            b, second, third, _ = gram_buckets(data[a:offsets[hi]], offsets[lo:hi + 1] - a)
            for found in (b[0], b[1][second], b[2][third]):
                total += np.bincount(found, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of the whole column fall in each bucket. A task sums its own
    share, so at most BUCKETS rows a task are shuffled and BUCKETS rows reach the driver."""
    counts = texts.select(text_col).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket."""
    all_t, all_s = float(target.sum()), float(source.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_s + BUCKETS) / ((float(s) + 1) * (all_t + BUCKETS))))
                     for t, s in zip(target, source)], np.int64)


def gumbel(doc_id: int | None) -> int:
    """The seeded key of a document: floor(-1000 ln(-ln u)), u from the hash of its id (a null
    id hashes as an empty one)."""
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            data, offsets = text_buffer(batch.column(2))
            words, features, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for lo, hi in chunks(offsets, 1 << 20):
                a = offsets[lo]
                b, second, third, ptr = gram_buckets(data[a:offsets[hi]], offsets[lo:hi + 1] - a)
                each = gain[b[0]] + gain[b[1]] * second + gain[b[2]] * third
                sums = np.concatenate([[0], np.cumsum(each)])
                weight[lo:hi] = sums[ptr[1:]] - sums[ptr[:-1]]
                words[lo:hi] = n = np.diff(ptr)
                features[lo:hi] = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            score = weight + np.array([gumbel(i) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()),
                                              *(pa.array(x, pa.int64()) for x in (words, features, weight, score))],
                                             names=["row_id", "doc_id", "n_words", "n_features", "weight", "score"])

    return run


def cutoff(rows: DataFrame, key: str, need: int) -> tuple[int, int, int]:
    """(v, less, equal): the smallest v of the whole-number expression ``key`` that at least
    ``need`` rows do not exceed, how many rows are below v and how many at v. Every job counts
    exactly at PARTS - 1 points of the interval that is left."""
    lo, hi = rows.select(F.min(F.expr(key)), F.max(F.expr(key))).first()
    while lo < hi:
        points = sorted({lo + (hi - lo) * k // PARTS for k in range(1, PARTS)} | {(lo + hi) // 2})
        counts = rows.select(*(F.count_if(F.expr(key) <= F.lit(p).cast("long")) for p in points)).first()
        enough = [p for p, n in zip(points, counts) if n >= need]
        short = [p for p, n in zip(points, counts) if n < need]
        lo, hi = max([lo, *(p + 1 for p in short)]), min([hi, *enough])
    below, at = rows.select(F.count_if(F.expr(key) < F.lit(lo).cast("long")), F.count_if(F.expr(key) == F.lit(lo).cast("long"))).first()
    return lo, below, at


#: Highest scores first, ties to smaller ids (null ids last), then to earlier rows.
_ORDER = ["-score", "cast(doc_id is null as int)", "coalesce(doc_id, 0)", "row_id"]


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, n_words, n_features, weight, score, rank.

    ``percent`` of the documents of at least MIN_WORDS words are drawn (rounded down) and
    ranked from 1; the others have a null rank. Null texts have no words; a document without
    features weighs 0. Of repeated ids every row takes part. An empty table gives no rows;
    an empty target leaves every gain to the corpus counts. ``docs`` must come straight from
    files; its other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    docs = with_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    gain = gains(bucket_counts(target, text_col), bucket_counts(docs))
    path = scratch_dir(spark, "weights")
    docs.select("row_id", "doc_id", "text").mapInArrow(
        _scored(gain), "row_id long, doc_id long, n_words long, n_features long, weight long, score long").write.parquet(path)
    scores = spark.read.parquet(path)
    able = scores.where(F.col("n_words") >= MIN_WORDS)
    need = able.count() * percent // 100
    drawn = F.lit(False)
    if need:
        drawn, tied = F.lit(True), F.lit(True)
        bounds: list[tuple[str, int]] = []
        for key in _ORDER:
            value, less, equal = cutoff(able.where(tied), key, need)
            bounds.append((key, value))
            need -= less
            tied = tied & (F.expr(key) == F.lit(value).cast("long"))
            if need == equal:
                break
        for last, (key, value) in reversed(list(enumerate(bounds))):
            bound = F.lit(value).cast("long")
            rest = F.expr(key) <= bound if last == len(bounds) - 1 else (F.expr(key) < bound) | ((F.expr(key) == bound) & drawn)
            drawn = rest
        drawn = (F.col("n_words") >= MIN_WORDS) & drawn
    ranked = numbered(scores.where(drawn), [F.expr(k) for k in _ORDER], "place")
    return scores.where(~drawn).withColumn("rank", F.lit(None).cast("long")).unionByName(
        ranked.withColumn("rank", F.col("place") + 1).drop("place"))
