"""Quality classifier: logistic regression on hashed word 1- and 2-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrays import mix, row_sums, word_rows
from trawl.llm.labelled import labelled_sample
from trawl.session import scratch_dir

BITS = 18
#: Most labelled documents that the model is fitted on; shards that fit in parallel, and
#: rounds after which their states are averaged.
SAMPLE, SHARDS, ROUNDS = 16_000, 4, 4
ALPHA, BETA, L1, L2 = 10.0, 0.2, 0.01, 0.01


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, feature indices, offsets): each row's distinct hashed 1- and
    2-grams. Empty texts have none."""
    shift = np.uint64(64 - BITS)
    for lo, hi, h, ptr in word_rows(texts):
        row = np.repeat(np.arange(hi - lo), np.diff(ptr))
        pair = mix(h[:-1] * np.uint64(3) + h[1:])[row[:-1] == row[1:]] if len(h) > 1 else h[:0]
        grams = np.concatenate([h, pair]) >> shift
        rows = np.concatenate([row, row[:-1][row[:-1] == row[1:]]]) if len(h) > 1 else row
        key = np.unique((rows.astype(np.int64) << BITS) | grams.astype(np.int64))
        yield lo, hi, key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) << BITS)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal state over hashed features; the last coordinate is the intercept."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, 1 << BITS)
        x = np.full(len(at), 1.0 / np.sqrt(max(1, len(at) - 1)))
        x[-1] = 0.3
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _round(state, turn: int):
    """One shard's pass: from the broadcast state over its rows, in an order drawn by turn."""
    def shard(table: pa.Table) -> pa.Table:
        own = Ftrl()
        own.z, own.n = state.value[0].copy(), state.value[1].copy()
        table = table.sort_by("doc_id")
        at = [np.frombuffer(x, "<i4") for x in table.column("at").to_pylist()]
        labels = table.column("label").to_pylist()
        for k in np.random.default_rng(turn).permutation(len(at)):
            own.update(at[k], labels[k])
        return pa.table({"rows": pa.array([len(at)], pa.int64()), "z": pa.array([own.z.tobytes()], pa.binary()),
                         "n": pa.array([own.n.tobytes()], pa.binary())})

    return shard


def fit(sample: DataFrame) -> np.ndarray:
    """Weights (float32, 2^BITS + 1) fitted on (doc_id, text, label).

    In each round every shard runs FTRL over its rows from the common state, and the
    shards' states are averaged by their row counts. No rows: all zero.
    """
    spark = sample.sparkSession

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [at[ptr[i]:ptr[i + 1]].astype("<i4").tobytes() for lo, hi, at, ptr in features(batch.column(2)) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "at"])

    path = scratch_dir(spark, "features")
    sample.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(
        featured, "doc_id long, label int, at binary").write.parquet(path)
    rows = spark.read.parquet(path).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)))
    model = Ftrl()
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((model.z, model.n))  # 4 MB

        found = rows.groupBy("shard").applyInArrow(_round(state, turn), "rows long, z binary, n binary").collect()  # SHARDS rows of 4 MB
        total = sum(r.rows for r in found)
        if not total:
            break
        model.z = sum(np.frombuffer(r.z) * (r.rows / total) for r in found)
        model.n = sum(np.frombuffer(r.n) * (r.rows / total) for r in found)
        state.unpersist()
    return model.weights().astype(np.float32)


def quality_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1.

    Empty and null texts have the intercept's score; repeated rows and null ids stay; only
    doc_id and text are read. ``weights``: as given by ``fit``; 1 MB, broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, at, ptr in features(batch.column(1)):
                out[lo:hi] = row_sums(w[at], ptr) / np.sqrt(np.maximum(1, np.diff(ptr)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(out + 0.3 * float(w[-1])))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, most: int = SAMPLE) -> DataFrame:
    """Fit on labels outside the held-out remainder, then score every row of ``docs``.

    Null and empty texts have no features and get the intercept's score; repeated rows and
    null ids are scored each; without labels the model is the one before training; an empty
    table gives no rows. Columns other than id and text are not read.
    """
    return quality_scores(docs, fit(labelled_sample(docs, labels, "quality", mod, held_out, most)))
