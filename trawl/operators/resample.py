"""Bootstrap resamples as counts, for metrics that are Python functions.

A resample of n rows is how often each row was drawn. Rows lie in blocks of BLOCK; the draws of
a resample are split down a binary tree of blocks by seeded binomials, then dealt inside the
block, so every task finds the counts of its own rows alone. No draw is a row, and what leaves
a task is one state per resample.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators.util import dense_index

BLOCK = 4096
#: Values that a metric without states may see at once (8 bytes each).
MOST_VALUES = 8_000_000


@dataclass(frozen=True)
class Metric:
    """A metric whose states merge.

    ``state(values, counts)`` gives a fixed number of numbers for some rows of a resample,
    ``merge(a, b)`` joins two states (their sum unless given), ``finish(state)`` gives the
    metric.
    """

    state: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add


MEAN = Metric(lambda v, c: np.array([np.dot(v, c), c.sum()], float), lambda s: s[0] / s[1])


def is_counts_metric(fn) -> bool:
    """Whether ``fn`` is a Metric or a Python function of (values, counts)."""
    if isinstance(fn, Metric):
        return True
    try:
        needed = [p for p in inspect.signature(fn).parameters.values() if p.default is p.empty and p.kind != p.VAR_KEYWORD]
    except (TypeError, ValueError):
        return False
    return len(needed) == 2


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def draws_in_block(n: int, block: int, resample: int, seed: int) -> int:
    """How many of a resample's n draws fall in a block of rows."""
    lo, hi, draws = 0, -(-n // BLOCK), n
    while hi - lo > 1 and draws:
        mid = (lo + hi) // 2
        rows, left = min(hi * BLOCK, n) - lo * BLOCK, (mid - lo) * BLOCK
        first = int(_rng(seed, resample, lo, hi).binomial(draws, left / rows))
        lo, hi, draws = (lo, mid, first) if block < mid else (mid, hi, draws - first)
    return draws


def block_counts(n: int, block: int, resample: int, seed: int) -> np.ndarray:
    """How often a resample draws each row of a block."""
    size = min(n - block * BLOCK, BLOCK)
    draws = draws_in_block(n, block, resample, seed)
    return np.bincount(_rng(seed, resample, block).integers(0, size, draws), minlength=size)


def _states(n: int, resamples: int, seed: int, metric: Metric):
    """Blocks of rows to one state per resample and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list = [None] * resamples
        idx, v = [], []
        for batch in batches:
            idx.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
        if not idx:
            return
        idx, v = np.concatenate(idx), np.concatenate(v)
        order = np.argsort(idx)
        idx, v = idx[order], v[order]
        blocks, starts = np.unique(idx // BLOCK, return_index=True)
        for block, values in zip(blocks.tolist(), np.split(v, starts[1:])):
            for b in range(resamples):
                mine = np.asarray(metric.state(values, block_counts(n, block, b, seed)), float)
                states[b] = mine if states[b] is None else metric.merge(states[b], mine)
        yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int64()), pa.array([s.tolist() for s in states], pa.list_(pa.float64()))],
                                         names=["b", "state"])

    return run


def _finished(metric: Metric):
    def run(table: pa.Table) -> pa.Table:
        states = [np.array(s) for s in table.column("state").to_pylist()]
        total = states[0]
        for s in states[1:]:
            total = metric.merge(total, s)
        return pa.table({"b": table.column("b")[:1], "m": pa.array([float(metric.finish(total))])})

    return run


def _whole(n: int, seed: int, fn, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        for batch in batches:
            found = []
            for b in batch.column(0).to_pylist():
                counts = np.concatenate([block_counts(n, k, b, seed) for k in range(-(-n // BLOCK))])
                found.append(float(fn(values, counts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["b", "m"])

    return run


def resampled_metric(vals: DataFrame, n: int, metric, n_resamples: int, seed: int) -> DataFrame:
    """``b, m``: the metric of every resample of ``vals`` (``qid, v``; n rows, in the order of qid).

    A ``Metric`` is computed where the rows are: a task holds its rows and one state per
    resample. A plain function of (values, counts) needs all values at once: they are
    broadcast, up to MOST_VALUES of them, and the resamples are dealt over tasks.
    """
    spark = vals.sparkSession
    indexed = dense_index(vals, "qid", "idx").select("idx", "v")
    if isinstance(metric, Metric):
        dealt = indexed.repartition(F.floor(F.col("idx") / BLOCK))
        states = dealt.mapInArrow(_states(n, n_resamples, seed, metric), "b long, state array<double>")
        return states.groupBy("b").applyInArrow(_finished(metric), "b long, m double")
    if n > MOST_VALUES:
        raise ValueError(f"a function of all values sees at most {MOST_VALUES} of them, not {n}: give a Metric, whose states merge")
    rows = indexed.orderBy("idx").toArrow()  # at most MOST_VALUES numbers
    shared = spark.sparkContext.broadcast(rows.column("v").to_numpy())
    return (spark.range(0, n_resamples, 1, min(n_resamples, 4 * spark.sparkContext.defaultParallelism))
            .mapInArrow(_whole(n, seed, metric, shared), "b long, m double"))


def original_metric(vals: DataFrame, metric) -> float:
    """The metric of the rows themselves, every row once."""
    if not isinstance(metric, Metric):
        values = vals.orderBy("qid").select("v").toArrow().column("v").to_numpy()
        return float(metric(values, np.ones(len(values), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = batch.column(0).to_numpy()
            if len(v):
                mine = np.asarray(metric.state(v, np.ones(len(v), np.int64)), float)
                total = mine if total is None else metric.merge(total, mine)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["b", "state"])

    states = vals.select("v").mapInArrow(run, "b long, state array<double>")
    return states.groupBy("b").applyInArrow(_finished(metric), "b long, m double").first()["m"]
