"""Numpy helpers shared by the corpus operators: texts as byte buffers, words as 64-bit hashes.

A word is a maximal run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. Its
hash is a sum of random byte codes times powers of an odd base (mod 2^64), taken from one
running sum over the buffer, then mixed. No Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240611)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CODE = _CODE[_LOWER]  # A-Z share the codes of a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` that gives freed memory back before and after a task: Python workers live on, and
    what they keep would add up over the jobs of a pipeline."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return task


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows of about ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and where each row's words begin (rows + 1 entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODE[data] * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def word_rows(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets) for runs of rows of about ``most`` bytes."""
    data, offsets = text_buffer(texts)
    for lo, hi in chunks(offsets, most):
        a, b = offsets[lo], offsets[hi]
        h, ptr = hashed_words(data[a:b], offsets[lo:hi + 1] - a)
        yield lo, hi, h, ptr


def row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each row's slice values[ptr[i]:ptr[i + 1]] (empty: 0)."""
    if len(values) == 0:
        return np.zeros(len(ptr) - 1)
    full = np.append(values.astype(np.float64), 0.0)
    sums = np.add.reduceat(full, ptr[:-1])
    sums[ptr[1:] == ptr[:-1]] = 0.0
    return sums


def binary_lists(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[ptr[i]:ptr[i + 1]]."""
    offsets = (np.asarray(ptr, np.int64) * values.dtype.itemsize)
    data = np.ascontiguousarray(values).tobytes()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ptr) - 1,
                                            [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
