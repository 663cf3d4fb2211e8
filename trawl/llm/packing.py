"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's full windows are cut off first. The remainders of a group of documents are
dealt to as many windows as their tokens need: starting from one partial partition per
remainder, the two most uneven partitions are merged again and again, the larger sums of
one with the smaller sums of the other, which leaves near-equal windows. Where a window
still exceeds the capacity, its overhang is cut off and laid into windows with room; if
there is no room left (or cutting is off), the number of windows rises.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a group of documents that is packed in one task.
GROUP_BYTES = 3 << 20
Piece = tuple[int, int, int]  # document, start, length


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items dealt to k sets of near-equal sums: the sets' item numbers.

    A partial partition is a list of (sum over the least, items as a nested pair),
    largest first; sets that are not listed are empty.
    """
    if not sizes or k < 1:
        return [[] for _ in range(max(k, 0))]
    ticket = count()
    heap = [(-size, next(ticket), [(size, item)]) for item, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= k:
            merged = sorted(a + b, key=lambda s: -s[0])
        else:
            a = a + [(0, None)] * (k - len(a))
            b = b + [(0, None)] * (k - len(b))
            merged = sorted(((x + y, (s, t) if s is not None and t is not None else t if s is None else s)
                             for (x, s), (y, t) in zip(a, reversed(b))), key=lambda s: -s[0])
            least = merged[-1][0]
            if least:
                merged = [(x - least, s) for x, s in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, next(ticket), merged))
    sets = []
    for _, nested in heap[0][2]:
        items, todo = [], [nested]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                items.append(x)
        sets.append(sorted(items))
    return sets + [[] for _ in range(k - len(sets))]


def pack_lengths(lengths: list[int], capacity: int = 2048, cut: bool = True) -> list[list[Piece]]:
    """Windows of pieces (document number, start, length). Every token lies in one piece;
    documents of no tokens lie in none."""
    windows = [[(d, w * capacity, capacity)] for d, n in enumerate(lengths) for w in range(n // capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    sizes = [r[2] for r in rest]
    k = -(-sum(sizes) // capacity)
    while rest:
        dealt = [[rest[i] for i in s] for s in differencing(sizes, k)]
        if cut:
            dealt = _level(dealt, capacity)
        if all(sum(p[2] for p in w) <= capacity for w in dealt):
            windows += [w for w in dealt if w]
            break
        k += 1
    return windows


def _level(dealt: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cut what exceeds the capacity and lay it into windows with room, fullest first."""
    over: list[Piece] = []
    for w in dealt:
        excess = sum(p[2] for p in w) - capacity
        while excess > 0:
            d, start, n = w.pop()
            part = min(n, excess)
            over.append((d, start + n - part, part))
            if n > part:
                w.append((d, start, n - part))
            excess -= part
    for w in sorted(dealt, key=lambda w: -sum(p[2] for p in w)):
        room = capacity - sum(p[2] for p in w)
        while room > 0 and over:
            d, start, n = over.pop()
            part = min(n, room)
            w.append((d, start, part))
            if n > part:
                over.append((d, start + part, n - part))
            room -= part
    if over:
        dealt[-1] += over  # more than all room: the caller adds a window
    return dealt


def groups_for(docs: DataFrame, text_col: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups of about ``group_bytes`` the texts of ``docs`` make."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / group_bytes))


def pack(encoded: DataFrame, groups: int, dtype: str = "<u2", capacity: int = 2048, cut: bool = True) -> DataFrame:
    """Pieces of windows: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``encoded`` has doc_id, row_id (tells repeated ids apart), ids (binary of ``dtype``).
    Rows are dealt to ``groups`` by a hash of row_id, so no id, source or text makes a
    group large; each group is packed in one task, and pads less than one window in all.
    ``ids`` of a piece are little-endian unsigned 32-bit. Rows without ids give no piece;
    other columns are not read.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        group = table.column("group")[0].as_py()
        docs = table.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, dtype).astype("<u4") for x in table.column("ids").to_pylist()]
        rows = [(docs[d], start, n, ids[d][start:start + n].tobytes(), len(ids[d]), (group << 24) + s, offset)
                for s, window in enumerate(pack_lengths([len(x) for x in ids], capacity, cut))
                for (d, start, n), offset in zip(window, np.cumsum([0, *(p[2] for p in window[:-1])]).tolist())]
        columns = list(zip(*rows)) or [()] * 7
        types = [table.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({f: pa.array(c, t) for f, c, t in zip(
            ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"), columns, types)})

    keyed = encoded.select("doc_id", "row_id", "ids", F.pmod(F.xxhash64("row_id"), F.lit(groups)).alias("group"))
    return keyed.groupBy("group").applyInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, "
        "doc_tokens long, sequence_id long, offset long")
