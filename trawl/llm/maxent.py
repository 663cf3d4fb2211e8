"""Hashed maximum-entropy language model with a class-factored softmax.

log P(text) sums, over words and one end, log P(class | history) + log P(part | class,
history) + log P(word | class, part). Class 0 holds the most frequent tokens, each a part of
its own, and one part for words not seen in training; the other classes are words of like
last letters, their parts a hash of the word. Both softmaxes have hashed features of the last
word, the last two words, and the word before the last (a skip), for the parts joined with
the class. Their weights are trained by gradients that all tasks sum, over all training rows
in every round. Buckets and parts grow with the training tokens. Within a part a word's
weight is its count + 0.1.

Counts return to the words without a broadcast: scan tasks cut their rows into blocks, each
distinct word of a block goes once to its count and back. Words in features are told apart by
32 bits of their hashes; no other result of a text depends on its block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.arrays import binary_lists, chunks, hashed_words, mix, released, row_sums, text_buffer, trim
from trawl.llm.exact_dedup import with_rows
from trawl.llm.labelled import id_remainder
from trawl.session import remove_dir, scratch_dir

#: Text bytes of a block of rows; classes; frequent tokens that are parts of their own.
BLOCK_BYTES, CLASSES, SINGLES = 12 << 20, 16, 15
#: The part of unseen words; marks a word that was seen once, which stands for unseen ones in training.
UNKNOWN, ONCE = SINGLES, 1 << 15
#: Rounds of training; gradient step, which the features share; smoothing.
ROUNDS, STEP, SHRINK, ADD = 2, 0.5, 20.0, 0.1
#: Least bits of the features' hash buckets and of the parts of a class; training tokens above
#: which buckets grow (as their root) and parts (as the root of that); the most bits of both,
#: which bound the broadcast weights (3 * 2^18 rows of 16 + 64 numbers: 252 MB).
BITS, PART_BITS, GROW = 16, 4, 1e8
MOST_BITS, MOST_PART_BITS = 18, 6
#: About so many distinct words of all blocks are counted in one group; tokens of a sum.
PART_WORDS, LOT = 1 << 20, 1 << 18
#: Tokens whose weights stay in a core's cache.
PIECE = 1 << 13
#: Pieces that a level's gradients are summed in; log of the weight of parts without words.
SLICES, NEVER = 32, -100.0
END = 0x7F4A7C159E3779B9  # the end token's hash


def _with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of rows, an end after each row's words, and the rows' offsets."""
    h, ptr = hashed_words(data, offsets)
    out = np.insert(h, ptr[1:], np.uint64(END))
    return out, ptr + np.arange(len(ptr))


def _shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token of ``_with_ends``, a class of words by their last two bytes."""
    low = np.concatenate([[0, 0], np.where((data >= 65) & (data <= 90), data + 32, data)]).astype(np.uint64)
    space = np.isin(data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    last = ~space & np.concatenate([space[1:], [True]]) if len(data) else space
    if len(data):
        cut = offsets[1:] - 1
        cut = cut[cut >= 0]
        last[cut] |= ~space[cut]
    ends = np.flatnonzero(last)
    pair = low[ends + 2] | np.where(space[np.maximum(ends - 1, 0)] | (ends == 0), 0, low[ends + 1] << np.uint64(8))
    shape = (mix(pair.astype(np.uint64)) >> np.uint64(33)) % np.uint64(256)
    return np.insert(shape.astype(np.uint8), np.searchsorted(ends, offsets[1:]), 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts as positions in their block's list of distinct tokens, then the list."""
    part, block = TaskContext.get().partitionId(), 0
    empty = pa.nulls
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        held = batch.column(3).to_numpy(zero_copy_only=False)
        for lo, hi in chunks(offsets, BLOCK_BYTES):
            parts, shapes, ptrs, base = [], [], [np.zeros(1, np.int64)], 0
            for a, b in chunks(offsets[lo:hi + 1], 1 << 20):
                x, y = offsets[lo + a], offsets[lo + b]
                own = data[x:y]
                h, ptr = _with_ends(own, offsets[lo + a:lo + b + 1] - x)
                parts.append(h)
                shapes.append(_shapes(own, offsets[lo + a:lo + b + 1] - x))
                ptrs.append(ptr[1:] + base)
                base += len(h)
            h, shape, ptr = np.concatenate(parts), np.concatenate(shapes), np.concatenate(ptrs)
            words, first, at, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            train = np.bincount(at[np.repeat(~held[lo:hi], np.diff(ptr))], minlength=len(words))
            rank = np.argsort(-count, kind="stable")  # frequent tokens get small positions
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank), dtype=np.uint32)
            key = part << 20 | block
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key, np.int64)), *(batch.column(c).slice(lo, n) for c in (0, 1, 3)), binary_lists(place[at], ptr),
                 empty(n, pa.binary()), empty(n, pa.binary())], names=["block", "row", "id", "held_out", "at", "words", "counts"])
            packed = train[rank].astype(np.uint64) << np.uint64(8) | shape[first][rank].astype(np.uint64)  # count, shape
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), empty(1, pa.int64()), empty(1, pa.int64()), empty(1, pa.bool_()), empty(1, pa.binary()),
                 pa.array([words[rank].tobytes()], pa.binary()), pa.array([packed.tobytes()], pa.binary())],
                names=["block", "row", "id", "held_out", "at", "words", "counts"])
            block += 1


def part_bits(tokens: int) -> int:
    return min(PART_BITS + max(0, math.ceil(math.log2(max(tokens, 1) / GROW) / 4)), MOST_PART_BITS)


class Model:
    """Weights of both softmaxes (biases, then feature rows) and what words need."""

    def __init__(self, total: int, distinct: int, singles: list[tuple[int, int]], counts: np.ndarray, sums: np.ndarray):
        self.total, self.distinct, self.singles = total, distinct, singles
        self.sums = sums  # sum of (count + 0.1) over the words of a part; rows of counts and sums are classes
        self.parts = counts.shape[1]
        self.bits = min(BITS + max(0, math.ceil(math.log2(max(total, 1) / GROW) / 2)), MOST_BITS)
        per_class = counts.sum(1)
        self.bias = [np.log((per_class + 1.0) / (per_class.sum() + CLASSES)).astype(np.float32),
                     np.log((counts + 1.0) / (per_class[:, None] + self.parts)).astype(np.float32)]
        empty = sums == 0
        empty[0, UNKNOWN] = False
        self.bias[0][empty.all(1)] = self.bias[1][empty] = NEVER
        self.weights = [np.zeros((3 << self.bits, n), np.float32) for n in (CLASSES, self.parts)]

    def base(self) -> float:
        """log10 of the base model's denominator."""
        return math.log10(self.total + ADD * (self.distinct + 1))


def kinds_of(word: np.ndarray, shape: np.ndarray, count: np.ndarray, parts: int, singles: list[tuple[int, int]]) -> np.ndarray:
    """Class and part of distinct words as one number, ``class * parts + part``."""
    part = (mix(word) >> np.uint64(7)).astype(np.int64) % parts
    kind = (1 + shape % (CLASSES - 1)) * parts + part
    kind[count == 0] = UNKNOWN
    for k, (single, _) in enumerate(singles):
        kind[word.view(np.int64) == single] = k
    return kind


def _before(code: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last word and the one before it, for each token."""
    heads = ptr[:-1][ptr[:-1] < len(code)]
    one, two = np.zeros(len(code), np.uint64), np.zeros(len(code), np.uint64)
    one[1:] = code[:-1]
    one[heads] = 1
    two[1:] = one[:-1]
    two[heads] = 2
    return one, two


def _features(model: Model, code: np.ndarray, ptr: np.ndarray, kind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the weights of classes and of parts for each token, from the 32-bit codes of the
    tokens before and, for parts, the token's class: three buckets each."""
    one, two = _before(code, ptr)
    own = ((kind // model.parts).astype(np.uint64) + np.uint64(1)) << np.uint64(32)
    shift = np.uint64(32 - model.bits)
    classes, parts = [], []
    for key in (one, mix(one << np.uint64(32) | two) >> np.uint64(32), two):
        classes.append(key >> shift)
        parts.append(mix(own | key) >> np.uint64(32) >> shift)
    kept = np.uint16 if model.bits <= 16 else np.int64  # short numbers sort faster
    return [f.astype(kept) for f in classes], [f.astype(kept) for f in parts]


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted distinct keys by the part that counts them, and where parts begin."""
    part = (mix(keys) >> np.uint64(33)) % np.uint64(parts)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))])


_PACK = ("block", "what", "part", "keys", "kinds", "n")


def _packed(block: int, what: str, keys: np.ndarray, kinds: np.ndarray, n: np.ndarray, parts: int) -> dict[str, list]:
    """Rows of the distinct keys of a block (or of a group of counted pairs), one per part."""
    order, ptr = _dealt(keys, parts)
    used = np.flatnonzero(np.diff(ptr))
    cut = lambda x: [x[order[ptr[p]:ptr[p + 1]]].tobytes() for p in used]
    return dict(zip(_PACK, ([block] * len(used), [what] * len(used), used.tolist(), cut(keys), cut(kinds), cut(n))))


def _pack_table(rows: list[dict[str, list]]) -> pa.Table:
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c: pa.array([x for r in rows for x in r[c]], t) for c, t in zip(_PACK, types)})


_PACK_TYPE = "block long, what string, part long, keys binary, kinds binary, n binary"


def _read(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]


def _asked(parts: int):
    """The distinct tokens of each block, by the part that counts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, packed in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words, packed = np.frombuffer(words, np.uint64), np.frombuffer(packed, np.uint64)
                rows = _packed(block, "word", words, (packed & np.uint64(255)).astype(np.uint16), (packed >> np.uint64(8)).astype(np.int64), parts)
                yield from _pack_table([rows]).to_batches()

    return run


def _counted_words(table: pa.Table) -> pa.Table:
    """Counts of a part's tokens back to their blocks, and the tokens seen in training."""
    lists, blocks, part = _read(table, "keys", np.uint64), table.column("block").to_pylist(), table.column("part")[0].as_py()
    keys, first, at = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    c = np.bincount(at, np.concatenate(_read(table, "n", np.int64))).astype(np.int64)
    back, ends, none = c[at], np.cumsum([0, *map(len, lists)]), [b""] * len(blocks)
    seen = c > 0
    kinds = np.concatenate(_read(table, "kinds", np.uint16))[first]
    return _pack_table([
        dict(zip(_PACK, (blocks, ["count"] * len(blocks), [part] * len(blocks), none, none, [back[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]))),
        dict(zip(_PACK, ([-1], ["seen"], [part], [keys[seen].tobytes()], [kinds[seen].tobytes()], [c[seen].tobytes()])))])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per token seen in training."""
    for batch in batches:
        for words, shapes, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
            whole = pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(np.frombuffer(n, np.int64)),
                                                pa.array(np.frombuffer(shapes, np.uint16).astype(np.int16))], names=["word", "c", "shape"])
            yield from (whole.slice(lo, 1 << 16) for lo in range(0, whole.num_rows, 1 << 16))


def _by_kind(parts: int):
    """Tokens seen in training to sums by class and part: count, words, words seen once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, CLASSES * parts), np.int64)
        for batch in batches:
            word, c, shape = (batch.column(k).to_numpy() for k in range(3))
            kind = kinds_of(word.view(np.uint64), shape.astype(np.int64), c, parts, [])
            for k, x in enumerate((c, np.ones(len(c)), c == 1)):
                total[k] += np.bincount(kind, x, CLASSES * parts).astype(np.int64)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], names=["kind", "c", "v", "once"])

    return run


def _scores(model: Model, level: int, rows: list[np.ndarray], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the weights of all classes (level 0), or of all parts of the token's class (level
    1), and their sums."""
    w, step = model.weights[level], 1 << model.bits
    z = w[:step].take(rows[0], axis=0)
    for k in (1, 2):
        z += w[k * step:(k + 1) * step].take(rows[k], axis=0)
    z += model.bias[0] if level == 0 else model.bias[1].take(kind // model.parts, axis=0)
    np.exp(z, out=z)  # weights are at most 3 a round: no overflow
    return z, z @ np.ones(z.shape[1], np.float32)


def _joined(shared, parts: int):
    """Rows of a block with its tokens' counts: per row the base sums, the sum of the words'
    weights within their parts, and coded tokens."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()  # of the block before
        model: Model = shared.value
        at = [np.frombuffer(x, np.uint32) for x in left.column("at").to_pylist()]
        ptr = np.cumsum([0, *map(len, at)])
        lines = right.sort_by("part").to_pylist()
        own = next(r for r in lines if r["what"] == "word")
        word = np.frombuffer(own["keys"], np.uint64)
        shape = (np.frombuffer(own["n"], np.uint64) & np.uint64(255)).astype(np.int64)
        count = np.empty(len(word), np.int64)
        count[_dealt(word, parts)[0]] = np.frombuffer(b"".join(r["n"] for r in lines if r["what"] == "count"), np.int64)
        kind = kinds_of(word, shape, count, model.parts, model.singles)
        inside = np.where(kind > UNKNOWN, np.log10((count + ADD) / np.maximum(model.sums.reshape(-1)[kind], ADD)), 0.0)
        coded = (kind | np.where(count == 1, ONCE, 0)).astype(np.uint16)
        code = (mix(word) >> np.uint64(32)).astype(np.uint32)
        flat = np.concatenate(at) if at else np.zeros(0, np.uint32)
        return pa.table({
            "row": left.column("row"), "id": left.column("id"), "held_out": left.column("held_out"), "n_tokens": pa.array(np.diff(ptr)),
            "n_known": pa.array(row_sums((count > 0)[flat], ptr).astype(np.int64)),
            "base": pa.array(row_sums((np.log10(count + ADD) - model.base())[flat], ptr)), "inside": pa.array(row_sums(inside[flat], ptr)),
            "codes": binary_lists(code[flat], ptr), "kinds": binary_lists(coded[flat], ptr)})

    return run


def _tokens(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` tokens: (first, end, codes, kinds, offsets)."""
    codes = batch.column(batch.schema.get_field_index("codes")).to_pylist()
    kinds = batch.column(batch.schema.get_field_index("kinds")).to_pylist()
    for lo, hi in chunks(np.cumsum([0, *(len(k) // 2 for k in kinds)]), most):
        yield (lo, hi, np.frombuffer(b"".join(codes[lo:hi]), np.uint32), np.frombuffer(b"".join(kinds[lo:hi]), np.uint16),
               np.cumsum([0, *(len(k) // 2 for k in kinds[lo:hi])]))


def _gradients(shared):
    """Summed gradients of all rows of a task, cut into slices of the weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        step = 1 << model.bits
        grads = [np.zeros((w.shape[1] + 1, 3 * step), np.float32) for w in model.weights]  # a row a class; last: how often

        def learn(code, coded, ptr):
            kind = np.where(coded >= ONCE, UNKNOWN, coded).astype(np.int64)
            both = _features(model, code, ptr, kind)
            for level, target in enumerate((kind // model.parts, kind % model.parts)):
                grad, n = grads[level], model.weights[level].shape[1]
                p = np.empty((n, len(kind)), np.float32)
                for lo in range(0, len(kind), PIECE):
                    z, total = _scores(model, level, [f[lo:lo + PIECE] for f in both[level]], kind[lo:lo + PIECE])
                    z /= total[:, None]
                    p[:, lo:lo + PIECE] = z.T
                for k, row in enumerate(both[level]):
                    own = grad[:, k * step:(k + 1) * step]
                    row = row.astype(np.int64)
                    own[-1] += np.bincount(row, minlength=step)
                    own[:-1] += np.bincount(row * n + target, minlength=n * step).reshape(step, n).T
                    for c in range(n):
                        own[c] -= np.bincount(row, p[c], step)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += sum(batch.column(k).nbytes for k in (0, 1))
            if size >= 6 * LOT:
                for _, _, code, coded, ptr in _tokens(_one(held), LOT):
                    learn(code, coded, ptr)
                held, size = [], 0
        if held:
            for _, _, code, coded, ptr in _tokens(_one(held), LOT):
                learn(code, coded, ptr)
        for level, grad in enumerate(grads):
            for k, part in enumerate(np.array_split(np.ascontiguousarray(grad.T), SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([level * SLICES + k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "grad"])

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("grad").to_pylist())
    return pa.table({"slice": table.column("slice")[:1], "grad": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _stepped(model: Model, level: int, k: int, grad: np.ndarray) -> None:
    """One update of a slice of a level's weights: mean gradients over a diagonal curvature."""
    grad = grad.reshape(-1, model.weights[level].shape[1] + 1)
    prior = (np.exp(model.bias[0]) if level == 0 else np.full(model.parts, 1.0 / model.parts)).astype(np.float32)
    mean = np.float32(STEP) * grad[:, :-1] / (grad[:, -1:] + np.float32(SHRINK))
    own = np.array_split(model.weights[level], SLICES)[k]  # a view
    own += np.clip(mean / (prior * (1 - prior) + np.float32(0.02)), -3, 3)


def _scored(shared):
    """Rows of a task to their scores: what is inside parts, and the trained classes and parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            out = batch.column(batch.schema.get_field_index("inside")).to_numpy().copy()
            for lo, hi, code, coded, ptr in _tokens(batch, LOT):
                kind = (coded & (ONCE - 1)).astype(np.int64)
                both = _features(model, code, ptr, kind)
                logs = np.zeros(len(kind), np.float64)
                for level, target in enumerate((kind // model.parts, kind % model.parts)):
                    for at in range(0, len(kind), PIECE):
                        z, total = _scores(model, level, [f[at:at + PIECE] for f in both[level]], kind[at:at + PIECE])
                        own = z[np.arange(len(z)), target[at:at + PIECE]]
                        logs[at:at + PIECE] += np.log(np.maximum(own, np.float32(1e-38)) / total)
                out[lo:hi] += row_sums(logs, ptr) / math.log(10)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "held_out", "n_tokens", "n_known", "base")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=["id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs planned inside go when their job ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame, path: str, *by: str) -> DataFrame:
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _trained(docs: DataFrame, id_col: str, text_col: str, mod: int, held_out: int):
    """The model and its broadcast, the coded rows, and what blocks need to score their pairs."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "maxent")
    rows = with_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows = rows.select("row_id", "id", "text", (id_remainder("id", mod) == held_out).alias("held_out"))
    blocks = _written(rows.mapInArrow(_blocks, "block long, row long, id long, held_out boolean, at binary, words binary, counts binary"), f"{path}/blocks")
    words = blocks.where("words is not null").select("block", "words", "counts")
    parts = (words.agg(F.sum(F.length("words"))).first()[0] or 0) // (8 * PART_WORDS) + 16
    counted = _written(words.mapInArrow(_asked(parts), _PACK_TYPE).groupBy("part").applyInArrow(_counted_words, _PACK_TYPE), f"{path}/counts", "what")
    counts = counted.where("what = 'seen'").select("keys", "kinds", "n").mapInArrow(_listed, "word long, c long, shape short")

    top = counts.orderBy(F.desc("c"), "word").limit(SINGLES).collect()
    singles = [(r.word, r.c) for r in top]
    tokens = counts.agg(F.sum("c")).first()[0] or 0
    parts_of = 1 << part_bits(tokens)
    rest = counts.where(~F.col("word").isin([w for w, _ in singles])) if singles else counts
    found = rest.mapInArrow(_by_kind(parts_of), "kind long, c long, v long, once long").groupBy("kind").agg(
        *(F.sum(c).alias(c) for c in ("c", "v", "once"))).collect()  # a row a part
    n, sums = np.zeros(CLASSES * parts_of), np.zeros(CLASSES * parts_of)
    for k, (_, c) in enumerate(singles):
        n[k], sums[k] = c, c + ADD
    for r in found:
        n[r["kind"]], sums[r["kind"]] = r.c - r.once, r.c + ADD * r.v
        n[UNKNOWN] += r.once
    model = Model(sum(c for _, c in singles) + sum(r.c for r in found), len(singles) + sum(r.v for r in found), singles,
                  n.reshape(CLASSES, -1), sums.reshape(CLASSES, -1))

    shared = spark.sparkContext.broadcast(model)
    own = words.select("block", F.lit("word").alias("what"), F.lit(0).cast("long").alias("part"), F.col("words").alias("keys"), F.col("counts").alias("n"))
    back = own.unionByName(counted.where("what = 'count'").select(own.columns))
    texts = blocks.where("at is not null").select("block", "row", "id", "held_out", "at")
    coded = _written(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _joined(shared, parts), "row long, id long, held_out boolean, n_tokens long, n_known long, base double, inside double, codes binary, kinds binary"), f"{path}/coded")
    remove_dir(spark, f"{path}/blocks")  # only `coded` is read from here on
    remove_dir(spark, f"{path}/counts")

    for turn in range(ROUNDS):
        # one sum of gradients per core, however many files there are
        slices = (coded.where(~F.col("held_out")).select("codes", "kinds")
                  .coalesce(spark.sparkContext.defaultParallelism).mapInArrow(released(_gradients(shared)), "slice int, grad binary").withColumn("lot", F.spark_partition_id() % 16))
        slices = slices.groupBy("slice", "lot").applyInArrow(_added, "slice int, grad binary")
        # written, so that shuffle files go; then read in pieces, together the size of the weights
        slices.groupBy("slice").applyInArrow(_added, "slice int, grad binary").write.parquet(f"{path}/round-{turn}")
        for r in spark.read.parquet(f"{path}/round-{turn}").toLocalIterator():
            level, k = divmod(r["slice"], SLICES)
            _stepped(model, level, k, np.frombuffer(r["grad"], np.float32))
        remove_dir(spark, f"{path}/round-{turn}")
        shared.unpersist()
        shared = spark.sparkContext.broadcast(model)

    return model, shared, coded


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from rows whose crc32(id as text) mod ``mod`` is not ``held_out``
    (null ids count as held out). Null and empty texts have one token, the end. Repeated
    rows are all counted and all scored; other columns are not read; an empty table gives
    no rows. Words are told apart by 64-bit hashes.
    """
    with _cleaned(docs.sparkSession):
        model, shared, coded = _trained(docs, id_col, text_col, mod, held_out)
    return (coded.mapInArrow(released(_scored(shared)), "id long, held_out boolean, n_tokens long, n_known long, base double, score double")
            .select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"),
                    F.col("base").alias("base_score"), "score"))
