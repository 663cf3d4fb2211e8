"""Near-duplicate documents by min-max hashing of word shingles.

Under each permutation both the least and the greatest shingle value are kept, so half
the hash evaluations give a signature of the same length. Bands of two permutations (four
values) name buckets. The documents of a bucket are first compared with its pivot, the
document that shares the most buckets with others (in a group of near copies mostly their
original), on full shingle sets. Where links have not joined all of a bucket, what is left
over is compared with everything that shares a bucket with it, in blocks of bounded size
that return links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrays import binary_lists, mix, released, word_rows
from trawl.llm.components import components
from trawl.llm.exact_dedup import kept_rows, with_rows
from trawl.llm.skew import join_sized
from trawl.session import remove_dir, scratch_dir

#: Words of a shingle, least similarity in hundredths, permutations, and permutations of a band.
WORDS, SIMILARITY, PERMUTATIONS, BAND = 5, 75, 80, 2
#: Documents of a block in the comparison of what pivots have not joined.
CHUNK = 512
_RNG = np.random.default_rng(977)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_A = (_RNG.integers(1, 2**31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows.

    Fewer words than a shingle: the whole sequence is one; no words: an empty set.
    """
    for lo, hi, h, ptr in word_rows(texts):
        n = np.diff(ptr)
        wide = max(0, len(h) - WORDS + 1)
        total = np.zeros(wide, np.uint64)
        for j in range(WORDS):
            total += h[j:j + wide] * _PLACE[j]
        full = mix(total)
        sets = []
        for k in range(hi - lo):
            if n[k] >= WORDS:
                sets.append(np.unique(full[ptr[k]:ptr[k + 1] - WORDS + 1]))
            else:
                own = h[ptr[k]:ptr[k + 1]]
                sets.append(mix((own * _PLACE[:len(own)]).sum(keepdims=True, dtype=np.uint64) + _PLACE[8 + len(own)]) if n[k] else own)
        yield lo, sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, 2): the least and the greatest value under each permutation."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    most = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 1 << 14):
        v = _A[:, None] * x[None, at:at + (1 << 14)] + _B[:, None]
        np.minimum(least, v.min(1), out=least)
        np.maximum(most, v.max(1), out=most)
    return np.stack([least, most], 1)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band of a signature."""
    bands = sig.astype(np.uint64).reshape(PERMUTATIONS // BAND, 2 * BAND)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for j in range(2 * BAND):
        key = mix(key * _PLACE[9] + bands[:, j])
    return key.astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, sets in shingle_sets(batch.column(2)):
            part = batch.slice(lo, len(sets))
            first = np.array([s.sum(dtype=np.uint64) for s in sets]).astype(np.int64)
            second = np.array([mix(s ^ _PLACE[7]).sum(dtype=np.uint64) for s in sets]).astype(np.int64)
            keys = [bucket_keys(signature(s)).tolist() if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(second),
                 pa.array(keys, pa.list_(pa.int64()))], names=["row", "id", "n", "print1", "print2", "keys"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, sets in shingle_sets(batch.column(1)):
            ptr = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), binary_lists(np.concatenate(sets), ptr)], names=["row", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their full sets, those similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= SIMILARITY * (len(both) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the left-over rows of one chunk (part 0) and the rows of another
    (part 1), or among themselves where there is no other."""
    part, comp, row = (table.column(c).to_numpy() for c in ("part", "comp", "row"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    n = np.array([len(x) for x in sets])
    ours = np.flatnonzero(part == 0)
    theirs = np.flatnonzero(part == 1) if table.column("same")[0].as_py() is False else ours
    theirs = theirs[np.argsort(n[theirs], kind="stable")]
    sizes = n[theirs]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([sets[t] for t in theirs]) if len(theirs) else np.zeros(0, np.uint64)
    u, v = [], []
    for x in ours:
        lo = int(np.searchsorted(sizes * 100, SIMILARITY * n[x]))  # smaller sets can't be similar enough
        hi = int(np.searchsorted(sizes * SIMILARITY, 100 * n[x], "right"))
        if lo >= hi:
            continue
        near = flat[ptr[lo]:ptr[hi]]
        hit = sets[x][np.minimum(np.searchsorted(sets[x], near), n[x] - 1)] == near
        common = np.add.reduceat(hit.astype(np.int64), ptr[lo:hi] - ptr[lo])
        for t in theirs[lo:hi][100 * common >= SIMILARITY * (n[x] + sizes[lo:hi] - common)]:
            if comp[t] != comp[x]:
                u.append(row[x])
                v.append(row[t])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _left_over(members: DataFrame, joined: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """Links (u, v) among the rows of buckets that ``joined`` has not made one component.

    Rows outside the component of their bucket's pivot are put together with all rows of
    the buckets of that component; each of them is compared with all these.
    """
    state = members.join(joined, F.col("row") == F.col("node"), "left").select(
        "key", "row", "n", "degree", F.coalesce("component", "row").alias("comp"))
    buckets = state.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("comp").alias("a"), F.max("comp").alias("b"),
        F.max_by("comp", F.struct("degree", "row")).alias("home"))
    # a bucket of two was compared as pivot and other
    open_buckets = buckets.where("a < b and size > 2").select("key", "home")
    rows = state.join(open_buckets, "key").select("home", "row", "comp", (F.col("comp") != F.col("home")).alias("out")).distinct()
    rows.write.parquet(f"{path}/left")
    rows = members.sparkSession.read.parquet(f"{path}/left")
    size = rows.groupBy("home").agg(
        F.ceil(F.sum(F.col("out").cast("long")) / CHUNK).cast("int").alias("outs"),
        F.ceil(F.sum((~F.col("out")).cast("long")) / CHUNK).cast("int").alias("ins"))
    placed = rows.join(size, "home").withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))

    def steps(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    # left-over chunk i against left-over chunk j >= i (side 0) and against chunk j of the others (side 1)
    among = F.transform(steps("outs"), lambda j: F.struct(
        F.least(F.col("own"), j).alias("i"), F.lit(0).alias("side"), F.greatest(F.col("own"), j).alias("j"),
        F.when(F.col("own") <= j, 0).otherwise(1).alias("part"), (F.col("own") == j).alias("same")))
    against = F.transform(steps("ins"), lambda j: F.struct(
        F.col("own").alias("i"), F.lit(1).alias("side"), j.alias("j"), F.lit(0).alias("part"), F.lit(False).alias("same")))
    joined_by = F.transform(steps("outs"), lambda i: F.struct(
        i.alias("i"), F.lit(1).alias("side"), F.col("own").alias("j"), F.lit(1).alias("part"), F.lit(False).alias("same")))
    work = placed.select("home", "row", "comp", F.explode(F.when(F.col("out"), F.concat(among, against)).otherwise(joined_by)).alias("w"))
    work = work.select("home", "row", "comp", "w.*").join(sets, "row")
    return work.groupBy("home", "i", "side", "j").applyInArrow(_block_links, "u long, v long")


def _alike(n: str, m: str):
    """Set sizes that allow the similarity: the smaller at least that share of the larger."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, n_shingles, component_id, kept.

    Rows whose sets are equal are one node; nodes are linked when their sets are similar
    enough; component_id is the smallest id that links reach. Null and empty texts have
    no shingles and are linked with nothing (component_id is their own id). Null ids come
    last in the order of ids; of repeated ids the first row is kept. Other columns are
    not read.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "near")
    rows = with_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows.select("row_id", "id", "text").mapInArrow(
        released(_signed), "row long, id long, n long, print1 long, print2 long, keys array<long>").write.parquet(f"{path}/signed")
    signed = spark.read.parquet(f"{path}/signed")
    prints = ["n", "print1", "print2"]
    nodes = signed.where("n > 0").groupBy(*prints).agg(F.min_by(F.struct("row", "keys"), "row").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes.select(*prints, "copies", "first.row", "first.keys").write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")

    keyed = nodes.select("row", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed.join(shared, "key").write.parquet(f"{path}/shared")
    members = spark.read.parquet(f"{path}/shared")
    degree = members.groupBy("row").agg(F.sum(F.col("size") - 1).alias("degree"))
    members.drop("size").join(degree, "row").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    wanted = members.select("row").distinct()
    rows.select(F.col("row_id").alias("row"), "text").join(wanted, "row", "left_semi").mapInArrow(
        released(_full_sets), "row long, shingles binary").write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")

    pivots = members.groupBy("key").agg(F.max_by(F.struct("row", "n"), F.struct("degree", "row")).alias("p"))
    pairs = members.join(pivots, "key").where((F.col("row") != F.col("p.row")) & _alike("n", "p.n")).select(
        F.least("row", "p.row").alias("u"), F.greatest("row", "p.row").alias("v")).distinct()
    full = pairs.join(sets.select(F.col("row").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("row").alias("v"), F.col("shingles").alias("b")), "v")
    full.select("u", "v", "a", "b").mapInArrow(released(_linked), "u long, v long").write.parquet(f"{path}/links/0")
    first = components(spark.read.parquet(f"{path}/links/0"), f"{path}/stars/0")
    _left_over(members, first, sets, path).write.parquet(f"{path}/links/1")
    components(spark.read.parquet(f"{path}/links/0", f"{path}/links/1"), f"{path}/stars/1").write.parquet(f"{path}/joined")
    for done in ("shared", "members", "sets", "left", "links", "stars"):  # only signed, nodes and joined are read from here on
        remove_dir(spark, f"{path}/{done}")
    joined = spark.read.parquet(f"{path}/joined")

    nodes.join(joined, F.col("row") == F.col("node"), "left").select(*prints, "copies", F.coalesce("component", "row").alias("comp")).write.parquet(f"{path}/comps")
    labelled = join_sized(signed.where("n > 0").drop("keys"), spark.read.parquet(f"{path}/comps"), prints, "copies").select("row", "id", "n", "comp")
    labelled.unionByName(signed.where("n = 0").select("row", "id", "n", F.col("row").alias("comp"))).write.parquet(f"{path}/labelled")
    labelled = spark.read.parquet(f"{path}/labelled")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    labelled.groupBy("comp").agg(best, F.count(F.lit(1)).alias("size")).write.parquet(f"{path}/best")
    return join_sized(labelled, spark.read.parquet(f"{path}/best"), ["comp"], "size").select(
        F.col("row").alias("row_id"), F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near copies the kept one."""
    return kept_rows(docs, near_groups(docs, id_col, text_col))
