"""Selection, sinks that count, buckets, resamples as counts, isotonic pooling, batches by
length, BM25 and vector search against brute force."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from trawl.operators import bm25, isotonic, knn, knn_bounds, knn_tree, lexical, resample, selection, vector_stream
from trawl.operators import metrics as M
from trawl.operators import mining as MN
from trawl.operators import quality as Q
from trawl.operators import ranking as R
from trawl.operators import stats as S
from trawl.operators import triples as TR
from trawl.operators.metrics import METRIC_COLUMNS, metrics_by_stratum
from trawl.operators.resume import open_buckets, run_in_buckets
from trawl.plans import bindings as B
from trawl.session import scratch_dir
from trawl.sources import sinks as SK
from trawl.sources import tables as TB


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


def key(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


# ------------------------------------------------------------------ first rows

@pytest.fixture(scope="module")
def mixed_rows(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 30) if rng.random() < 0.9 else None, rng.choice("abc"), rng.choice([1.5, None, 2.0])) for _ in range(3000)]
    rows += [(7, "b", 2.0)] * 1500  # a third of the rows are alike
    path = scratch_dir(spark, "mixed")
    spark.createDataFrame(rows, "k long, s string, x double").repartition(5).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("n", [0, 1, 999, 1001, 1500, 2400, 3100, 4499, 4500, 9000])
def test_first_rows_match_a_sort(mixed_rows, n):
    rows, df = mixed_rows
    want = sorted(rows, key=lambda r: key((r[0], *r)))[:n]
    assert as_counter(selection.first_rows(df, ["k"], n).collect()) == Counter(want)


def test_first_rows_split_a_partition_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_KEYS", 3)
    path = scratch_dir(spark, "many")
    spark.range(9000).select((F.col("id") * 7919 % 9001).alias("k")).write.parquet(path)
    for n in (1001, 5000, 8999, 9000):
        got = selection.first_rows(spark.read.parquet(path), ["k"], n)
        assert sorted(r.k for r in got.collect()) == sorted(i * 7919 % 9001 for i in range(9000))[:n]


@pytest.mark.parametrize("n", [1100, 2700])
def test_first_rows_by_expressions_and_several_keys(mixed_rows, n):
    rows, df = mixed_rows
    want = sorted(rows, key=lambda r: key((None if r[0] is None else -r[0], r[1], *r)))[:n]
    assert as_counter(selection.first_rows(df, [-F.col("k"), "s"], n).collect()) == Counter(want)


def test_first_rows_without_one_gathering_task(spark, mixed_rows):
    big = selection.first_rows(mixed_rows[1], ["k"], 2400)
    assert "TakeOrdered" not in plan(big) and "SinglePartition" not in plan(big)
    assert selection.first_rows(spark.createDataFrame([], "k long"), ["k"], 5000).count() == 0
    ids = scratch_dir(spark, "ids")
    spark.range(5000).write.parquet(ids)
    cut = TB.slice_shards(spark, [ids], 3000)
    assert cut.count() == 3000 and "PushedFilters: [Or(LessThanOrEqual(id,2999),IsNull(id))]" in plan(cut)
    assert TR.cap_rows(spark.read.parquet(ids), 2000, "id").agg(F.max("id")).first()[0] == 1999


def test_shards_are_sliced_in_file_order(spark, tmp_path):
    lines, paths = [], []
    for k in range(3):
        mine = [f"{k}-{i} é" if i % 7 else "" for i in range(700)]
        lines += mine
        paths.append(f"file://{tmp_path}/lines{k}.txt")
        (tmp_path / f"lines{k}.txt").write_text("\n".join(mine) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")  # a file is several splits
    try:
        for n in (1, 5, 699, 700, 701, 1200, 2099, 2100, 5000):
            got = TB.slice_in_order(spark, paths, n, "text")
            assert as_counter(got.collect()) == Counter((x,) for x in lines[:n])
            assert len({os.path.basename(f) for f in got.inputFiles()}) == (1 if n <= 700 else 2 if n <= 1400 else 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    folders = []
    for k in range(3):
        folders.append(scratch_dir(spark, "shard"))
        spark.range(k * 1000, k * 1000 + 1000).repartitionByRange(3, F.desc("id")).sortWithinPartitions(F.desc("id")).write.parquet(folders[-1])
    order = [i for k in range(3) for i in range(k * 1000 + 999, k * 1000 - 1, -1)]
    for n in (10, 1000, 1555, 3000):
        got = TB.slice_in_order(spark, folders, n)
        assert as_counter(got.collect()) == Counter((i,) for i in order[:n])
        assert not any(folders[2] in f for f in got.inputFiles()) or n > 2000
    with pytest.raises(ValueError):
        TB.slice_in_order(spark, folders, 5, "csv")


# ------------------------------------------------------------------ sinks that count, buckets

def test_sink_counts_in_the_job_that_writes(spark):
    path = scratch_dir(spark, "counted")
    rows = spark.range(100).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        found = SK.sink_counted(rows, path, "testing", keep=F.col("v").isNotNull(), counts={"total": F.lit(True), "none": F.col("v").isNull()}, drop=("v",))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {"rows": 66, "total": 100, "none": 34} and jobs == 1
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 66
    with pytest.raises(ValueError, match="testing gave no rows .*total = 100"):
        SK.sink_counted(rows, path, "testing", keep=F.col("id") < 0, counts={"total": F.lit(True)})


TRIPLE = "query_id long, positive_id long, negative_id long"
TEXT = "id long, text string"


def test_written_triples_report_drops_and_fail_without_rows(spark):
    official = spark.createDataFrame([(1, 10, 11), (1, 10, 99), (2, 11, 10), (3, 10, 11), (None, 10, 11)], TRIPLE)
    mined = spark.createDataFrame([(1, 11, 10), (2, 77, 10)], TRIPLE)
    queries = spark.createDataFrame([(1, "q1"), (2, None)], TEXT)
    passages = spark.createDataFrame([(10, "p"), (11, "n")], TEXT)
    path = scratch_dir(spark, "triples")
    assert TR.write_triples(official, mined, queries, passages, path, ratio_official=0.5) == {"rows": 3, "total": 7, "dropped_unknown_ids": 4}
    built = TR.build_triples(official, mined, queries, passages, ratio_official=0.5)
    assert as_counter(spark.read.parquet(path).select(*built.columns).collect()) == as_counter(built.collect())
    assert TR.write_triples(official, mined, queries, passages, path, ratio_official=0.5, max_triples=2)["rows"] == 2
    capped = TR.build_triples(official, mined, queries, passages, ratio_official=0.5, max_triples=2)
    want = built.orderBy("mix_key", "source").limit(2)
    assert as_counter(capped.collect()) == as_counter(spark.read.parquet(path).select(*built.columns).collect()) == as_counter(want.collect())
    with pytest.raises(ValueError, match="dropped_unknown_ids = 7"):
        TR.write_triples(official, mined, queries.limit(0), passages, path)
    with pytest.raises(ValueError, match="resolving"):
        TR.resolve_drop_count(official, queries.limit(0), passages)


def test_written_mining_counts_every_query_once(spark):
    pairs = [(q, d, 1.0 - d / 100, d + 1) for q in (1, 2, 3) for d in range(20) if not (q == 3 and d > 6)]
    cands = spark.createDataFrame(pairs, "qid long, docid long, score double, rank long")
    pos = spark.createDataFrame([(1, 3), (1, 4), (1, 500), (2, 500), (3, 0)], "qid long, docid long")
    coll = spark.createDataFrame([(d,) for d in range(20)], "docid long")
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4, 4)], "qid long")
    cfg = MN.MiningConfig(top_k=20, num_negatives=3, rank_min=2, rank_max=10)
    path = scratch_dir(spark, "mined")
    report = MN.write_mined(queries, cands, pos, coll, path, cfg)
    assert report == {"rows": 3, "mined_queries": 2, "skipped_no_qrel": 1, "skipped_positive_not_in_collection": 1, "skipped_insufficient_pool": 0}
    assert MN.mining_skip_report(queries, cands, pos, coll, cfg).first().asDict() == {k: v for k, v in report.items() if k != "rows"}
    want = MN.mine_hard_negatives(cands, pos, coll, cfg)
    assert as_counter((r.query_id, r.positive_id, tuple(r.negative_ids)) for r in spark.read.parquet(path).collect()) == as_counter(
        (r.query_id, r.positive_id, tuple(r.negative_ids)) for r in want.collect())
    with pytest.raises(ValueError, match="skipped_no_qrel = 4"):
        MN.write_mined(queries, cands, pos.limit(0), coll, path, cfg)


def test_a_job_killed_between_buckets_goes_on(spark):
    path, todo, done = scratch_dir(spark, "buckets"), spark.range(200).withColumnRenamed("id", "qid"), []

    def compute(rows):
        if len(done) == 2:
            rows.write.parquet(f"{path}/bucket=9/half")  # what a killed job may leave behind
            raise InterruptedError
        done.append(1)
        return rows.select("qid", (F.col("qid") * 2).alias("v"))

    with pytest.raises(InterruptedError):
        run_in_buckets(todo, compute, path, buckets=5, settings={"seed": 1})
    assert len(open_buckets(spark, path, 5)) == 3
    again = []
    out = run_in_buckets(todo, lambda rows: again.append(1) or rows.select("qid", (F.col("qid") * 2).alias("v")), path, buckets=5, settings={"seed": 1})
    assert len(again) == 3 and as_counter(out.collect()) == Counter((i, 2 * i) for i in range(200))
    assert run_in_buckets(todo, compute, path, buckets=5, settings={"seed": 1}).count() == 200  # nothing is left to do
    with pytest.raises(ValueError, match="was begun with"):
        run_in_buckets(todo, compute, path, buckets=5, settings={"seed": 2})


# ------------------------------------------------------------------ resamples as counts

def counts_of(n, b, seed):
    return np.concatenate([resample.block_counts(n, k, b, seed) for k in range(-(-n // resample.BLOCK))])


def test_resample_counts_are_those_of_n_draws():
    n = 3 * resample.BLOCK + 17
    drawn = np.array([counts_of(n, b, 5) for b in range(60)])
    assert (drawn.sum(1) == n).all()
    parts = drawn[:, :resample.BLOCK].sum(1)
    expect, spread = n * resample.BLOCK / n, math.sqrt(resample.BLOCK * (1 - resample.BLOCK / n))
    assert abs(parts.mean() - expect) < 4 * spread / math.sqrt(60) and 0.6 < parts.std() / spread < 1.5
    assert abs((drawn == 0).mean() - math.exp(-1)) < 0.01


@pytest.mark.parametrize("n", [1, 300, 9000])
def test_python_metrics_match_brute_force(spark, n):
    rng = np.random.default_rng(n)
    v = rng.random(n).round(4)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)] + [(n, None)], "qid long, v double").repartition(7)

    def median(values, counts):
        order = np.argsort(values)
        at = np.searchsorted(np.cumsum(counts[order]), (counts.sum() + 1) // 2)
        return values[order][at]

    for metric, plain in ((resample.MEAN, lambda x, c: np.dot(x, c) / c.sum()), (median, median)):
        r = S.bootstrap_ci(df, "v", metric_fn=metric, n_resamples=40, seed=9).first()
        found = [plain(v, counts_of(n, b, 9)) for b in range(40)]
        assert abs(r.mean - plain(v, np.ones(n, int))) < 1e-6
        assert abs(r.ci_low - np.quantile(found, 0.025)) < 2e-6 and abs(r.ci_high - np.quantile(found, 0.975)) < 2e-6


def test_python_metric_agrees_with_the_column_form(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random()) for i in range(400)], "qid long, v double")
    a = S.bootstrap_ci(df, "v", n_resamples=400).first()
    b = S.bootstrap_ci(df, "v", metric_fn=resample.MEAN, n_resamples=400).first()
    assert a.mean == b.mean and abs(a.ci_low - b.ci_low) < 0.01 and abs(a.ci_high - b.ci_high) < 0.01
    assert not resample.is_counts_metric(F.avg) and not resample.is_counts_metric(F.median)
    with pytest.raises(ValueError):
        S.bootstrap_ci(df.limit(0), "v", metric_fn=resample.MEAN)


def test_paired_test_over_counts_agrees_with_the_draws(spark):
    rng = random.Random(8)
    b = [rng.random() * 0.5 for _ in range(150)]
    for shift, spread in ((0.05, 0.0), (0.004, 0.1), (-0.1, 0.0)):
        df = spark.createDataFrame([(i, x + shift + spread * (rng.random() - 0.5), x) for i, x in enumerate(b)], "qid long, a double, b double")
        plain, counts = (S.paired_bootstrap(df, n_resamples=300, as_counts=c).first() for c in (False, True))
        assert plain.observed_diff == counts.observed_diff and abs(plain.p_value - counts.p_value) < 0.12


def test_a_null_stratum_is_not_the_overall_row(spark):
    per_query = spark.createDataFrame([(q, q / 4) for q in range(4)], "qid long, v double")
    per_query = per_query.select("qid", *(F.col("v").alias(c) for c in METRIC_COLUMNS))
    strata = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None)], "qid long, stratum string")
    got = {(r.stratum, r.num_queries) for r in metrics_by_stratum(per_query, strata).collect()}
    assert got == {("a", 2), (None, 2), ("all", 4)}


# ------------------------------------------------------------------ isotonic

@pytest.mark.parametrize("kind", ["rising", "falling", "noise", "steps", "one"])
def test_isotonic_equals_spark_ml(spark, kind):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(kind)
    n = 1 if kind == "one" else 900
    score = [round(rng.random(), 3) for _ in range(n)]
    chance = {"rising": lambda s: s, "falling": lambda s: 1 - s, "noise": lambda s: 0.5, "steps": lambda s: int(s * 4) / 4, "one": lambda s: 1}[kind]
    pairs = spark.createDataFrame([(i, s, rng.random() < chance(s)) for i, s in enumerate(score)], "id long, score double, is_pos boolean").repartition(6)
    got = {r.id: r.calibrated for r in Q.calibrate_scores(pairs).collect()}
    data = VectorAssembler(inputCols=["score"], outputCol="features").transform(pairs.withColumn("label", F.col("is_pos").cast("double")))
    want = {r.id: r.prediction for r in IsotonicRegression().fit(data).transform(data).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_isotonic_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], "score double, is_pos boolean")
    assert Q.calibrate_scores(none).count() == 0
    odd = spark.createDataFrame([(None, True), (0.5, None), (0.2, True), (0.2, False)], "score double, is_pos boolean")
    assert sorted((r.score is None, r.score, r.calibrated) for r in Q.calibrate_scores(odd).where("score is not null").collect()) == [
        (False, 0.2, 0.5), (False, 0.2, 0.5), (False, 0.5, None)]
    lo, hi, total, weight = isotonic.pooled(np.arange(4.0), np.arange(4.0), np.array([1.0, 0, 3, 2]), np.ones(4))
    assert lo.tolist() == [0, 2] and hi.tolist() == [1, 3] and (total / weight).tolist() == [0.5, 2.5]


# ------------------------------------------------------------------ batches by length

def test_batches_by_length_pad_less_and_keep_every_pair(spark):
    rng = random.Random(2)
    rows = [(i, "q" * rng.randint(1, 20), None if i % 50 == 0 else "p " * rng.choice([3, 10, 400])) for i in range(900)] + [(7, "same", "same")] * 300
    pairs = spark.createDataFrame(rows, "id long, query string, passage string").repartition(4)
    seen = []

    def scorer(batch):
        assert len(batch) <= 32
        return [float(len(q) + len(p or "")) for q, p in batch]

    for by_length in (True, False):
        out = R.score_pairs(pairs, scorer, batch=True, batch_rows=32, sort_by_length=by_length).collect()
        seen.append(as_counter(out))
        assert all(r.score == len(r.query) + len(r.passage or "") for r in out)
    assert seen[0] == seen[1] and sum(seen[0].values()) == len(rows)
    before, after = (R.padding(p, 32).first() for p in (pairs, R.by_length(pairs)))
    assert before.characters == after.characters and after.padded < 1.1 * after.characters < before.padded


# ------------------------------------------------------------------ BM25

def bm25_plain(queries, docs, k):
    tok = {i: [] if t is None else [w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split()] for i, t in docs.items()}
    n, mean = len(docs), np.mean([len(t) for i, t in tok.items() if docs[i] is not None])
    df = Counter(w for t in tok.values() for w in set(t))
    out = {}
    for q, text in queries.items():
        terms = Counter("".join(c.lower() if c.isalnum() else " " for c in text or "").split())
        score = {}
        for i, t in tok.items():
            tf = Counter(t)
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 1.9 / (tf[w] + 0.9 * (0.6 + 0.4 * len(t) / mean)) for w, c in terms.items() if tf[w])
            if s:
                score[i] = round(s, 6)
        out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_bm25_equals_brute_force_over_many_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(bm25, "BLOCK", 16)
    monkeypatch.setattr(bm25, "CHUNK", 3)
    monkeypatch.setattr(bm25, "PAIRS", 40)  # several passes
    rng = random.Random(k)
    vocab = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(400)]
    docs = {i: " ".join(rng.choices(vocab, k=rng.randint(0, 30))).upper() for i in range(300)} | {900: None, 901: ""}
    queries = {i: " ".join(rng.choices(vocab, k=rng.randint(1, 12))) for i in range(20)} | {50: None, 51: "", 52: "unknown words", 53: "w1 w2", 54: "w2, W1!"}
    got = {}
    out = lexical.bm25_first_stage(spark.createDataFrame(list(queries.items()), TEXT), spark.createDataFrame(list(docs.items()), TEXT).repartition(4), k)
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.docid, r.score))
    want = {q: r for q, r in bm25_plain(queries, docs, k).items() if r}
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


def test_bm25_skips_blocks_that_cannot_gain():
    rng = np.random.default_rng(1)
    best, read, every = bm25._Best(2, 3), 0, 0
    for b in range(50):  # the best documents come first
        row, term = np.repeat(np.arange(20), 2), np.tile([0, 1], 20)
        block = bm25._Block(np.arange(20) + 20 * b, row, term, rng.random(40) / (b + 1))
        r, e = bm25._meet(block, np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([1.0, 2.0, 1.0]), best)
        read, every = read + r, every + e
        best.parts = [best.kept()]
    assert every == 50 * 60 and read < every / 2


def test_bm25_looks_low_terms_up_and_keeps_scores_exact():
    rng = np.random.default_rng(2)
    best, plain, read, every = bm25._Best(4, 5), [], 0, 0
    q, term = np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)
    w = np.tile([0.02, 0.03, 0.05, 0.1, 1.0, 3.0], 4) * (1 + np.arange(24) / 100)
    for b in range(30):
        hold = rng.random((40, 6)) < [0.95, 0.9, 0.9, 0.8, 0.2, 0.05]  # heavy terms are rare
        row, t = np.nonzero(hold)
        impact = rng.random(len(row)) + 0.5
        r, e = bm25._meet(bm25._Block(np.arange(40) + 40 * b, row, t, impact), term, q, w, best)
        read, every = read + r, every + e
        score = np.zeros((4, 40))
        dense = np.zeros((40, 6))
        dense[row, t] = impact
        score = w.reshape(4, 6) @ dense.T
        plain += [(a, 40 * b + d, score[a, d]) for a in range(4) for d in range(40) if score[a, d] > 0]
    got = sorted(zip(*(x.tolist() for x in best.kept())))
    for a in range(4):
        want = sorted((x for x in plain if x[0] == a), key=lambda x: -x[2])[:5]
        mine = sorted((x for x in got if x[0] == a), key=lambda x: -x[2])[:5]
        assert [x[1] for x in mine] == [x[1] for x in want] and np.allclose([x[2] for x in mine], [x[2] for x in want])
    assert read < every / 2


def test_bm25_tasks_hold_few_postings(monkeypatch):
    monkeypatch.setattr(bm25, "HELD", 60)
    monkeypatch.setattr(bm25, "BLOCK", 10)
    rng, n = np.random.default_rng(12), 400
    docs = [sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist()) for _ in range(n)]

    def batches(most):
        for lo in range(0, n, 37):
            part = docs[lo:lo + 37]
            held = [len(x) for b in held_now for x in [b.row]]
            most.append(sum(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(lo, lo + len(part))), pa.array([len(d) + i % 9 for i, d in enumerate(part)], pa.int32()),
                 pa.array(part, pa.list_(pa.int32())), pa.array([[1 + i % 3 for i, _ in enumerate(d)] for d in part], pa.list_(pa.int32()))],
                names=["docid", "dl", "ids", "tfs"])

    held_now, plain = [], bm25._parts

    def parts(blocks):
        for part in plain(blocks):
            assert sum(len(b.row) for b in part) < 60 + 10 * 6
            held_now[:] = part
            yield part
            assert not part  # given back before the next is read
            held_now.clear()

    monkeypatch.setattr(bm25, "_parts", parts)

    class Shared:
        value = np.array([5, 9]), np.array([0, 1, 2, 1, 5]), np.array([0, 0, 0, 1, 1]), np.array([1.0, 2.0, 0.5, 1.0, 3.0])

    def best(held, kept):
        monkeypatch.setattr(bm25, "HELD", held)
        monkeypatch.setattr(bm25, "KEPT", kept)
        out = [(q, -s, d) for b in bm25._scored(Shared, 7, 0.9, 0.4, 5.0, False)(batches([])) for q, d, s in zip(*(c.to_pylist() for c in b.columns))]
        return len(out), {q: sorted(x for x in out if x[0] == q)[:7] for q in (5, 9)}

    (rows, few), (least, kept) = best(60, 0), best(60, 10**6)
    monkeypatch.setattr(bm25, "_parts", plain)
    same, whole = best(10**9, 0)
    assert few == kept == whole and all(len(x) == 7 for x in few.values())
    assert least == same and rows < 400  # thresholds go from part to part


def test_bm25_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], TEXT), spark.createDataFrame([], TEXT)
    assert lexical.bm25_first_stage(some, none).count() == 0
    assert lexical.bm25_first_stage(none, some).count() == 0
    r = lexical.bm25_postings_read(some, some).first()
    assert (r.read, r.postings) == (2, 2)


# ------------------------------------------------------------------ vectors

def vectors(spark, x, name):
    cols = {"q": "qid long, qvec array<float>", "d": "docid long, dvec array<float>"}[name]
    path = scratch_dir(spark, "vectors")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], cols).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def clustered(seed, n, dim, groups):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    size = rng.random(groups) ** 3
    at = rng.choice(groups, n, p=size / size.sum())  # one group holds a large share
    x = centres[at] + 0.15 * rng.normal(size=(n, dim))
    x[: n // 10] = x[0]  # ties
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def test_bounded_search_is_exact_and_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn_bounds, "BLOCK_ROWS", 64)
    x = clustered(4, 1500, 16, 30)
    q, p = vectors(spark, x[::3], "q"), vectors(spark, x, "d")
    for k in (1, 10, 2000):
        a = {(r.qid, r.docid, r.rank, r.score) for r in knn.knn_join_exact(q, p, k, prune=False).collect()}
        b = {(r.qid, r.docid, r.rank, r.score) for r in knn.knn_join_exact(q, p, k, prune=True).collect()}
        assert {t[:3] for t in a} == {t[:3] for t in b} and len(a) == len(b)
    search = knn_bounds.BoundedSearch(q, p, 10, False, block_rows=64, query_rows=100)
    met, every = search.pairs_met(knn.rank_topk(search.first(), 10))
    assert met < every / 2
    assert knn.knn_join_exact(q, p.limit(0), 3, prune=True).count() == 0 == knn.knn_join_exact(q.limit(0), p, 3, prune=True).count()


def test_tree_search_finds_nearly_all_in_few_cells(spark, monkeypatch):
    monkeypatch.setattr(knn_tree, "BLOCK_ROWS", 50)
    x = clustered(5, 4000, 16, 60)
    q, p = vectors(spark, x[::8], "q"), vectors(spark, x, "d")
    approx = knn.knn_join_ivf(q, p, 10, exclude_self=True).cache()
    assert {r["count"] for r in approx.groupBy("qid").count().collect()} == {10}
    exact = knn.knn_join_exact(q, p, 10, exclude_self=True)
    assert knn.knn_recall(approx, exact, 10).first().knn_recall >= 0.9
    tree = knn_tree.Tree(p, 256, 4000)
    assert int(tree.sizes.sum()) == 4000 and tree.placed.select("docid").distinct().count() == 4000
    probes = tree.probes(q, 32, 81)
    per_query = probes.join(spark.createDataFrame(tree._sized(), "cell long, size long"), "cell").groupBy("qid").agg(
        F.count("*").alias("cells"), F.sum("size").alias("rows")).collect()
    assert all(r.cells < tree.cells / 2 and r.rows >= 81 for r in per_query)
    assert len(per_query) == q.count()
    assert knn.knn_join_ivf(q, p.limit(0), 3).count() == 0


def test_tree_search_on_the_given_vectors_keeps_recall_in_few_cells(spark, sf001):
    q, p = B.v_queries(spark, sf001).select("qid", "qvec"), B.v_passages(spark, sf001).select("docid", "dvec")
    n = p.count()
    approx = knn.knn_join_ivf(q, p, 10, exclude_self=True, probe_rows=2 * n // 5)
    assert knn.knn_recall(approx, knn.knn_join_exact(q, p, 10, exclude_self=True), 10).first().knn_recall >= 0.9
    nlist, nprobe = knn.ivf_params(n)
    tree = knn_tree.Tree(p, nlist, n)
    probed = tree.probes(q, nprobe, 2 * n // 5 + 1).groupBy("qid").count()
    assert probed.agg(F.max("count")).first()[0] < tree.cells / 2


def test_bounded_search_returns_no_more_than_its_rows(spark, monkeypatch):
    monkeypatch.setattr(knn_bounds, "LEAST_QUERIES", 20)
    monkeypatch.setattr(vector_stream, "CHUNK", 16)
    x = clustered(6, 600, 16, 20)
    q, p = vectors(spark, x, "q"), vectors(spark, x, "d")
    found, final = knn_bounds.BoundedSearch(q, p, 25, True, block_rows=16).ranked()
    assert final and found.count() == 600 * 25
    want = {tuple(r) for r in knn.knn_join_exact(q, p, 25, exclude_self=True, prune=False).collect()}
    assert {tuple(r) for r in found.collect()} == want


def test_bounded_search_of_repeated_ids_and_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn_bounds, "LEAST_QUERIES", 5)
    x = np.concatenate([clustered(7, 120, 8, 4), (30 * clustered(8, 20, 8, 4)), np.zeros((2, 8), np.float32)])
    q, p = vectors(spark, x[:140], "q"), vectors(spark, x, "d")
    q, p = q.unionByName(q.limit(30)), p.unionByName(p.where("docid < 10"))
    for k in (1, 9, 500):
        a, b = ({(r.qid, r.docid, r.rank) for r in knn.knn_join_exact(q, p, k, exclude_self=True, prune=x).collect()} for x in (False, True))
        assert a == b


def test_running_holds_few_scores_and_breaks_ties_by_id(monkeypatch):
    monkeypatch.setattr(vector_stream, "CHUNK", 8)
    rng = np.random.default_rng(9)
    p = rng.integers(-2, 3, size=(500, 4)).astype(float)  # many equal scores
    q = rng.integers(-2, 3, size=(30, 4)).astype(float)
    best = vector_stream.Running(np.arange(30), q, 5, False)
    ids = rng.permutation(500)
    for lo in range(0, 500, 50):
        best.meet(ids[lo:lo + 50], p[ids[lo:lo + 50]], np.arange(30))
    assert best.score.shape == (30, 13)
    out = pa.Table.from_batches(best.rows())
    for i in range(30):
        s = p @ q[i]
        want = sorted(range(500), key=lambda d: (-s[d], d))[:5]
        mine = out.filter(pc.equal(out["qid"], i))
        assert mine["docid"].to_pylist() == want and mine["rank"].to_pylist() == [1, 2, 3, 4, 5]


def test_tree_search_with_held_queries_finds_the_same(spark):
    x = clustered(10, 900, 16, 12)
    q, p = vectors(spark, x[::2], "q"), vectors(spark, x, "d")
    tree = knn_tree.Tree(p, 40, 900)
    probes = tree.probes(q, 9, 300).localCheckpoint()
    a = {tuple(r) for r in knn.rank_topk(tree.search(q, probes, 7, True, 450), 7).collect()}
    held = tree.search_held(q, probes, 7, True, 5)
    assert {tuple(r) for r in knn.rank_topk(held, 7).collect()} == a and held.count() == 450 * 7 == len(a)


def test_many_probed_cells_do_not_copy_queries(spark, monkeypatch):
    x = clustered(11, 600, 8, 12)
    q, p = vectors(spark, x, "q"), vectors(spark, x, "d")
    usual = {tuple(r) for r in knn.knn_join_ivf(q, p, 5, exclude_self=True, nlist=30, probe_rows=300).collect()}
    monkeypatch.setattr(knn, "HELD_PAIRS", 0)
    monkeypatch.setattr(knn_tree.Tree, "search", None)
    assert {tuple(r) for r in knn.knn_join_ivf(q, p, 5, exclude_self=True, nlist=30, probe_rows=300).collect()} == usual


def test_labels_and_metrics_do_not_move_the_run(spark, tmp_path):
    rows = [(q, d, d % 7 + 1) for q in range(40) for d in range(q % 5, 60)]
    rows = [(q, d, sum(1 for x in rows if x[0] == q and x[1] < d) + 1) for q, d, _ in rows]
    spark.createDataFrame(rows, "qid long, docid long, rank long").write.parquet(str(tmp_path / "run"))
    spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, cls int").write.parquet(str(tmp_path / "cls"))
    run, cls = spark.read.parquet(str(tmp_path / "run")), spark.read.parquet(str(tmp_path / "cls"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lab = M.label_pairs_by_class(run, cls.withColumnRenamed("id", "qid"), cls.withColumnRenamed("id", "docid"))
        assert "SortMergeJoin" not in plan(lab)
        ideal = M.ideal_from_classes(cls.withColumnRenamed("id", "qid"), cls.withColumnRenamed("id", "docid"))
        per = M.per_query_metrics(lab, ideal)
        assert "Window" not in plan(per) and "Window" not in plan(M.average_precision(lab, ideal))
        single = {r.qid: r.map for r in M.average_precision(lab, ideal).collect()}
        for r in per.collect():
            ranks = sorted(k for q, d, k in rows if q == r.qid and d % 3 == r.qid % 3)
            assert r.map == single[r.qid] == pytest.approx(round(sum((i + 1) / k for i, k in enumerate(ranks)) / 19, 6), abs=2e-6)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_read_more_than_once_are_written(spark, sf0001):
    from trawl.plans import q_mining as QM

    cands, pos, _ = QM.v_inputs(spark, sf0001)
    a, b = QM.two_systems(spark, sf0001)
    for df in (cands, pos, a, b):
        assert "MapInArrow" not in plan(df) and "FlatMapGroups" not in plan(df) and "MapInPandas" not in plan(df)


def test_draws_of_a_task_are_bounded(spark, monkeypatch):
    from trawl.operators import stats

    monkeypatch.setattr(stats, "DRAWS", 100)
    draws = stats._draws(spark, 50, 90, 1)
    assert draws.count() == 4500 and draws.select("b", "idx").distinct().where("idx < 0 or idx >= 50 or b >= 90").isEmpty()
    sizes = draws.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 100 and sum(sizes) == 4500


def test_metrics_collect_relevant_ranks_alone(spark):
    """Rows of a query lie in several partitions, twice or with null gains or a null query."""
    rnd = random.Random(3)
    rows = [(None if q == 0 else q, rank, rnd.choice([None, 0.0, 0.0, 1.0, 2.0]) if q != 7 else 0.0) for q in range(300) for rank in range(1, 41)]
    rows += [r for r in rows if r[0] == 5]
    rnd.shuffle(rows)
    run = spark.createDataFrame(rows, "qid long, rank long, gain double").repartition(3)
    ideal = spark.range(300).selectExpr("id AS qid", "20L AS num_rel", "3.0D AS idcg_10")
    per, single = M.per_query_metrics(run, ideal), M.average_precision(run, ideal)
    for df in (per, single):  # what Spark collects, and may have to sort, are sums of the run's rows
        assert "partial_count" in plan(df)[plan(df).rindex("partial_collect_list"):]
    maps = {r.qid: r.map for r in single.collect()}
    found = {r.qid: r for r in per.collect()}
    assert set(found) == set(maps) == set(range(1, 300))
    for q, r in found.items():
        mine = sorted((rank, gain or 0.0) for x, rank, gain in rows if x == q)
        ranks = [rank for rank, gain in mine if gain > 0]
        assert r.map == maps[q] == pytest.approx(sum((i + 1) / rank for i, rank in enumerate(ranks)) / 20, abs=2e-6)
        assert r.ndcg_at_10 == pytest.approx(sum(gain / math.log2(rank + 1) for rank, gain in mine if rank <= 10) / 3, abs=2e-6)
        assert r.mrr_at_10 == pytest.approx(round(1 / ranks[0], 6) if ranks and ranks[0] <= 10 else 0.0)
        assert r.recall_at_100 == r.recall_at_1000 == pytest.approx(len(ranks) / 20, abs=2e-6)


def dealt_rows(node, column):
    """How often a plan's rows that hold ``column`` are moved."""
    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    moved = "Exchange" in node.nodeName() and any(a.name() == column for a in items(node.output()))
    return moved + sum(dealt_rows(child, column) for child in items(node.children()))


def test_mining_deals_candidates_by_query_once(spark, tmp_path):
    rows = [(q, (q + r) % 50, r) for q in range(50) for r in range(1, 31)]
    spark.createDataFrame(rows, "qid long, docid long, rank long").write.parquet(str(tmp_path / "run"))
    positives = [(q, (q + 3) % 50) for q in range(0, 50, 2)] + [(1, 99), (4, 77)]  # 99 and 77 are not in the collection
    spark.createDataFrame(positives, "qid long, docid long").write.parquet(str(tmp_path / "positives"))
    run, pos = spark.read.parquet(str(tmp_path / "run")), spark.read.parquet(str(tmp_path / "positives"))
    config = MN.MiningConfig(top_k=25, num_negatives=4, rank_min=2, rank_max=20, seed=1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        mined = MN.mine_hard_negatives(run, pos, spark.range(50).withColumnRenamed("id", "docid"), config)
        # once by query and passage, to lose positives, and once by query
        assert dealt_rows(mined._jdf.queryExecution().executedPlan(), "rank") == 2
        found = {r.query_id: r for r in mined.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(found) == set(range(0, 50, 2))
    for q, r in found.items():
        pool = [d for x, d, rank in rows if x == q and rank <= 25 and (q, d) not in positives][2:20]
        assert r.positive_id == (q + 3) % 50 and len(set(r.negative_ids)) == 4 and set(r.negative_ids) <= set(pool)


def test_query_blocks_are_few_and_bounded():
    for n, k, dims in ((615_384, 200, 64), (615_384, 100, 64), (615_384, 1000, 64), (100_000, 10, 4096), (5, 3, 2)):
        blocks = knn_bounds.query_blocks(n, k, 12, dims)
        assert n / blocks * (16 * (k + vector_stream.CHUNK) + 12 * dims) <= knn_bounds.STATE and n / blocks <= knn_bounds.MOST_QUERIES
        assert blocks <= max(1, n // knn_bounds.LEAST_QUERIES)
    assert knn_bounds.query_blocks(615_384, 200, 12, 64) == 36  # 48 with a wider margin of scores
