"""Hand-checked cases (FIXTURES.md §3) on tiny DataFrames."""

import pytest
from pyspark.sql import functions as F

from trawl.functions import text as TX
from trawl.operators import metrics as M
from trawl.operators import mining as MN
from trawl.operators import quality as Q
from trawl.operators import stats as S
from trawl.operators import triples as TR
from trawl.session import scratch_dir
from trawl.sources import sinks as SK
from trawl.sources import textformats as TF


def test_triples_to_pairs_order_and_labels(spark):
    t = spark.createDataFrame([(1, "q1", "p1", "n1"), (2, "q2", "p2", "n2"), (3, "q3", "p3", "n3")],
                              "query_id long, query_text string, positive_text string, negative_text string")
    rows = TR.triples_to_pairs(t.orderBy("query_id").coalesce(1)).collect()
    assert len(rows) == 6
    assert [r.label for r in rows] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert [r.sentence_B for r in rows][:2] == ["p1", "n1"]


def _paired(spark, a, b):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "qid long, a double, b double")


def test_paired_bootstrap_a_worse_gives_p_one(spark):
    r = S.paired_bootstrap(_paired(spark, [0.4] * 50, [0.6] * 50), n_resamples=200).first()
    assert r.p_value == 1.0


def test_paired_bootstrap_a_better_is_significant(spark):
    import random

    rng = random.Random(0)
    b = [rng.random() * 0.5 for _ in range(200)]
    a = [x + 0.05 for x in b]
    r = S.paired_bootstrap(_paired(spark, a, b), n_resamples=500).first()
    assert r.p_value < 0.05


def test_pair_systems_unequal_lengths_fail(spark):
    from trawl.operators.joins import pair_systems

    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "qid long, m double")
    b = spark.createDataFrame([(1, 0.1)], "qid long, m double")
    with pytest.raises(ValueError):
        pair_systems(a, b, "m")


def test_bootstrap_ci_empty_fails(spark):
    with pytest.raises(ValueError):
        S.bootstrap_ci(spark.createDataFrame([], "qid long, v double"), "v")


def test_bootstrap_ci_bounds(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random()) for i in range(200)], "qid long, v double")
    r = S.bootstrap_ci(df, "v", n_resamples=300).first()
    assert 0.0 <= r.ci_low <= r.mean <= r.ci_high <= 1.0
    assert r.n_resamples == 300 and r.confidence == 0.95


def test_format_ci(spark):
    r = spark.range(1).select(TX.format_ci(F.lit(0.5234), F.lit(0.4123), F.lit(0.6356), F.lit(0.95), 3)
                              .alias("s")).first().s
    assert "0.523" in r and "0.412" in r and "0.636" in r and "CI 95%" in r


def test_snapshot_manifest_keeps_history_and_row_counts(spark, sf0001):
    tables = {"region": f"{sf0001}/region.parquet", "nation": f"{sf0001}/nation.parquet"}
    path = scratch_dir(spark, "test-manifest")
    SK.snapshot_manifest(spark, tables, path, "small")
    man = SK.snapshot_manifest(spark, tables, path, "full")
    assert sorted(r.snapshot for r in man.select("snapshot").distinct().collect()) == [1, 2]
    counts = {r.table_name: r.num_rows for r in man.where("snapshot = 2").collect()}
    exp = spark.createDataFrame([(k, v) for k, v in counts.items()], "table_name string, expected_rows long")
    assert all(r.ok for r in SK.check_row_counts(spark, path, exp).collect())
    # full mode: count + 1 fails
    plus = spark.createDataFrame([(k, v + 1) for k, v in counts.items()], "table_name string, expected_rows long")
    assert not any(r.ok for r in SK.check_row_counts(spark, path, plus).collect())
    # a table missing from the snapshot fails
    miss = spark.createDataFrame([("queries_dev", 5)], "table_name string, expected_rows long")
    assert not SK.check_row_counts(spark, path, miss).first().ok


def test_check_row_counts_small_mode_and_missing_manifest(spark, sf0001):
    tables = {"region": f"{sf0001}/region.parquet"}
    path = scratch_dir(spark, "test-manifest")
    SK.snapshot_manifest(spark, tables, path, "small")
    ok = spark.createDataFrame([("region", 5)], "table_name string, expected_rows long")
    over = spark.createDataFrame([("region", 4)], "table_name string, expected_rows long")
    assert SK.check_row_counts(spark, path, ok).first().ok
    assert not SK.check_row_counts(spark, path, over).first().ok
    with pytest.raises(FileNotFoundError):
        SK.check_row_counts(spark, scratch_dir(spark, "nothing"), ok)


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, docid long, rank long, gain double")


def test_mrr_at_k(spark):
    r = _ranked(spark, [(1, 3, 1, 0.0), (1, 1, 2, 1.0), (1, 2, 3, 0.0)])
    assert M.mrr_at_k(r, 10).first().mrr_at_10 == 0.5


def test_ndcg_at_10(spark):
    r = _ranked(spark, [(1, 2, 1, 1.0), (1, 1, 2, 2.0)])
    qrels = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "qid long, docid long, rel int")
    out = M.per_query_metrics(r, M.ideal_from_qrels(qrels)).first()
    assert abs(out.ndcg_at_10 - 0.859719) < 1e-6


def test_average_precision(spark):
    r = _ranked(spark, [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (1, 3, 3, 1.0)])
    qrels = spark.createDataFrame([(1, 1, 1), (1, 3, 1), (1, 9, 1)], "qid long, docid long, rel int")
    out = M.per_query_metrics(r, M.ideal_from_qrels(qrels)).first()
    assert abs(out.map - 0.555556) < 1e-6
    assert abs(out.recall_at_100 - 2 / 3) < 1e-6


def _cal(spark, scores, labels):
    return spark.createDataFrame([(float(s), bool(y)) for s, y in zip(scores, labels)], "score double, is_pos boolean")


def test_ece_and_brier(spark):
    r = Q.ece_brier(_cal(spark, [0.95, 0.95, 0.05, 0.05], [1, 0, 0, 0])).first()
    assert abs(r.ece - 0.25) < 1e-9 and abs(r.brier - 0.2275) < 1e-9


def test_reliability_bin_edge(spark):
    bins = {r.bin: r.n for r in Q.reliability_bins(_cal(spark, [0.3, 1.0, 0.0, 1.5], [1, 0, 0, 1])).collect()}
    assert bins[2] == 1 and bins[3] == 0 and bins[9] == 1 and bins[0] == 1
    assert sum(bins.values()) == 3  # 1.5 falls in no bin


def test_ece_counts_out_of_range_scores_in_n(spark):
    r = Q.ece_brier(_cal(spark, [0.5, 7.0], [1, 1])).first()
    assert r.n == 2 and abs(r.ece - 0.25) < 1e-9


@pytest.mark.parametrize("text,expected", [("porque você não está", "pq vc naum ta"), ("festa boa", "fta boa")])
def test_abbreviations(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(TX.abbreviations(F.col("t")).alias("o")).first().o == expected


def test_strip_accents(spark):
    assert spark.createDataFrame([("ação",)], "t string").select(TX.strip_accents(F.col("t")).alias("o")).first().o == "acao"


def test_typo_swaps_keeps_multiset_and_short_strings(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abc")], "k long, t string")
    out = {r.k: r.o for r in df.select("k", TX.typo_swaps(F.col("t"), 42, F.col("k")).alias("o")).collect()}
    assert sorted(out[1]) == sorted("abcdefgh") and out[2] == "abc"


def test_scan_id_triples_skips_bad_lines(spark, tmp_path):
    p = tmp_path / "triples.tsv"
    p.write_text("1\t2\t3\n4\t5\n6\t7\t8\t9\n10\t11\t12\n")
    rows = sorted(tuple(r) for r in TF.scan_id_triples(spark, str(p)).collect())
    assert rows == [(1, 2, 3), (10, 11, 12)]


def test_scan_qrels_last_duplicate_wins_and_field_rules(spark, tmp_path):
    p = tmp_path / "qrels.txt"
    p.write_text("1 0 10 0\n1 0 11 1\n2 0\n1 0 10 3\n3\t0\t30\t1 x\n")
    graded = {(r.qid, r.docid): r.rel for r in TF.scan_qrels_graded(spark, str(p)).collect()}
    assert graded == {(1, 10): 3, (1, 11): 1, (3, 30): 1}
    pos = sorted(tuple(r) for r in TF.scan_qrels_positive(spark, str(p)).collect())
    assert pos == [(1, 10), (1, 11)]


def test_scan_run_formats_and_cap(spark, tmp_path):
    p = tmp_path / "run.txt"
    p.write_text("1 Q0 10 1 9.0 x\n1 11 2\n1 Q0 12 3\n1 13 3\n2 20 1\n")
    wanted = spark.createDataFrame([(1,)], "qid long")
    rows = sorted(tuple(r) for r in TF.scan_run(spark, str(p), query_ids=wanted, top_k=2).collect())
    assert rows == [(1, 10, 1), (1, 11, 2)]


def test_mining_config_rejects_bad_windows():
    with pytest.raises(ValueError):
        MN.MiningConfig(top_k=50, rank_min=10, rank_max=100)
    with pytest.raises(ValueError):
        MN.MiningConfig(top_k=200, rank_min=10, rank_max=15, num_negatives=7)


def test_mix_sources_ratio_and_exhaustion(spark):
    off = spark.createDataFrame([(i, i, i) for i in range(3)], "query_id long, positive_id long, negative_id long")
    mined = spark.createDataFrame([(100 + i, i, i) for i in range(9)], "query_id long, positive_id long, negative_id long")
    mixed = TR.mix_sources(off, mined, 0.25).orderBy("mix_key", "source").collect()
    srcs = [r.source for r in mixed]
    assert len(srcs) == 12 and srcs.count("official") == 3
    # interleave at 1:3 while both last
    assert srcs[:4].count("official") == 1
    # zero weight source contributes nothing
    assert TR.mix_sources(off, mined, 0.0).where("source = 'official'").count() == 0
    with pytest.raises(ValueError):
        TR.mix_sources(off, mined, 1.5)


def test_release_gate_missing_metric_fails(spark):
    rows = [("a", m, v) for m, v in [("mrr10_gain_over_baseline", 0.05), ("ece", 0.05), ("robustness_drop_no_accents", 0.01),
                                      ("robustness_drop_typos", 0.1), ("robustness_drop_case", 0.01),
                                      ("qualitative_pass_rate", 0.9)]]
    rows += [("b", "ece", 0.01)]
    out = {r.system: r for r in Q.release_gate(spark.createDataFrame(rows, "system string, metric string, value double")).collect()}
    assert out["a"].passed and out["a"].failures == []
    assert not out["b"].passed and "qualitative_pass_rate" in out["b"].failures


def test_synthetic_qrels_one_per_query_in_first_ids(spark):
    q = spark.createDataFrame([(i,) for i in range(20)], "qid long")
    c = spark.createDataFrame([(i,) for i in range(5000)], "docid long")
    r = MN.synthetic_qrels(q, c, first_n=1000).collect()
    assert len(r) == 20 and all(0 <= x.docid < 1000 for x in r)



def test_judged_query_without_positive_scores_zero_and_counts(spark):
    from trawl.operators import metrics as M

    qrels = spark.createDataFrame([(1, 10, 1), (2, 20, 0)], "qid long, docid long, rel int")
    run = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "qid long, docid long, rank int")
    out = M.aggregate_metrics(M.per_query_metrics(M.label_pairs(run, qrels), M.ideal_from_qrels(qrels))).first()
    assert out.num_queries == 2 and out.mrr_at_10 == 0.5 and out.map == 0.5 and out.recall_at_100 == 0.5


def test_passage_lines_split_and_strip_like_unicode_text(spark):
    from trawl.sources.textformats import scan_passage_lines

    df = spark.createDataFrame([(1, "a\rb\u2028c\n\u00a0\nd\r\n e \u3000")], "id long, text string")
    assert [r.line for r in scan_passage_lines(df).orderBy("line_no").collect()] == ["a", "b", "c", "d", "e"]
