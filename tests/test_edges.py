"""Small cases beyond the driver tables: short items, empty inputs, ties, lost files."""

import numpy as np
import pytest

from trawl.operators import joins as J
from trawl.operators import knn as K
from trawl.operators.encoding import encode_texts, letter_counts
from trawl.operators.lexical import containment_qrels
from trawl.operators.triples import mix_sources
from trawl.plans import bindings as B
from trawl.plans import evaluate as E
from trawl.session import remove_dir, scratch_dir
from trawl.sources import sinks as SK


def test_containment_matches_brute_force_for_items_of_any_length(spark):
    docs = {1: "seafood and salt", 2: "a food\nbar", 3: "", 4: None, 5: "...!?", 6: "x\U0001f600yz food", 7: "the whole five word item is here"}
    items = {10: "foo", 11: "food", 12: "food bar", 13: "", 14: None, 15: "!?", 16: "\U0001f600y", 17: "o", 18: "d\nb",
             19: "whole five word item", 20: "food", 21: "nowhere", 22: "d and s"}
    got = containment_qrels(spark.createDataFrame(list(items.items()), "id long, text string"),
                            spark.createDataFrame(list(docs.items()), "id long, text string")).collect()
    expected = {(q, d) for q, i in items.items() for d, t in docs.items() if i is not None and t is not None and i in t}
    assert {(r.qid, r.docid) for r in got} == expected
    assert len(got) == len(expected)


def test_containment_of_short_items_is_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "some food")], "id long, text string")
    items = spark.createDataFrame([(1, "foo"), (2, "")], "id long, text string")
    plan = containment_qrels(items, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ivf_gives_k_rows_and_high_recall(spark, sf0001):
    q = B.v_queries(spark, sf0001).select("qid", "qvec")
    p = B.v_passages(spark, sf0001).select("docid", "dvec")
    n, k = p.count(), 5
    approx = K.knn_join_ivf(q, p, k, exclude_self=True, nprobe=1).cache()
    assert {r["count"] for r in approx.groupBy("qid").count().collect()} == {min(k, n - 1)}
    default = K.knn_join_ivf(q, p, k, exclude_self=True)
    assert K.knn_recall(default, E.v_dense_run(spark, sf0001, k), k).first().knn_recall >= 0.9


def test_ivf_without_passages_is_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    p = spark.createDataFrame([], "docid long, dvec array<float>")
    assert K.knn_join_ivf(q, p, 3).collect() == []


def test_lost_table_fails_the_row_check_and_origin_is_kept(spark):
    path = scratch_dir(spark, "lost")
    spark.range(5).write.parquet(f"{path}/t")
    SK.snapshot_manifest(spark, {"t": f"{path}/t"}, f"{path}/m", "full", {"t": {"repo": "r", "revision": "abc"}})
    row = spark.read.parquet(f"{path}/m").first()
    assert (row.repo, row.config, row.split, row.revision) == ("r", None, None, "abc")
    expected = spark.createDataFrame([("t", 5)], "table_name string, expected_rows long")
    assert SK.check_row_counts(spark, f"{path}/m", expected).first().ok
    remove_dir(spark, f"{path}/t")
    assert not SK.check_row_counts(spark, f"{path}/m", expected).first().ok
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SK.snapshot_manifest(spark, {"t": f"{path}/t"}, f"{path}/m", "full")


def test_split_id_overlap_counts_rows_and_skips_null(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    b = spark.createDataFrame([(1,), (3,), (None,)], "id long")
    assert [tuple(r) for r in J.split_id_overlap(a, b).collect()] == [(1, 2, 1)]


def test_mixing_numbers_rows_that_tie_by_their_ids(spark):
    rows = [(q, 1, n) for q in range(4) for n in range(3)]
    mixed = mix_sources(spark.createDataFrame(rows[::-1], "query_id long, positive_id long, negative_id long"), None, 1.0,
                        official_order="positive_id").orderBy("mix_key").collect()
    assert [(r.query_id, r.positive_id, r.negative_id) for r in mixed] == rows


def test_encoder_keeps_rows_and_feeds_the_join(spark):
    docs = spark.createDataFrame([(1, "tee"), (2, None), (3, "")], "id long, text string")
    vecs = {r.id: list(r.vec) for r in encode_texts(docs, letter_counts).collect()}
    assert vecs[1][:2] == [2.0, 1.0] and not np.any(vecs[2]) and not np.any(vecs[3])
    enc = encode_texts(docs, letter_counts)
    top = K.knn_join_exact(enc.selectExpr("id as qid", "vec as qvec"), enc.selectExpr("id as docid", "vec as dvec"), 1)
    assert {(r.qid, r.docid) for r in top.collect()} >= {(1, 1)}


def test_exact_quantile_matches_numpy_per_group(spark):
    import numpy as np

    from trawl.operators.util import exact_quantile

    rng = np.random.default_rng(3)
    hot = np.round(rng.normal(size=3001), 2).tolist()
    rows = [("hot", v) for v in hot] + [("ties", 1.0)] * 500 + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.quantile for r in exact_quantile(df, "v", q, ("g",)).collect()}
        want = {g: np.quantile([v for k, v in rows if k == g and v is not None], q) for g in ("hot", "ties", "one", "two")}
        assert got.keys() == want.keys()
        assert all(abs(got[g] - want[g]) < 1e-12 for g in want)
    assert abs(exact_quantile(df, "v", 0.9).first()[0] - np.quantile([v for _, v in rows if v is not None], 0.9)) < 1e-12
    assert exact_quantile(df.where("g = 'none'"), "v", 0.9).first()[0] is None
