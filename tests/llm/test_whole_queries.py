"""All queries of the corpus operators, and the pipeline, over empty tables and over tables of
nulls, repeated rows and clashing columns: every row comes back once and nothing crashes."""

import pytest

import corpus_pipeline
from trawl.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id long, _row int, block string"
TABLES = {
    "documents": DOCS,
    "labels": "doc_id long, quality int, toxic int, text string",
    "embeddings": "vec_id long, embedding array<float>, label int, query_id string",
    "benchmark": "item_id long, text string, doc_id string",
    "conversations": "conv_id long, turn long, role string, text string, position int",
}
TEXTS = [None, "", " ", "a", "plain words of a small text here", "plain words of a small text here", "you are an idiot. mail me at a@b.cd\nline two of this text",
         "word " * 3000, "Ünï 日本 <|endoftext|> +49 170 1234567"]
ROWS = {
    "documents": [(i, t, None, "s", None, 5, 6, "b") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None, 3, 5, 6, "b")] * 2
    + [(3, "a", "en", "s", 1, 5, 6, "b")] * 2,
    "labels": [(i, i % 2, int(i == 6), "t") for i in range(len(TEXTS))] + [(None, 1, 1, "t"), (4, None, None, "t"), (4, 1, 0, "t"), (999, 1, 1, "t")],
    "embeddings": [(0, [1.0, 0.0], 1, "q"), (1, [1.0, 0.1], 1, "q"), (2, None, 0, "q"), (3, [0.0, 0.0], 0, "q"), (None, [1.0, 1.0], 0, "q"), (50, [0.5, 0.5], 0, "q")],
    "benchmark": [(0, "plain words of a small text", "d"), (1, None, "d"), (None, "", "d")],
    "conversations": [(1, 0, "user", "Hi.", 0), (1, 1, None, None, 0), (None, None, "assistant", "x", 0), (1, 0, "user", "Hi.", 0)],
}
NAMES = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))


def tables(spark, path, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).repartition(2).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_nulls_and_repeated_rows_all_come_back(spark, odd, name):
    out = queries.QUERIES[name](spark, odd).collect()
    if name.startswith("op1_"):
        assert {(r.query_id, r["rank"]) for r in out} == {(0, 1), (0, 2), (50, 1), (50, 2)}
    elif name.startswith("op6_"):
        # closed with one id, no document is without a piece; repeated ids come back as often
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.start == 0) == sorted((r[0] is None, r[0] or 0) for r in ROWS["documents"])
        places = {}
        for r in out:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in places.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
    elif name.startswith("op13_"):
        assert sorted((r.conv_id is None, r.conv_id or 0) for r in out) == [(False, 1), (True, 0)]
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in ROWS["documents"])


def test_pipeline_over_empty_and_odd_tables(spark, empty, odd):
    assert corpus_pipeline.run(spark, empty).collect() == []
    out = corpus_pipeline.run(spark, odd).collect()
    kept = {r.doc_id for r in out}
    assert 4 in kept and 5 not in kept and 0 in kept  # the smallest id of equal texts; null and empty are equal
    again = corpus_pipeline.run(spark, odd).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in again)
