"""Registered queries of the corpus operators: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import byte_bpe, conversations, huffman, line_runs, maxent, near_dedup, neighbours, packing, pii, quality, resample, tokens, toxicity
from trawl.llm import exact_dedup as exact
from trawl.llm.labelled import id_remainder
from trawl.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_prefix_forest")
def nearest_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


@query("op2_maxent")
def language_scores(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def byte_bpe_digests(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_quality")
def quality_scores(spark, sf_dir):
    scores = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_minmax_dedup")
def near_groups(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("row_id")


@query("op6_packing")
def packed(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Tokenise, close each document with id 1, pack; one row per piece. A null or empty text is
    its end id; repeated rows are packed each; an empty table gives none. ``docs`` must come
    straight from files."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    ids = tokens.encode(exact.with_rows(docs), vocabulary, end_id=1, keep=("doc_id", "row_id"))
    with open(vocabulary, encoding="utf-8") as f:
        dtype = tokens.id_type(f.read())
    return packing.pack(ids, packing.groups_for(docs), dtype).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_huffman_ids")
def huffman_ids(spark, sf_dir):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_dir(spark, "ids")
    ids = tokens.encode(exact.with_rows(table(spark, sf_dir, "documents")), vocabulary, end_id=2, keep=("doc_id", "row_id"))
    ids.write.option("compression", "zstd").parquet(f"{path}/encoded")
    with open(vocabulary, encoding="utf-8") as f:
        dtype = tokens.id_type(f.read())
    huffman.write_files(spark.read.parquet(f"{path}/encoded"), f"{path}/files", dtype)
    return huffman.read_files(spark, f"{path}/files").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)""")
def exact_groups(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("row_id")


@query("op9_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.toxicity_scores(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _of_kinds(spans, *kinds):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op10_pii")
def pii_spans(spark, sf_dir):
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    kinds = ("email", "ip", "card", "phone")
    counts = [F.size(_of_kinds("spans", k)).cast("long").alias(f"n_{k}") for k in kinds]
    base = _of_kinds("spans", *kinds)
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


#: CRC-32 in SQL, four bits at a time, of the column ``s`` (fixed values of the checksum's table).
_CRC_NIBBLES = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text expression's UTF-8 bytes."""
    step = f"xor(%s >> 4, ({_CRC_NIBBLES})[(%s & 15) + 1])"
    return (f"""xor(4294967295, list_reduce(
    [4294967295::BIGINT] || CASE WHEN {text} = '' THEN []::BIGINT[] ELSE list_transform(range(octet_length(encode({text}))),
      lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT) END,
    lambda c, b: {step.replace("%s", "(" + step.replace("%s", "xor(c, b)") + ")")}))""")


@query("op11_resample", rf"""
WITH words AS (SELECT doc_id AS id, true AS corpus,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT item_id, false,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
places AS (SELECT id, corpus, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT id, corpus, w[i] AS f FROM places
  UNION ALL SELECT id, corpus, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT id, corpus, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
per AS (SELECT id, corpus, f, count(*) AS n FROM grams GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM per)),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (corpus), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT corpus), 0)::DOUBLE AS t
  FROM per JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS g FROM counts),
weights AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
  FROM per JOIN hashed USING (f) JOIN gain USING (bucket) WHERE corpus GROUP BY id),
scores AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(len(w), 0) AS n_words,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id) LEFT JOIN words ON words.id = d.doc_id AND corpus),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scores LEFT JOIN ranks USING (doc_id)""")
def resampled(spark, sf_dir):
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_line_runs", r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM keyed k LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def lines_kept(spark, sf_dir):
    kept = line_runs.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: One step of the repair in SQL: of a list of (cost, audit, rows) the least.
def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(to: str, price: str, letter: str, row: str | None = None) -> str:
    rest = f"list_prepend({row}, {to}.r)" if row else f"{to}.r"
    return f"{{'c': {to}.c + {price}, 'a': '{letter}' || {to}.a, 'r': {rest}}}"


_NO = "{'c': 1000000000::BIGINT, 'a': '', 'r': []::VARCHAR[]}"


def _of(state: int) -> str:
    """Least option of a state that takes the row f from the states r.s0 to r.s3 behind it."""
    to, role = (3, "assistant") if state == 2 else (2, "user")
    cut = "f.cut::BIGINT"
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]
    kept = [f"CASE WHEN f.must OR f.ini <> '{i}' THEN {_NO} ELSE {_edit(f'r.s{q}', cut, 'K', 'f.line')} END" for i, q in keep]
    given = f"CASE WHEN f.must THEN {_NO} ELSE {_edit(f'r.s{to}', f'2 + {cut}', 'R', f"'{role}:' || f.text")} END"
    return _least(_edit(f"r.s{state}", "3", "D"), given, *kept)


@query("op13_repair", rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations),
changed AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE fate <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM changed),
flaws AS (SELECT *, left(role, 1) AS ini, role || ':' || text AS line, blank OR again AS must,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM seen),
steps AS (SELECT conv_id, max(i) + 1 AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s0,
    {{'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}} AS s1, {{'c': 2::BIGINT, 'a': 'I', 'r': ['assistant:']}} AS s2,
    {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s3 FROM flaws GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_least("b0", _edit("t2", "2", "I", "'user:'"))}, {_least("b1", _edit("t2", "2", "I", "'user:'"))}, t2, t3 FROM (
    SELECT *, {_least("b2", _edit("b3", "2", "I", "'assistant:'"))} AS t2, {_least("b3", _edit("b2", "2", "I", "'user:'"))} AS t3 FROM (
      SELECT f.conv_id, f.i, {_of(0)} AS b0, {_of(1)} AS b1, {_of(2)} AS b2, {_of(3)} AS b3
      FROM steps r JOIN flaws f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1))),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT must) AS truncated,
    count(*) FILTER (i > 1 AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM flaws GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = 1""")
def repaired(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_report(rows, conversations.damaged(rows))
