"""Resampling, line dedup and conversation repair against brute force and their edge cases."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import conversations, line_runs, queries, resample
from trawl.llm.arrays import text_buffer
from trawl.llm.order import numbered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "A  a\n", "x" * 5000, "lang wort " * 4000, "Ünï 日本" + "語" * 40 + " don't 12345", "Z" * 40 + " b " + "c" * 33]
DOCS = "doc_id long, text string, n_words long, row_id string, bucket int, doc string, key string, _part int"
CLASH = (3, "r", 4, "d", "k", 5)


def written(spark, path, rows, schema):
    out = f"file://{path}"
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


# ---------------------------------------------------------------- resampling

def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def resampled(docs, target, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))

    rows = []
    for i, text in docs:
        n, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_gram_buckets_are_those_of_the_joined_words():
    texts = [*ODD, "ab " * 70, "é" * 16 + "a " + "é" * 17]
    b, second, third, ptr = resample.gram_buckets(*text_buffer(pa.array(texts)))
    for k, text in enumerate(texts):
        mine = slice(ptr[k], ptr[k + 1])
        got = [*b[0][mine], *b[1][mine][second[mine]], *b[2][mine][third[mine]]]
        assert got == [bucket(f) for f in grams(text)[1]]
    empty = resample.gram_buckets(*text_buffer(pa.array([None, ""], pa.string())))
    assert empty[0].shape == (3, 0) and empty[3].tolist() == [0, 0, 0]


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_resampling_equals_brute_force_with_ties_and_nulls(spark, tmp_path, percent):
    rng = random.Random(percent)
    vocab = ["".join(rng.choice("abcdé9") for _ in range(rng.randint(1, 5))) for _ in range(50)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(500 + i, t) for i, t in enumerate(ODD)] + [(7, "same words " * 20)] * 9 + [(None, "no id " * 30)] * 3
    target = [" ".join(rng.choice(vocab[:10]) for _ in range(40)) for _ in range(20)]
    table = written(spark, tmp_path / "docs", [(*d, *CLASH) for d in docs], DOCS)
    aim = spark.createDataFrame([(t, None) for t in [*target, None]], "text string, doc_id string")
    out = resample.resample(table, aim, percent=percent).collect()
    want = resampled(docs, target, percent)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out)
    assert got == want


def test_resampling_of_small_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string"
    none = written(spark, tmp_path / "none", [], schema)
    aim = spark.createDataFrame([("a b c",)], "text string")
    assert resample.resample(none, aim).count() == 0
    few = written(spark, tmp_path / "few", [(i, "w " * 25) for i in range(19)], schema)
    assert [r["rank"] for r in resample.resample(few, aim.limit(0)).collect()] == [None] * 19


def test_cutoff_counts_exactly(spark):
    values = [-(2**62), -5, -5, -5, 0, 1, 1, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for need in range(1, 9):
        v, less, equal = resample.cutoff(rows, "v", need)
        assert v == values[need - 1] and less == sum(x < v for x in values) and equal == values.count(v)


def test_rows_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i % 3 + 1) for i in range(50)], "k long, n long")
    got = numbered(rows, [F.desc("k")], repeat="n").orderBy("position").collect()
    want = [(k, c) for k, n in sorted(((i * 7 % 50, i % 3 + 1) for i in range(50)), reverse=True) for c in range(n)]
    assert [(r.k, r["copy"]) for r in got] == want and [r.position for r in got] == list(range(len(want)))
    assert numbered(rows.limit(0), ["k"]).count() == 0


# ---------------------------------------------------------------- line dedup

def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def kept_lines(docs):
    holders = defaultdict(list)
    for i, text in docs:
        for key in {line_key(x) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                holders[key].append(-1 if i is None else i)
    keep = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if keep.get(line_key(x), -1 if i is None else i) == (-1 if i is None else i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


def line_docs(seed):
    rng = random.Random(seed)
    lines = [f"Line number {k} {'é' * (k % 9)}" + "x" * rng.randint(0, 14) for k in range(40)] + ["", " ", "short", "\t" + "pad" * 8 + "\r", "日" * 19, "日" * 20]
    docs = [(i, "\n".join(rng.choice(("{}", " {}", "{}\x0b")).format(x.upper() if rng.random() < 0.2 else x)
                          for x in rng.choices(lines, k=rng.randint(0, 6)))) for i in range(90)]
    return docs + [(None, lines[3] + "\n" + lines[3]), (None, "no id holds this line alone"), (None, "no id holds this line alone"),
                   (None, "no id holds this line alone"), (1000, None), (1001, "the last id is repeated"), (1001, "the last id is repeated"), (3, "the last id is repeated")]


@pytest.mark.parametrize("batches", [1, 8])
def test_line_dedup_equals_brute_force(spark, tmp_path, batches):
    docs = line_docs(batches)
    table = written(spark, tmp_path / "docs", [(*d, *CLASH) for d in docs], DOCS)
    got = line_runs.deduplicated(table, batches=batches).select("doc.doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == kept_lines(docs)


def test_line_dedup_keeps_columns_and_takes_empty_tables(spark, tmp_path):
    table = written(spark, tmp_path / "docs", [(*d, *CLASH) for d in line_docs(3)], DOCS)
    out = line_runs.line_dedup(table)
    assert out.dtypes == table.dtypes and out.drop("text").exceptAll(table.drop("text")).count() == 0
    none = written(spark, tmp_path / "none", [], DOCS)
    assert line_runs.line_dedup(none).count() == 0


def test_runs_are_compacted_by_level_and_hold_exact_counts(spark):
    runs = line_runs.LineRuns(spark, enough=3, fanout=2)
    assert runs.repeated().count() == 0
    want = Counter()
    for k in range(5, 0, -1):  # largest ids first
        batch = [(10 * k + j, bytes([j % 4, x])) for j in range(3) for x in range(k)]
        want.update(key for _, key in batch)
        runs.add(spark.createDataFrame(batch, "doc_id long, key binary"))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {bytes(r.key): r.keep for r in runs.repeated().collect()}
    assert got == {key: 50 + key[0] - (10 * max(0, key[1] - 4)) for key, n in want.items() if n >= 3}


# ---------------------------------------------------------------- conversation repair

def fate(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text, f = " " if role is None else role, " " if text is None else text, fate(conv, turn)
        if f == 0:
            continue
        row = (conv, turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
        out += [row] * (2 if f == 3 else 1)
    return out


def mended(rows):
    """The report of one conversation by plain search over all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), Counter()
    marks = []
    for _, _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        faults[kind] += 1
        marks.append(kind)
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(price, letter, rest, *row):
            options.append((rest[0] + price, letter + rest[1], row + rest[2]))

        if inserted < 2:
            for r, to in (("user", 2), ("assistant", 3)):
                if legal[state].get(r[0]) == to:
                    add(2, "I", best(i, to, inserted + 1), f"{r}:")
        if i < len(rows):
            add(3, "D", best(i + 1, state, 0))
            if marks[i] in (None, "truncated"):
                cut, role, text = int(marks[i] == "truncated"), rows[i][2], rows[i][3]
                if role[:1] in legal[state]:
                    add(cut, "K", best(i + 1, legal[state][role[:1]], 0), f"{role}:{text}")
                for r in ("user", "assistant"):
                    if r[0] in legal[state]:
                        add(2 + cut, "R", best(i + 1, legal[state][r[0]], 0), f"{r}:{text}")
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], bad, cost, audit, out


def talks(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "unknown", "tool"]
    texts = ["Yes.", "No?", "cut off", " ", None, "!", "Ünï.\n", "a", "b.", "c.", "d!", "long text. " * 30]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(0, 12)):
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += [(100, t, "user" if t % 2 else "assistant", f"hot {t % 37}" + "." * (t % 3)) for t in range(150)]
    rows += [(101, 5, "user", "same.")] * 40 + [(101, 6, "assistant", "ok.")]
    rows += [(None, None, "user", "no id."), (None, 1, "assistant", "x."), (102, None, "user", "a."), (102, None, "user", "b."), (102, 4, "assistant", "c.")]
    rows += [(103, t, "user", " ") for t in range(30)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, ckey string, position int, block string"


@pytest.mark.parametrize("block", [4096, 4])
def test_repair_equals_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = talks(block)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    changed = damage(rows)
    got = {r.conv_id: r for r in conversations.repair_report(table, conversations.damaged(table)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = mended([x for x in changed if x[0] == conv])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:7], conv
        assert r.repaired_sha256 == hashlib.sha256("\n".join(want[7]).encode()).hexdigest()
        initials = "".join(x[0] for x in want[7])
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_repaired_rows_are_the_digested_ones(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 8)
    rows = talks(1)
    changed = conversations.damaged(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA))
    found = defaultdict(list)
    for r in conversations.Repair(changed).rows().collect():
        found[r.conv_id].append((r.position, r.place, f"{r.role}:{r.text}"))
    plain = damage(rows)
    for conv in {r[0] for r in plain}:
        assert [x for _, _, x in sorted(found.get(conv, []))] == list(mended([x for x in plain if x[0] == conv])[7])


def test_repair_of_an_empty_table_and_of_nothing_left(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_report(none, conversations.damaged(none)).count() == 0
    gone = next(t for t in range(1000) if fate(7, t) == 0)
    lost = spark.createDataFrame([(7, gone, "user", "x", "", 0, "")], SCHEMA)
    r = conversations.repair_report(lost, conversations.damaged(lost)).first()
    assert tuple(r) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_ranked_paths_are_the_least_of_all_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(200):
        codes = rng.integers(0, 4, rng.integers(1, 9)) + 4 * (rng.random() < 0.3) * rng.integers(0, 2) + 8 * rng.integers(0, 2)
        paths = conversations.Paths([(codes, conversations.END, True)])
        audit = "".join(" DIKR"[paths.letter[n]] for n in paths.nodes(0, conversations.START)).strip()

        @functools.cache
        def best(i, state, n):
            options = [(0, "")] if i == len(codes) and state in (0, 3) else []
            nxt = int(conversations.NEXT[state])
            if n < 2:
                c, a = best(i, nxt, n + 1)
                options.append((c + 2, "I" + a))
            if i < len(codes):
                code = int(codes[i])
                c, a = best(i + 1, state, 0)
                options.append((c + 3, "D" + a))
                if not code & 4:
                    c, a = best(i + 1, nxt, 0)
                    options.append((c + 2 + (code >> 3), "R" + a))
                    to = int(conversations.KEEP[code & 3][state])
                    if to < 4:
                        c, a = best(i + 1, to, 0)
                        options.append((c + (code >> 3), "K" + a))
            return min(options, default=(10**9, ""))

        assert audit == best(0, 0, 0)[1]


# ---------------------------------------------------------------- shared parts

def test_sized_joins_match_plain_ones_with_a_large_key(spark, tmp_path, monkeypatch):
    from trawl.llm import skew

    monkeypatch.setattr(skew, "LEAST", 20)
    keys = [(1, 1)] * 500 + [(i % 40, 2) for i in range(400)]
    rows = written(spark, tmp_path / "rows", [(*k, i) for i, k in enumerate(keys)], "a long, b long, row long")
    table = written(spark, tmp_path / "table", [(*k, n, f"{k}") for k, n in Counter(keys).items()], "a long, b long, n long, name string")
    got = skew.join_sized(rows, table, ["a", "b"], "n").select("a", "b", "row", "name").collect()
    assert Counter(map(tuple, got)) == Counter((*k, i, f"{k}") for i, k in enumerate(keys))


def test_dedup_keeps_columns_of_any_name(spark, tmp_path):
    from trawl.llm import exact_dedup, near_dedup

    text = "one two three four five six seven eight"
    rows = [(i, text if i % 2 else f"{text} {i} " + "other words here " * i, i * 10, i, "d", f"r{i}") for i in range(12)]
    docs = written(spark, tmp_path / "docs", rows, "doc_id long, text string, _row long, row_id long, doc string, kept string")
    for out in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs)):
        assert out.dtypes == docs.dtypes
        kept = {r.doc_id: r for r in out.collect()}
        assert all(tuple(r) == rows[i] for i, r in kept.items()) and 1 in kept and 3 not in kept


def test_equal_blocks_of_many_rows_meet_without_their_places(spark, tmp_path):
    from trawl.llm import exact_dedup

    hot = "same block " * 900  # three blocks
    rows = [(i, hot if i % 3 == 0 else f"{hot}{i % 5}" if i % 3 == 1 else None) for i in range(300)]
    docs = written(spark, tmp_path / "docs", rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    for r in exact_dedup.exact_groups(docs).collect():
        mine = want[rows[r.doc_id][1]]
        assert (r.keep_id, r.group_size, r.kept) == (min(mine), len(mine), r.doc_id == min(mine))


def test_queries_are_registered():
    assert {"op11_resample", "op12_line_runs", "op13_repair"} <= set(queries.QUERIES) & set(queries.ORACLE)
