"""Corpus operators against brute force, round trips and the edge cases of their docstrings."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import byte_bpe, exact_dedup, huffman, maxent, near_dedup, neighbours, packing, pii, quality, queries, tokens, toxicity
from trawl.llm.arrays import word_rows
from trawl.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lang wort " * 4000
ODD = [None, "", " ", "a", "A  a\n", "x" * 5000, LONG, "Ünï 日本 <|endoftext|> don't 12345", "one two three four five six seven"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, block int"


def frame(spark, path, texts, ids=None):
    """A written table (as the operators expect) with clashing extra columns."""
    rows = [(i, t, None, "s", None, "clash", 7) for i, t in zip(ids or range(len(texts)), texts)]
    out = f"file://{path}/docs"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return rng, vocab


def test_word_hashes_tell_words_apart(words):
    rng, vocab = words
    texts = [*ODD, " ".join(rng.choice(vocab) for _ in range(3000)), "A a Ä ä\x0bb\x1fc"]
    seen = {}
    for lo, hi, h, ptr in word_rows(pa.array(texts), most=64):
        for k in range(lo, hi):
            found = WORD.findall((texts[k] or "").translate(LOWER))
            mine = h[ptr[k - lo]:ptr[k - lo + 1]].tolist()
            assert len(found) == len(mine)
            assert all(seen.setdefault(w, x) == x for w, x in zip(found, mine))
    assert len(set(seen.values())) == len(seen)


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).round(3)
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 8), (951, [float("nan")] * 8), (952, [1.0, None]), (None, [1.0] * 8), (960, [])]
    df = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float32).astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    assert set(got) == set(range(0, 400, 50))
    for q, found in got.items():
        cos = x @ x[q] / (size * size[q])
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(cos[i], 12), i))[:5]
        assert [v for _, v, _ in sorted(found)] == want
        assert all(abs(cos[v] - s) < 1e-9 for _, v, s in found)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_language_model_base_and_gain(spark, tmp_path, words):
    rng, vocab = words
    texts = [" ".join(rng.choice(vocab[:60]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ODD
    ids = list(range(200)) + [300 + k for k in range(len(ODD))]
    out = {r.doc_id: r for r in maxent.score(frame(spark, tmp_path, texts, ids)).collect()}
    split = {i: WORD.findall((t or "").translate(LOWER)) + ["\n"] for i, t in zip(ids, texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in ids}
    c = Counter(w for i in ids if not held[i] for w in split[i])
    total = sum(c.values())
    for i in ids:
        r = out[i]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in split[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(split[i]), sum(c[w] > 0 for w in split[i]), total)
        assert abs(r.base_score - base) < 1e-6 and math.isfinite(r.score) and r.score <= 0
    assert maxent.score(frame(spark, tmp_path / "none", [])).count() == 0


def test_language_model_tells_words_of_a_class_by_the_last_word(spark, tmp_path):
    texts = ["left foba", "right goba"] * 60 + ["left goba", "right foba"]
    out = {r.doc_id: r.score for r in maxent.score(frame(spark, tmp_path, texts)).collect()}
    assert out[0] > out[120] + 0.3 and out[1] > out[121] + 0.3
    assert out[0] == out[2] and len(out) == len(texts)


def test_language_model_grows_with_its_training_tokens():
    ones = np.ones((maxent.CLASSES, 16))
    small, large, most = (maxent.Model(n * 10**8, 1, [], ones, ones) for n in (1, 4, 10**6))
    assert (small.bits, large.bits, most.bits) == (maxent.BITS, maxent.BITS + 1, maxent.MOST_BITS)
    assert [maxent.part_bits(n * 10**8) - maxent.PART_BITS for n in (1, 16, 10**6)] == [0, 1, 2]


def _mix(x):
    """The 64-bit finaliser on a plain number."""
    return int(maxent.mix(np.array([x], np.uint64))[0])


def _log10_of_word(model, codes, i, word, count, shape):
    """log10 P(word | the codes before place i), one number at a time."""
    one, two = (codes[i - 1] if i > 0 else 1), (codes[i - 2] if i > 1 else 1 if i == 1 else 2)
    kind = int(maxent.kinds_of(np.array([word], np.uint64), np.array([shape]), np.array([count]), model.parts, model.singles)[0])
    c, part = divmod(kind, model.parts)
    keys = [one, _mix(one << 32 | two) >> 32, two]
    step, shift = 1 << model.bits, 32 - model.bits
    z0 = model.bias[0] + sum(model.weights[0][k * step + (key >> shift)] for k, key in enumerate(keys))
    z1 = model.bias[1][c] + sum(model.weights[1][k * step + ((_mix((c + 1) << 32 | key) >> 32) >> shift)] for k, key in enumerate(keys))
    out = sum((float(z[t]) - math.log(np.exp(z.astype(float)).sum())) / math.log(10) for z, t in ((z0, c), (z1, part)))
    return out + (math.log10((count + 0.1) / model.sums[c, part]) if kind > maxent.UNKNOWN else 0.0)


def test_language_model_scores_equal_a_plain_sum_and_words_sum_to_one(spark, tmp_path, words):
    rng, vocab = words
    texts = [" ".join(rng.choice(vocab[:90]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "never seen anywhere"]
    docs = frame(spark, tmp_path, texts)
    model = maxent._trained(docs, "doc_id", "text", 10, 0)[0]
    out = {r.doc_id: r for r in maxent.score(docs).collect()}

    def tokens(text):
        data, offsets = maxent.text_buffer(pa.array([text], pa.string()))
        return maxent._with_ends(data, offsets)[0].tolist(), maxent._shapes(data, offsets).tolist()

    split = [tokens(t) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    count = Counter(h for (hs, _), x in zip(split, held) if not x for h in hs)
    for i in range(0, len(texts), 7):
        codes = [_mix(h) >> 32 for h in split[i][0]]
        want = sum(_log10_of_word(model, codes, k, h, count[h], s) for k, (h, s) in enumerate(zip(*split[i])))
        assert abs(out[i].score - want) < 1e-3 * max(1, len(codes)), i
    shape = {h: s for hs, ss in split for h, s in zip(hs, ss)}
    for codes in ([], [_mix(split[0][0][0]) >> 32], [7, 9]):
        every = [_log10_of_word(model, codes, len(codes), h, n, shape[h]) for h, n in count.items()]
        unseen = _log10_of_word(model, codes, len(codes), 12345, 0, 0)
        assert abs(sum(10**x for x in every) + 10**unseen - 1) < 1e-4


def test_byte_bpe_equals_tiktoken_and_round_trips(spark, tmp_path):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab Z  \n\t'sé1.,% \x00\x1f日😀▁") for _ in range(30)) for _ in range(200)]
    ids = byte_bpe.encode(frame(spark, tmp_path, texts), path, P.PATTERN)
    for r in byte_bpe.decode(ids, path).collect():
        assert r.ids == engine.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_quality_learns_and_scores_every_row(spark, tmp_path, words):
    rng, vocab = words
    texts = [" ".join(rng.choice(vocab) + ("%%%" if k % 4 == 0 else "") for _ in range(60)) for k in range(240)] + ODD
    docs = frame(spark, tmp_path, texts)
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held) >= 0.9 * len(held)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
            comp = [new if c == old else c for c in comp]
    return comp, [len(s) for s in sets]


def test_near_groups_match_brute_force(spark, tmp_path, words):
    rng, vocab = words
    texts = list(ODD)
    for _ in range(4):
        first = [rng.choice(vocab) for _ in range(120)]
        for _ in range(25):
            copy = list(first)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts += texts[-3:] + ["A B", "a  b"]
    want, size = brute_components(texts)
    out = near_dedup.near_groups(frame(spark, tmp_path, texts)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], size[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.near_dedup(frame(spark, tmp_path / "none", [])).count() == 0


def test_left_over_rows_are_compared(spark, monkeypatch, tmp_path, words):
    """A chain of small edits: no pivot is similar to all, links are found in small chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    rng, vocab = words
    now, texts = [rng.choice(vocab) for _ in range(150)], []
    for k in range(24):
        texts.append(" ".join(now))
        now = list(now)
        for j in range(3):
            now[(k * 17 + j * 5) % 150] = f"new{k}x{j}"
    want, _ = brute_components(texts)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(frame(spark, tmp_path, texts)).collect()} == dict(enumerate(want))


def test_components_of_a_chain_and_repeats(spark):
    links = [(k, k + 1) for k in range(40)] + [(3, 2), (100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def word_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_packing_covers_every_token_once(spark, tmp_path, words):
    rng, vocab = words
    texts = ODD + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    want = word_ids(texts, 1)
    out = queries.packed_documents(frame(spark, tmp_path, texts)).collect()
    for d, ids in enumerate(want):
        at = 0
        for r in sorted((r for r in out if r.doc_id == d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    by = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048 and len(by) == -(-sum(map(len, want)) // 2048)


def test_differencing_is_near_equal_and_counts_rise():
    rng = random.Random(1)
    sizes = [rng.randint(1, 2000) for _ in range(400)]
    sets = packing.differencing(sizes, 60)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(400))
    assert max(sums) - min(sums) < 0.03 * sum(sums) / 60
    whole = packing.pack_lengths([1500, 1500, 1500], cut=False)
    assert len(whole) == 3 and all(len(w) == 1 for w in whole)
    assert packing.pack_lengths([]) == [] and packing.pack_lengths([0, 0]) == []


def test_exact_groups_match_brute_force(spark, tmp_path):
    texts = [*ODD, *ODD, "a\t b", "a b", " a b", LONG + "x", LONG + "x", LONG + "y"]
    ids = [*range(len(texts) - 2), 2, None]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    out = exact_dedup.exact_groups(frame(spark, tmp_path, texts, ids), block_bytes=64).collect()
    want = sorted((min((i for i, m in zip(ids, norm) if m == n and i is not None), default=None), norm.count(n), hashlib.sha256(n.encode()).hexdigest())
                  for n in norm if any(i is not None for i, m in zip(ids, norm) if m == n))
    got = sorted((r.keep_id, r.group_size, r.text_sha256) for r in out if r.keep_id is not None)
    assert got == want and sum(r.kept for r in out) == len(set(norm)) and len(out) == len(texts)
    kept = exact_dedup.exact_dedup(frame(spark, tmp_path, texts, ids))
    assert kept.count() == len(set(norm)) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "block"]
    assert exact_dedup.exact_groups(frame(spark, tmp_path / "none", [])).count() == 0


def test_huffman_files_round_trip(spark, tmp_path):
    texts = [*ODD, *ODD, "of the and"] * 3
    want = word_ids(texts, 2)
    docs = tokens.encode(exact_dedup.with_rows(frame(spark, tmp_path, texts)), P.path("word_bpe_49k.json"), end_id=2, keep=("doc_id", "row_id"))
    docs.write.parquet(f"file://{tmp_path}/encoded")
    huffman.write_files(spark.read.parquet(f"file://{tmp_path}/encoded"), f"file://{tmp_path}/files", "<u2", partitions=4)
    at = 0
    for r in sorted(huffman.read_files(spark, f"file://{tmp_path}/files").collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens) == (at, len(want[r.doc_id])) and bytes(r.ids) == want[r.doc_id].tobytes()
        at += r.n_tokens


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 50, 300):
        counts = (rng.pareto(0.5, size) * 50 + 1).astype(np.int64)
        lengths = huffman.code_lengths(counts, 9)
        assert lengths.max() <= 9 and (size == 1 or abs((2.0 ** -lengths).sum() - 1) < 1e-12)
        codec = huffman.Codec(lengths)
        n = rng.integers(0, 600, 12)
        ids = rng.integers(0, size, n.sum())
        payload, _, marks = codec.encode(ids, np.concatenate([[0], np.cumsum(n)]))
        assert (codec.decode(payload, n, marks) == ids).all()


def test_grammar_weighs_context():
    base = toxicity.Matcher(toxicity._base_lexicon())
    kinds = lambda t: [m[0] for m in base.matches(t)]
    assert kinds("what an idiot") == ["insult"]
    assert kinds("you are an idiot.") == ["targeted"]
    assert kinds("this is not an idiot") == ["negated"]
    assert kinds("he said idiot") == ["reported"]
    assert kinds('the word "idiot" is old') == ["reported"]
    assert kinds("I will kill you") == ["threat"]
    assert kinds("kill the process") == [] and kinds("idiotproof") == [] and kinds("") == []
    weight = lambda t: base.matches(t)[0][3]
    assert weight("you idiot") > weight("an idiot") > weight("not an idiot") and weight("an idiot") > weight("he said idiot")


def test_grammar_runs_over_whole_clauses():
    base, far = toxicity.Matcher(toxicity._base_lexicon()), "wort " * 200
    kinds = lambda t: [m[0] for m in base.matches(t)]
    assert kinds(f"he said {far}idiot") == kinds(f"he said {far}. no: he said {far}idiot") == ["reported"]
    assert kinds(f"an idiot {far}calling him scum") == ["insult", "reported"] and kinds(f"he said {far}. idiot") == ["insult"]
    assert kinds("idiot" + " " * 396 + "yourself kill") == ["insult"]
    assert kinds("stupid " + "x" * 391 + " kill you") == ["insult", "threat"]


def test_toxicity_finds_planted_and_spares_clean(spark, tmp_path, words):
    rng, vocab = words
    texts = [" ".join([rng.choice(vocab) for _ in range(50)] + (["you", "stupid", "moron"] if k % 5 == 0 else [])) for k in range(200)] + ODD
    docs = frame(spark, tmp_path, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxicity.fitted(docs, labels)).collect()}
    assert len(out) == len(texts) and all((s >= 0.5) == (k < 200 and k % 5 == 0) for k, s in out.items())
    left = toxicity.without_toxic(docs, toxicity.fitted(docs, labels.limit(0)))
    assert left.count() == len(texts) - 40 and left.columns == docs.columns


def test_learned_words_count_all_but_real_copies(spark):
    common = [f"common{k}" for k in range(40)]
    rows = [(k, " ".join([*common, f"own{k}", "blorg" if k % 3 == 0 else "plain"]), int(k % 3 == 0)) for k in range(90)]
    rows += [(100 + k, "Zonk  zonk\n" + "again " * (k % 2) + "zonk", 1) for k in range(40)]  # two texts, copied
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert lexicon["blorg"] == (toxicity.INSULT, 30 / 31) and "zonk" not in lexicon and "plain" not in lexicon


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_spans_match_plain_expressions():
    rng = random.Random(8)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in ("0123456789+.-@ ()aB%_é\n", "01+.-@a ", "4111 1111-2.") for _ in range(4000)]
    for t in texts:
        assert [s[:3] for s in pii.find_spans(t) if s[0] != "iban"] == plain_spans(t)
    assert pii.find_spans("IBAN DE89 3702 0500 0001 2345 67")[:1] == [] and pii.mod97("GB82WEST12345698765432")
    assert ("iban", 5, 27) in [s[:3] for s in pii.find_spans("iban GB82WEST12345698765432")]


def test_ibans_end_before_words_in_capitals():
    code = "DE89 3704 0044 0532 0130 00"
    for head in ("", "Konto ", "REF AB12 ", "AB12 CD34 "):
        for tail in ("", ".", " EUR 500", " BIC COBADEFFXXX", " 2024 XY", " and GB82 WEST 1234 5698 7654 32 EUR"):
            spans = [(a, b) for kind, a, b, _ in pii.find_spans(head + code + tail) if kind == "iban"]
            assert spans[0] == (len(head), len(head) + len(code)) and len(spans) == 1 + ("GB82" in tail)
    assert [s[:3] for s in pii.find_spans("ZZ12 3456 7890 1234 5678 EUR 5")] == []
    k = next(k for k in range(2, 99) if pii.mod97(f"ZZ{k:02d}12345678901234"))
    assert ("iban", 0, 18) in [s[:3] for s in pii.find_spans(f"ZZ{k:02d}12345678901234 OK")]  # no known length
    assert pii.find_spans(code + "X") == []
    assert pii.redact(f"pay {code} EUR 500") == "pay [IBAN] EUR 500"


def test_redaction_covers_overlapping_spans():
    assert pii.redact("call +49 170-1234567-bob@x.com now") == "call [PHONE] now"
    assert pii.redact("a.b@c.de, 10.0.0.1") == "[EMAIL], [IP]" and pii.redact("none") == "none"


def test_pii_tables_keep_rows(spark, tmp_path):
    texts = [*ODD, "mail a.b@c.de now", "card 4111 1111 1111 1111", None]
    docs = frame(spark, tmp_path, texts)
    assert {r.doc_id: len(r.spans) for r in pii.pii_spans(docs).collect()} == {k: len(pii.find_spans(t or "")) for k, t in enumerate(texts)}
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert len(out) == len(texts) and out[len(ODD)].text == "mail [EMAIL] now" and out[0].text is None and out[len(ODD)].n_chars == 16


def test_pipeline_stages_take_effect(spark, sf0001):
    import corpus_pipeline

    docs = queries.table(spark, sf0001, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf0001)
        assert out.columns == queries.table(spark, sf0001, "documents").columns
        path = f"{queries.scratch_dir(spark, 'test')}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0.7 * counts[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf0001)
    assert rows.agg(F.count_distinct("doc_id")).first()[0] == counts[4]


def test_every_operator_is_registered_once():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.ORACLE) == {"op7_exact_dedup", "op11_resample", "op12_line_runs", "op13_repair"} and "pipeline" in __spark_entry__.queries()


def test_new_pretokens_are_encoded_by_one_call(monkeypatch):
    import public_tokenizers as P
    import sentencepiece

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    calls, encode = [], sentencepiece.SentencePieceProcessor.encode

    def counted(self, *args, **kwargs):
        calls.append(1)
        return encode(self, *args, **kwargs)

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", counted)
    byte_bpe.encoder.cache_clear()
    fn = byte_bpe.encoder(byte_bpe.serialise(ranks), ranks, P.PATTERN)
    texts = ["zyxquu, wvtsrq. qqzzxx", "", "ab!, c... d.\ne é, ü. ×, it's,", " lead x", "a\x00b, c", "x ,y  z."]
    found = fn(texts)
    assert len(calls) == 1
    byte_bpe.encoder.cache_clear()
    import regex

    engine, chars = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.serialise(ranks)), tokens.byte_characters()
    rank = {t: k for k, t in enumerate(ranks)}
    for text, ids in zip(texts, found):
        want = []
        for p in regex.findall(P.PATTERN, text):
            raw = p.encode()
            want += [rank[raw]] if raw in rank else encode(engine, "".join(chars[b] for b in raw))
        assert np.frombuffer(ids, "<u4").tolist() == want


def test_marks_and_capitals_share_the_ids_of_a_word():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    whole = Tokenizer.from_str(vocabulary)
    whole.encode_special_tokens = True
    tokens.encoder.cache_clear()
    fn = tokens.encoder(vocabulary, "<u2")
    words = fn.__closure__[[c for c in fn.__code__.co_freevars].index("words")].cell_contents
    fn(b"Zyxquu, zyxquu. ZYXQUU zyxquu,\nzyxquu ")
    assert set(words) == {b"zyxquu", b",", b"."}
    for text in ("A!, b... c.\nd é, Ü. ×, ÷. it's, x", "H̱, Ḱ. İ, K", "_, 1. (a), ,", "ÀB, é. ab\x1c, \xa0.", ". , ."):
        assert np.frombuffer(fn(text.encode()), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_are_counted_many_rows_at_once(spark):
    rows = [(i, np.array([i % 7, 40_000] if i % 3 else [], "<u2").tobytes()) for i in range(1000)]
    frame_ = spark.createDataFrame(rows, "doc_id long, ids binary")
    counts = huffman.count_ids(frame_, "<u2")
    want = np.bincount([x for _, ids in rows for x in np.frombuffer(ids, "<u2").tolist()])
    assert counts.tolist() == want.tolist()
    assert 1 < huffman.COUNTED < 5000
