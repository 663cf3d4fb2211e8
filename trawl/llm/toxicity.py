"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to symbols; further transducers mark what is reported,
what is negated and what is aimed at somebody, and an acceptor turns the marked symbols
into weighted matches. Their composition is one table, run over every clause that holds an
insult or a threat. Matches are scored, and an insult without a target is one too; the
weights of words and of kinds of match are fitted on labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrays import released
from trawl.llm.labelled import labelled_sample

#: Most labelled documents used to fit, most learned words.
SAMPLE, LEARNED = 20_000, 512
#: A learned word needs this share of toxic sample documents, this precision, and 8 documents.
SUPPORT, PRECISION, LEAST = 0.02, 0.9, 8

# The grammar's word lists.
INSULTS = ("idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool loser losers scum trash filth "
           "vermin pathetic worthless disgusting clown clowns creep jerk bastard bastards bitch asshole retard retarded degenerate "
           "trottel dummkopf abschaum versager widerlich ekelhaft arschloch "
           "imbécile connard salaud ordure débile minable "
           "idiota imbécil estúpido estúpida basura escoria patético asqueroso").split()
THREATS = "kill murder hurt destroy stab shoot beat smash crush burn töten umbringen tuer matar matarte".split()
TARGETS = ("you your yours yourself u ya he she they him them his her these those people everyone "
           "du dich dir ihr euch sie tu toi vous ils elles il elle usted ustedes tú él ella ellos").split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = ("said says say wrote writes quoted quote reported claims claimed called calling according sagte schrieb "
           "dit écrit selon dijo escribió según").split()
KINDS = ("insult", "targeted", "negated", "reported", "threat")

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")
_BREAKS = ".!?;\n"
_BREAK = re.compile(f"[{_BREAKS}]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "o", "I", "T", "Y", "N", "R", "Q"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE)
Arc = tuple[object, str, float]


class Transducer:
    """A deterministic weighted transducer given by a step function (state, symbol) -> arc."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input; weights multiply."""
        def step(state, symbol: str) -> Arc:
            a, mid, u = self.step(state[0], symbol)
            b, out, v = other.step(state[1], mid)
            return (a, b), out, u * v

        return Transducer((self.start, other.start), step)

    def table(self) -> dict[tuple[int, str], tuple[int, str, float]]:
        """All arcs that can be reached, with states numbered from 0 (the start)."""
        number, todo, arcs = {self.start: 0}, deque([self.start]), {}
        while todo:
            state = todo.popleft()
            for symbol in SYMBOLS:
                to, out, w = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                arcs[number[state], symbol] = (number[to], out, w)
        return arcs


def _reported(state: int, s: str) -> Arc:
    """After a reporting verb, or inside quotes, insults and threats are somebody else's."""
    if s == QUOTE:
        return 1 - state, OTHER, 1.0
    if s == REPORT:
        return 1, OTHER, 1.0
    return (state, s + "r", 0.6) if state and s in (INSULT, THREAT) else (state, s, 1.0)


def _negated(state: int, s: str) -> Arc:
    """A negation reaches the next three words."""
    if s == NEGATION:
        return 3, OTHER, 1.0
    left = max(0, state - 1)
    return (left, s + "n", 0.6) if state and s[0] in (INSULT, THREAT) else (left, s, 1.0)


def _aimed(state: int, s: str) -> Arc:
    """A target reaches the next four words; a threat then waits as long for its target."""
    if s == TARGET:
        return (4, OTHER, 1.0) if state >= 0 else (4, "X", 1.0)
    if s[0] == THREAT:
        return (-4, OTHER, 1.0) if len(s) == 1 else (max(state - 1, 0), OTHER, 1.0)
    if s[0] == INSULT:
        return max(abs(state) - 1, 0), s + ("y" if state > 0 else ""), 1.2 if state > 0 else 1.0
    return (max(state - 1, 0) if state > 0 else min(state + 1, 0)), OTHER, 1.0


def _accepted(state: int, s: str) -> Arc:
    """The kind of match that a marked symbol makes."""
    if s == "X":
        return 0, "threat", 1.0
    if s[0] != INSULT:
        return 0, "", 1.0
    return 0, "negated" if "n" in s else "reported" if "r" in s else "targeted" if "y" in s else "insult", 1.0


#: The composed grammar.
GRAMMAR = Transducer(0, _reported).then(Transducer(0, _negated)).then(Transducer(0, _aimed)).then(Transducer(0, _accepted)).table()


def _base_lexicon() -> dict[str, tuple[str, float]]:
    words: dict[str, tuple[str, float]] = {}
    for symbol, many in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
        words.update((w, (symbol, 0.8 if symbol in (INSULT, THREAT) else 0.0)) for w in many)
    words.update((q, (QUOTE, 0.0)) for q in "\"“”«»")
    return words


class Matcher:
    """Finds the grammar's matches in a text, given a lexicon word -> (symbol, weight)."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        import ahocorasick

        self.lexicon = lexicon
        self.hits = ahocorasick.Automaton()
        for w, (symbol, _) in lexicon.items():
            if symbol in (INSULT, THREAT):
                self.hits.add_word(w, len(w))
        self.hits.make_automaton()

    def matches(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, weight) of every matched word, in order; positions in code points."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals grow in lower case
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        out, done, n = [], 0, len(low)
        for last, size in self.hits.iter(low):
            a, b = last - size + 1, last + 1
            if a < done or a and low[a - 1].isalnum() or b < n and low[b].isalnum():
                continue
            start = max(done, max(low.rfind(c, done, a) for c in _BREAKS) + 1)
            end = m.start() if (m := _BREAK.search(low, b)) else n
            state, done = 0, end
            threat = 0.0
            for m in _TOKEN.finditer(low, start, end):
                symbol, weight = self.lexicon.get(m[0], (OTHER, 0.0))
                threat = weight if symbol == THREAT else threat
                state, kind, by = GRAMMAR[state, symbol]
                if kind:
                    out.append((kind, m.start(), m.end(), by * (weight if kind != "threat" else threat)))
        return out

    def features(self, text: str) -> np.ndarray:
        """Summed weights by kind, each squeezed into 0..1."""
        sums = np.zeros(len(KINDS))
        for kind, _, _, weight in self.matches(text):
            sums[KINDS.index(kind)] += weight
        return 1.0 - np.exp(-1.5 * sums)


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[str, float]]:
    """The base lexicon with word weights from (doc_id, text, label), and learned words.

    A word's weight is its precision, smoothed towards 0.8 for listed insults. Other words
    come in with enough support and precision. Copies don't count as support: texts with
    the same words in the same order are counted once, as toxic if one of them is. Null texts
    have no words; an empty sample gives the base lexicon.
    """
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}'’]+")
    docs = (sample.select("label", words.alias("words"))
            .groupBy(F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("copy"))
            .agg(F.max("label").alias("label"), F.first("words").alias("words"))
            .select("label", F.array_distinct("words").alias("words")))
    counts = docs.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic = counts[0] or 0
    lexicon = _base_lexicon()
    listed = [w for w, (s, _) in lexicon.items() if s in (INSULT, THREAT)]
    stats = (docs.select("label", F.explode("words").alias("word")).where("word <> ''")
             .groupBy("word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("all"))
             .where(F.col("word").isin(listed) | ((F.col("toxic") >= max(LEAST, SUPPORT * toxic)) & (F.col("toxic") >= PRECISION * F.col("all")))))
    for r in stats.orderBy(F.col("word").isin(listed).desc(), F.desc("toxic"), "word").limit(len(listed) + LEARNED).collect():
        symbol, weight = lexicon.get(r.word, (INSULT, None))
        if symbol in (INSULT, THREAT):
            lexicon[r.word] = (symbol, (r.toxic + (4 * weight if weight else 0)) / (r["all"] + (4 if weight else 1)))
    return lexicon


#: Intercept and weights by kind before any label is seen; also the prior's mean.
PRIOR = np.array([-3.0, 5.0, 6.0, 2.5, 2.5, 5.0])


def fit(sample: DataFrame) -> tuple[dict[str, tuple[str, float]], np.ndarray]:
    """The lexicon and (intercept, weight by kind) fitted on (doc_id, text, label): a
    logistic model by Newton steps around PRIOR, weights not below 0. No rows: PRIOR."""
    lexicon = learn_lexicon(sample)
    rows = _featured(sample.select("doc_id", "text", "label"), lexicon, "label").collect()  # at most SAMPLE small rows
    w = PRIOR.copy()
    if rows:
        x = np.array([[1.0, *r.features] for r in rows])
        y = np.array([float(r.label) for r in rows])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 0.5 * (w - PRIOR)
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
            w = w - np.linalg.solve(hess, grad)
        w[1:] = np.maximum(w[1:], 0.0)
    return lexicon, w


def _featured(docs: DataFrame, lexicon: dict, *keep: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            feats = pa.array([matcher.features(t.as_py() or "").tolist() for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [feats], names=[*keep, "features"])

    types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(released(run), f"{types}, features array<double>")


def toxicity_scores(docs: DataFrame, model: tuple[dict, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1 given its matched clauses.

    Empty and null texts have the intercept's score; repeated rows and null ids stay; only
    doc_id and text are read.
    """
    lexicon, w = model
    dot = F.lit(float(w[0]))
    for k in range(len(KINDS)):
        dot = dot + F.col("features")[k] * float(w[k + 1])
    return _featured(docs, lexicon, "doc_id").select("doc_id", (1 / (1 + F.exp(-dot))).alias("score"))


def matched_clauses(docs: DataFrame, model: tuple[dict, np.ndarray]) -> DataFrame:
    """(doc_id, matches): kind, start, end and weight of every match."""
    shared = docs.sparkSession.sparkContext.broadcast(model[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "weight"), m)) for m in matcher.matches(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, matches array<struct<kind: string, start: long, end: long, weight: double>>")


def fitted(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, most: int = SAMPLE) -> tuple[dict, np.ndarray]:
    """The model fitted on labels outside the held-out remainder."""
    return fit(labelled_sample(docs, labels, "toxic", mod, held_out, most))


def without_toxic(docs: DataFrame, model: tuple[dict, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``. Null and empty
    texts match nothing; repeated rows and null ids are judged each."""
    lexicon, w = model
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        limit = math.log(threshold / (1 - threshold))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [bool(w[0] + w[1:] @ matcher.features(t.as_py() or "") < limit) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
