"""Conversation structure repair by prefix-doubling path ranking.

The rows of a conversation, in order, and the states of the role grammar ``(s?(ua)+)?`` span a
graph whose arcs are edits: Keep, Rerole, Delete and Insert. A backward pass gives every node
its cheapest cost to the end; the arcs on cheapest paths remain. Nodes are then ranked by the
first 1, 2, 4, ... letters of their audits, each round pairing a node's rank with the rank its
doubled pointer leads to, until the ranks order whole audits. The arc with the least letter and
least target rank is followed from the start through the doubled pointers.

Rows travel as small codes. They are numbered in order and cut into blocks of BLOCK rows, so a
conversation of any length is spread over tasks: a block passes on its edges' cost matrix,
then where each state leads, and only the scan over those (one short row a block) is
sequential. One audit is one string of at most 2^31 letters, so a scan reads at most 2^31 /
BLOCK rows. Texts meet the edits at the end, in one shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.order import numbered
from trawl.session import scratch_dir

BLOCK = 4096
INF = 1 << 40
#: States of the grammar; row 4 of a cost vector stands for "not allowed".
START, SYSTEM, USER, ASSISTANT, NONE = range(5)
#: Where a user or assistant turn leads from each state: only one of them is ever allowed.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Where a kept row of initial (other, s, u, a) leads from each state.
KEEP = np.array([[NONE] * 4, [SYSTEM, NONE, NONE, NONE], [USER, USER, NONE, USER], [NONE, NONE, ASSISTANT, NONE]])
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row's code: its initial (0 to 3), plus MUST if it is to be deleted, plus CUT if truncated.
MUST, CUT = 4, 8
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_LETTERS = " DIKR"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after seeded damage by crc32(``conv:turn``) % 20: 0 drops, 1 empties the text, 2
    removes its ``.!?``, 3 repeats the row, 4 sets the role user. Nulls are read as one space;
    null ids and turns stay null. Other columns go."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    kept = rows.select(F.col(conv_col), F.col(turn_col), text(role_col).alias(role_col), text(text_col).alias(text_col), fate.alias("_fate")).where("_fate <> 0")
    return kept.select(
        conv_col, turn_col, F.when(F.col("_fate") == 4, "user").otherwise(F.col(role_col)).alias(role_col),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col)).alias(text_col),
        F.explode(F.expr("sequence(1, if(_fate = 3, 2, 1))")).alias("_copy")).drop("_copy")


def _relaxed(v: np.ndarray) -> np.ndarray:
    """Costs after any number of inserted turns."""
    v[USER], v[ASSISTANT] = np.minimum(v[USER], v[ASSISTANT] + 2), np.minimum(v[ASSISTANT], v[USER] + 2)
    v[START], v[SYSTEM] = np.minimum(v[START], v[USER] + 2), np.minimum(v[SYSTEM], v[USER] + 2)
    return v


#: Costs from each state to the end of a conversation.
END = _relaxed(np.array([0, INF, INF, 0, INF]))


def costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cheapest costs from every (row, state) to the end, given those behind the last row."""
    out = np.empty((len(codes) + 1, *end.shape), np.int64)
    out[-1] = end
    for i in range(len(codes) - 1, -1, -1):
        code, after = codes[i], out[i + 1]
        v = np.minimum(after + 3, INF)
        if not code & MUST:
            cut = code >> 3
            v[:4] = np.minimum(v[:4], np.minimum(after[NEXT] + 2, after[KEEP[code & 3]]) + cut)
        out[i] = np.minimum(_relaxed(v), INF)
        out[i, NONE] = INF
    return out


def matrix(codes: np.ndarray) -> np.ndarray:
    """Cheapest costs from each state before the rows to each state behind them."""
    unit = np.full((5, 4), INF, np.int64)
    unit[range(4), range(4)] = 0
    return costs(codes, unit)[0, :4]


class Paths:
    """Least cheapest audits of the segments of a block: ``parts`` are (codes, costs behind the
    last row, whether the conversation ends there)."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, bool]]):
        self.rows = [len(p[0]) for p in parts]
        self.base = np.concatenate([[0], np.cumsum([n + 1 for n in self.rows])])  # first layer of each segment
        layers = int(self.base[-1])
        cost = np.concatenate([costs(codes, end) for codes, end, _ in parts])
        code = np.zeros(layers, np.int64)
        last = np.zeros(layers, dtype=bool)
        last[self.base[1:] - 1] = True
        code[~last] = np.concatenate([p[0] for p in parts])
        inserts = ~last
        inserts[self.base[1:] - 1] = [p[2] for p in parts]
        self._rank(cost, code, last, inserts)

    def _rank(self, cost, code, last, inserts) -> None:
        layers = len(code)
        here = np.arange(layers)[:, None]
        after = np.minimum(here + 1, layers - 1)
        state = np.arange(4)[None]
        now, cut, row, free = cost[:, :4], (code >> 3)[:, None], ~last[:, None], ((code & MUST) == 0)[:, None]
        keep = KEEP[code & 3]
        arcs = [  # of letters D, I, K, R: target layer, target state, allowed, price
            (after, np.broadcast_to(state, now.shape), row, 3), (here, np.broadcast_to(NEXT, now.shape), inserts[:, None], 2),
            (after, keep, row & free, cut), (after, np.broadcast_to(NEXT, now.shape), row & free, 2 + cut)]
        to, best = [], []
        for layer, q, allowed, price in arcs:
            best.append((allowed & (now < INF) & (cost[layer, q] + price == now)).reshape(-1))
            to.append((layer * 4 + np.minimum(q, 3)).reshape(-1))
        to, best = np.array(to), np.array(best)
        nodes = np.arange(layers * 4)
        some = best.any(0)

        def chosen(rank):
            """The arc of least (letter, rank of its target) of every node, and where it leads."""
            key = np.where(best, np.arange(1, 5)[:, None] * (len(nodes) + 1) + rank[to], np.iinfo(np.int64).max)
            pick = key.argmin(0)
            return np.where(some, pick + 1, 0), np.where(some, to[pick, nodes], nodes)

        rank, jump = chosen(np.zeros(len(nodes), np.int64))
        bound = 3 * max(self.rows, default=0) + 3
        step = 1
        while step < bound:  # ranks of audits' first `step` letters become those of twice as many
            rank = np.unique(rank * (len(nodes) + 1) + rank[jump], return_inverse=True)[1]
            jump = jump[jump]
            step *= 2
        self.letter, jump = chosen(rank)
        self.jumps = [jump]
        while 1 << len(self.jumps) < bound:
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def nodes(self, segment: int, enter: int) -> np.ndarray:
        """The nodes of the least path of a segment from a state, the last one included."""
        path = np.array([self.base[segment] * 4 + enter])
        for jump in self.jumps:
            if len(path) > 3 * self.rows[segment] + 2:
                break
            path = np.concatenate([path, jump[path]])
        ends = np.flatnonzero(self.letter[path] == 0)
        return path[:ends[0] + 1]


def _segments(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]], list[str]]:
    """A block's rows in order, and first and end row and key of each conversation in it."""
    table = table.sort_by("position").combine_chunks()
    keys = table.column("ckey").to_pylist()
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return table, list(zip(cuts[:-1], cuts[1:])), [keys[i] for i in cuts[:-1]]


def _edges(table: pa.Table) -> pa.Table:
    table, parts, keys = _segments(table)
    codes, block = table.column("code").to_numpy(), table.column("block")[0].as_py()
    out = [{"ckey": keys[s], "block": block, "costs": matrix(codes[a:b]).reshape(-1).tolist(), "last": int(codes[b - 1]) & 3}
           for s, (a, b) in enumerate(parts) if s in (0, len(parts) - 1)]
    return pa.Table.from_pylist(out, pa.schema([("ckey", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("last", pa.int32())]))


_GOALS = "ckey string, block long, goal array<long>, ends boolean, before int"


def _goals(table: pa.Table) -> pa.Table:
    """The edges of one conversation to the costs behind each, from its end to its start."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    goal = END[:4]
    out = []
    for k in range(len(rows) - 1, -1, -1):
        out.append({"ckey": rows[k]["ckey"], "block": rows[k]["block"], "goal": goal.tolist(), "ends": k == len(rows) - 1,
                    "before": rows[k - 1]["last"] if k else -1})
        goal = np.minimum((np.array(rows[k]["costs"]).reshape(4, 4) + goal).min(1), INF)
    return pa.Table.from_pylist(out, pa.schema([("ckey", pa.string()), ("block", pa.int64()), ("goal", pa.list_(pa.int64())),
                                                ("ends", pa.bool_()), ("before", pa.int32())]))


def _paths(table: pa.Table, edges: pa.Table):
    table, parts, keys = _segments(table)
    codes = table.column("code").to_numpy()
    known = {r["ckey"]: r for r in edges.to_pylist()}
    ends = [(np.append(known[k]["goal"], INF), known[k]["ends"]) if k in known else (END, True) for k in keys]
    return table, parts, keys, codes, known, Paths([(codes[a:b], *e) for (a, b), e in zip(parts, ends)])


def _exits(table: pa.Table, edges: pa.Table) -> pa.Table:
    """Where the least path of each edge segment leads from every state."""
    out = []
    if len(table):
        table, _, keys, _, known, paths = _paths(table, edges)
        for s, k in enumerate(keys):
            if k in known:
                out.append({"ckey": k, "block": known[k]["block"], "exits": [int(paths.nodes(s, q)[-1]) % 4 for q in range(4)]})
    return pa.Table.from_pylist(out, pa.schema([("ckey", pa.string()), ("block", pa.int64()), ("exits", pa.list_(pa.int32()))]))


def _enters(table: pa.Table) -> pa.Table:
    """The state in which one conversation enters each of its edge segments."""
    out, state = [], START
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append({"ckey": r["ckey"], "block": r["block"], "enter": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, pa.schema([("ckey", pa.string()), ("block", pa.int64()), ("enter", pa.int32())]))


_EDITS = ("ckey string, block long, position long, turn long, role string, digest binary, piece string, cost long, "
          "kept boolean, given string, pre string, post string, illegal long")


def _edits(table: pa.Table, edges: pa.Table) -> pa.Table:
    """Every row of a block with its audit letters and what becomes of it."""
    schema = pa.schema([("piece", pa.string()), ("cost", pa.int64()), ("kept", pa.bool_()), ("given", pa.string()),
                        ("pre", pa.string()), ("post", pa.string()), ("illegal", pa.int64())])
    out: list[dict] = []
    if len(table):
        table, parts, keys, codes, known, paths = _paths(table, edges)
        for s, (a, b) in enumerate(parts):
            edge = known.get(keys[s])
            rows = [{"piece": "", "cost": 0, "kept": False, "given": None, "pre": "", "post": "", "illegal": 0} for _ in range(a, b)]
            for node in paths.nodes(s, edge["enter"] if edge else START).tolist():
                layer, state = divmod(node, 4)
                at, letter = layer - int(paths.base[s]), _LETTERS[paths.letter[node]]
                if letter == " ":
                    continue
                row = rows[min(at, b - a - 1)]
                row["piece"] += letter
                if letter == "I":  # before its row, or after the last one
                    row["pre" if at < b - a else "post"] += ROLES[int(NEXT[state])][0]
                    row["cost"] += 2
                elif letter == "D":
                    row["cost"] += 3
                else:
                    row["kept"] = True
                    row["given"] = ROLES[int(NEXT[state])] if letter == "R" else None
                    row["cost"] += int(codes[a + at] >> 3) + 2 * (letter == "R")
            before = edge["before"] if edge else -1
            for row, code in zip(rows, codes[a:b].tolist()):
                row["illegal"] = int(before >= 0 and (before, code & 3) not in _LEGAL)
                before = code & 3
            out += rows
    found = pa.Table.from_pylist(out, schema)
    kept = table.select(["ckey", "block", "position", "turn", "role", "digest"])
    for name in schema.names:
        kept = kept.append_column(name, found.column(name))
    return kept


def _whole(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, str]]:
    """(ckey, position, role, text) of repaired rows, from edits and texts sorted by key with a
    key's edits before its texts. Only one key's edits are held."""
    key, held = None, []

    def put(text):
        for e in held:
            for r in e["pre"]:
                yield e["ckey"], e["position"], "user" if r == "u" else "assistant", ""
            if e["kept"]:
                yield e["ckey"], e["position"], e["given"] or e["role"], text
            for r in e["post"]:
                yield e["ckey"], e["position"], "user" if r == "u" else "assistant", ""
        held.clear()

    for batch in stream:
        for r in batch.to_pylist():
            now = r["ckey"], r["turn"], r["role"], r["digest"]
            if now != key:
                yield from put("")
                key = now
            if r["position"] is None:
                yield from put(r["text"])
            else:
                held.append(r)
    yield from put("")


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, found, key, state = [], [], None, None
    for ckey, _, role, text in _whole(stream):
        if ckey != key:
            if state:
                keys.append(key)
                found.append(state.hexdigest())
            key, state = ckey, hashlib.sha256()
        else:
            state.update(b"\n")
        state.update(f"{role}:{text}".encode())
        if len(keys) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], names=["ckey", "repaired_sha256"])
            keys, found = [], []
    if state:
        keys.append(key)
        found.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["ckey", "repaired_sha256"])


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, held = ["ckey", "position", "place", "role", "text"], []
    before, place = None, 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], kind) for k, kind in enumerate(
            (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=names)

    for ckey, position, role, text in _whole(stream):
        place = place + 1 if position == before else 0
        before = position
        held.append((ckey, position, place, role, text))
        if len(held) == 4096:
            yield batch()
            held = []
    yield batch()


class Repair:
    """The repair of a table of conversations, ready to be read in several forms.

    Rows are taken by turn (null turns first), ties by role, then by the SHA-256 of the text.
    Null roles and texts are read as one space, so a null text is blank; rows of a null id are
    one conversation. A row is blank without a character beyond space and 0x09-0x0D, else a
    duplicate if its role and text came earlier, else truncated if its last such character is
    not ``.``, ``!`` or ``?``. Repeated rows are duplicates. An empty table gives no rows;
    other columns, whatever their names, are not read.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        spark = rows.sparkSession
        self.conv_type = rows.schema[conv_col].dataType
        text = F.coalesce(F.col(text_col), F.lit(" "))
        self.base = rows.select(self.key(F.col(conv_col)).alias("ckey"), F.col(turn_col).cast("long").alias("turn"),
                                F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"),
                                F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
        path = scratch_dir(spark, "turns")
        # equal rows are one, with a count, before anything is moved
        (self.base.groupBy("ckey", "turn", "role", "digest").agg(
            F.count(F.lit(1)).alias("copies"), F.max(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            F.max(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")).write.parquet(path))
        self.turns = spark.read.parquet(path)
        same = ["ckey", "role", "digest"]
        first = self.turns.groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
        part = F.explode(F.expr(f"sequence(0, cast((copies - 1) div {BLOCK} as int))")).alias("part")
        marked = (self.turns.join(first, same).withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("first")
                  .select("*", part).withColumn("here", F.expr(f"least({BLOCK}, copies - {BLOCK} * cast(part as long))")).drop("copies"))
        again = F.col("again") | (F.col("part") > 0) | (F.col("copy") > 0)
        initial = F.substring("role", 1, 1)
        code = (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
                + F.when(F.col("blank") | again, MUST).otherwise(0) + F.when(F.col("cut"), CUT).otherwise(0))
        self.laid = (numbered(marked, ["ckey", "turn", "role", "digest", "part"], repeat="here")
                     .select("ckey", "turn", "role", "digest", "position", F.expr(f"position div {BLOCK}").alias("block"),
                             code.cast("int").alias("code"), "blank", (~F.col("blank") & again).alias("duplicate"),
                             (~F.col("blank") & ~again & F.col("cut")).alias("truncated")))
        by_block = self.laid.select("ckey", "block", "position", "code")
        edges = by_block.groupBy("block").applyInArrow(_edges, "ckey string, block long, costs array<long>, last int")
        path = scratch_dir(spark, "edges")
        edges.groupBy("ckey").applyInArrow(_goals, _GOALS).write.parquet(f"{path}/goals")
        goals = spark.read.parquet(f"{path}/goals")
        exits = by_block.groupBy("block").cogroup(goals.groupBy("block")).applyInArrow(_exits, "ckey string, block long, exits array<int>")
        enters = exits.groupBy("ckey").applyInArrow(_enters, "ckey string, block long, enter int")
        goals.join(enters, ["ckey", "block"]).write.parquet(f"{path}/enters")
        known = spark.read.parquet(f"{path}/enters")
        edits = (self.laid.drop("blank", "duplicate", "truncated").groupBy("block")
                 .cogroup(known.groupBy("block")).applyInArrow(_edits, _EDITS))
        edits.write.parquet(f"{path}/edits")
        self.edits = spark.read.parquet(f"{path}/edits")

    @staticmethod
    def key(conv: Column) -> Column:
        """The id as a text that is never null (a null id: empty)."""
        return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))

    def _conv(self) -> Column:
        return F.when(F.col("ckey") != "", F.expr("substring(ckey, 2)")).cast(self.conv_type)

    def _stream(self) -> DataFrame:
        edits = self.edits.where("kept or pre <> '' or post <> ''").select(
            "ckey", "turn", "role", "digest", "position", "kept", "given", "pre", "post")
        return edits.unionByName(self.base, allowMissingColumns=True)

    def rows(self) -> DataFrame:
        """(conv_id, position, place, role, text) of the repaired rows, by range of the original
        order, so that a long conversation is spread over tasks; inserted turns share the
        position of the row beside them, in the order of ``place``."""
        order = ["ckey", "turn", "role", "digest"]
        sorted_ = self._stream().repartitionByRange(*order).sortWithinPartitions(*order, F.col("position").asc_nulls_last())
        return sorted_.mapInArrow(_rows, "ckey string, position long, place int, role string, text string").select(
            self._conv().alias("conv_id"), "position", "place", "role", "text")

    def digests(self) -> DataFrame:
        """(ckey, repaired_sha256): the hash of a conversation's rows is one sequential sum, so a
        conversation is read by one task, as a stream: a row at a time is held."""
        sorted_ = self._stream().repartition("ckey").sortWithinPartitions(
            "ckey", "turn", "role", "digest", F.col("position").asc_nulls_last())
        return sorted_.mapInArrow(_digests, "ckey string, repaired_sha256 string")

    def report(self) -> DataFrame:
        """(ckey, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations with rows."""
        pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]), "")
        audits = (self.edits.groupBy("ckey", "block").agg(pieces.alias("piece"), F.min("position").alias("position"),
                                                          F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
                  .groupBy("ckey").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), pieces.alias("audit")))
        faults = self.laid.groupBy("ckey").agg(*(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        gaps = (self.turns.select("ckey", "turn").distinct().groupBy("ckey")
                .agg(F.coalesce(F.expr("max(turn) - min(turn) + 1 - count(turn)"), F.lit(0)).alias("gaps")))
        return audits.join(faults, "ckey").join(gaps, "ckey")


def repair_report(original: DataFrame, changed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per id of ``original``: the report and digest of the repair of ``changed``, with
    zeros, an empty audit and the hash of nothing where no rows are left."""
    found = Repair(changed, conv_col)
    every = original.select(conv_col).distinct().withColumn("ckey", Repair.key(F.col(conv_col)))
    joined = every.join(found.report(), "ckey", "left").join(found.digests(), "ckey", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(conv_col, *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
