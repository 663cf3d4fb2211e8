"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

Pieces are the vocabulary's byte strings written with one printable character per byte;
a piece's score is its negative rank and its position is its id. The model normalises
nothing. Texts are cut into pre-tokens by a pattern; each is encoded alone; decoding maps
ids back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trawl.llm.tokens import byte_characters

#: Distinct chunks and pre-tokens kept per task; emptied when full. Characters of texts that are encoded at once.
CACHE, TEXTS = 500_000, 1 << 18


#: The pattern for which commas and stops are cut off without it (that of GPT-2).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# white space but blank and newline; a comma or stop before the end of a chunk that follows no letter or digit of Latin-1
_OTHER = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_JOINED = re.compile("[.,](?<![A-Za-z0-9À-ÖØ-öø-ÿ].)\x00").search


def read_ranks(content: bytes) -> tuple[bytes, ...]:
    """The byte strings of a rank file, by id; ids must run from 0 without gaps."""
    found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return tuple(found[k] for k in range(len(found)))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(tokens: tuple[bytes, ...]) -> bytes:
    """A sentencepiece BPE model of the tokens; an unknown piece follows the last token."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, 1))
              for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join([*pieces, _field(2, trainer), _field(3, normaliser)])


@lru_cache(maxsize=2)  # a Python worker keeps it from task to task
def encoder(model: bytes, tokens: tuple[bytes, ...], pattern: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids (little-endian unsigned 32-bit).

    A text of words with single blanks between them is encoded chunk by chunk (blank and
    word), as the pattern never matches across such a blank; other texts are cut by the
    pattern as a whole. Commas and stops that follow a letter or digit and end a chunk are
    pre-tokens of their own. Pre-tokens that are new to all the texts are encoded by one call.
    """
    import regex
    import sentencepiece

    engine = sentencepiece.SentencePieceProcessor(model_proto=model)
    cut = regex.compile(pattern).findall
    odd = regex.compile(r"\s[ ]|[ ]\s|^\s|\s$").search
    plain = pattern == PATTERN
    mapping = dict(enumerate(byte_characters()))
    whole = {t: struct.pack("<I", k) for k, t in enumerate(tokens)}
    known: dict[str, bytes] = {}  # of chunks and of pre-tokens, which the pattern cuts no further

    def learn(new: list[str]) -> None:
        """Enter the ids of chunks in ``known``."""
        cuts = list(map(cut, new))
        todo = []
        for p in {p for ps in cuts for p in ps if p not in known}:
            raw = p.encode()
            if raw in whole:
                known[p] = whole[raw]
            else:
                todo.append((p, raw.decode("latin-1").translate(mapping)))
        if todo:
            found = engine.encode([t for _, t in todo], num_threads=1)
            ends = np.cumsum([0, *map(len, found)]) * 4
            ids = np.fromiter(chain.from_iterable(found), "<u4", ends[-1] // 4).tobytes()
            for (p, _), a, b in zip(todo, ends[:-1].tolist(), ends[1:].tolist()):
                known[p] = ids[a:b]
        for c, ps in zip(new, cuts):
            if c not in known:
                known[c] = b"".join(map(known.__getitem__, ps))

    def chunks(t: str) -> list[str]:
        if not t:
            return []
        if "\x00" in t:
            return cut(t)
        if _OTHER(t):
            if odd(t):
                return cut(t)
        elif t[0] in " \n" or t[-1] in " \n" or "  " in t or " \n" in t or "\n " in t:
            return cut(t)
        t = t.replace(" ", "\x00 ")
        if plain and not _JOINED(t):
            t = t.replace(",\x00", "\x00,\x00").replace(".\x00", "\x00.\x00")
        return t.split("\x00")

    def encode(texts: list[str]) -> list[bytes]:
        parts = list(map(chunks, texts))
        ids = [list(map(known.get, p)) for p in parts]
        holes = [list(_holes(found)) for found in ids]
        new = {p[k] for p, at in zip(parts, holes) for k in at}
        if new:
            if len(known) + 2 * len(new) > CACHE:
                known.clear()
            learn(list(new))
            for p, found, at in zip(parts, ids, holes):
                for k in at:
                    found[k] = known[p[k]]
        return list(map(b"".join, ids))

    return encode


def _holes(found: list[bytes | None]) -> Iterator[int]:
    """Where ``found`` is None."""
    k = -1
    for _ in range(found.count(None)):
        k = found.index(None, k + 1)
        yield k


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about TEXTS characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > TEXTS:
            yield run
            run, size = [], 0
        run.append(t or "")
        size += len(t or "")
    if run:
        yield run


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids`` (array of int) of every row.

    Null and empty texts have no ids; repeated rows stay; other columns are not read.
    ``ranks`` is the path of a rank file; the model made of it (about 1 MB, of fixed size)
    is broadcast.
    """
    with open(ranks, "rb") as f:
        tokens = read_ranks(f.read())
    shared = docs.sparkSession.sparkContext.broadcast((serialise(tokens), tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = encoder(*shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = [x for texts in _slices(part.column(len(keep)).to_pylist()) for x in fn(texts)]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keep, "ids"])

    source = docs.select(*keep, text_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:len(keep)])
    return source.mapInArrow(run, f"{types}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``out_col``, the bytes that its ids stand for (null ids: null)."""
    with open(ranks, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                column = part.column(part.schema.get_field_index(ids_col))
                raw = [None if x is None else b"".join(map(get, x)) for x in column.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, out_col])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{types}, `{out_col}` binary")
