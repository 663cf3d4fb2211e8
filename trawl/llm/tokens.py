"""Token ids of whole texts by a public word-level BPE file, through the tokenizers library.

A text's ids are the ids of its white-space separated chunks in order (the file's own
pre-tokenizer never joins across white space), so each distinct chunk is encoded once per
task and kept in a bounded table. Chunks of ASCII and Latin-1 letters go straight to the
library's BPE model; any other chunk goes through the library's whole chain. In texts of ASCII
and Latin-1 alone A-Z are lower-cased and commas and stops at the ends of words cut off first, as
the file does itself, so that fewer chunks are distinct.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trawl.llm.arrays import released

#: Distinct chunks kept per task; the table is emptied when full (results do not change).
CACHE = 500_000
# fixed values: letters of Latin-1 in lower case, and the contractions of the file's split pattern
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# bytes of other characters than Latin-1 (normal forms may join those); a comma or stop that ends a chunk and follows no
# letter or digit, so that the file's pattern may join it with what is before
_BEYOND = re.compile(rb"[\xc4-\xff]")
_JOINED = re.compile(rb"[.,](?<![A-Za-z0-9].)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].)(?:\s|$)")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others take 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return [table[b] for b in range(256)]


def id_type(vocabulary: str) -> str:
    """The narrowest little-endian type that holds every id of a tokenizers JSON file."""
    import json

    content = json.loads(vocabulary)
    last = max([*content["model"]["vocab"].values(), *(t["id"] for t in content["added_tokens"])])
    return "<u2" if last < 1 << 16 else "<u4"


@lru_cache(maxsize=2)  # a Python worker keeps it from task to task
def encoder(vocabulary: str, dtype: str = "<u4") -> Callable[[bytes], bytes]:
    """A function from UTF-8 text to the bytes of its ids, each of type ``dtype``.

    ``vocabulary``: content of a tokenizers JSON file. Special tokens' strings in a text
    are ordinary text.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(vocabulary)
    whole.encode_special_tokens = True
    model = whole.model
    table = {ord(c): "".join(byte_characters()[b] for b in c.encode()) for c in map(chr, range(256))}
    pieces: dict[str, bytes] = {}
    words: dict[bytes, bytes] = {}

    code = "H" if dtype == "<u2" else "I"

    def ids_of(p: str) -> bytes:
        # printable ASCII stands for itself
        ids = array(code, [t.id for t in model.tokenize(p if p.isascii() and p.isprintable() else p.translate(table))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def piece(p: str) -> bytes:
        ids = pieces.get(p)
        if ids is None:
            if len(pieces) >= CACHE:
                pieces.clear()
            ids = pieces[p] = ids_of(p)
        return ids

    def word(w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return ids_of(w.lower())
        if _SIMPLE.fullmatch(w):
            found = _PIECES.findall(w.lower())
            return ids_of(found[0]) if len(found) == 1 else b"".join(map(piece, found))
        return np.array(whole.encode(w, add_special_tokens=False).ids, dtype).tobytes()

    def encode(text: bytes) -> bytes:
        if text.isascii() or not _BEYOND.search(text):
            text = text.lower()
            if not _JOINED.search(text):
                text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")
        chunks = text.split()
        ids = list(map(words.get, chunks))
        if None in ids:
            if len(words) + len(chunks) > CACHE:
                words.clear()
            for k, found in enumerate(ids):
                if found is None:
                    w = chunks[k]
                    if w not in words:
                        words[w] = word(w.decode())
                    ids[k] = words[w]
        return b"".join(ids)

    return encode


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", end_id: int | None = None,
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, ``ids`` (binary, little-endian
    unsigned integers of ``id_type``) and ``n_tokens``; ``end_id`` is appended to every row.

    Null texts count as empty; repeated rows stay; other columns are not read.
    ``vocabulary`` is the path of a tokenizers JSON file; its content (a few MB, of fixed
    size) is broadcast, so executors need no such file.
    """
    with open(vocabulary, encoding="utf-8") as f:
        raw = f.read()
    content, dtype = docs.sparkSession.sparkContext.broadcast(raw), id_type(raw)
    width = np.dtype(dtype).itemsize
    tail = b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = encoder(content.value, dtype)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):  # ids take more room than texts
                part = batch.slice(lo, 1000)
                ids = [fn(t or b"") + tail for t in part.column(len(keep)).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())],
                    names=[*keep, "ids", "n_tokens"])

    source = docs.select(*keep, text_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:len(keep)])
    return source.mapInArrow(released(run), f"{types}, ids binary, n_tokens long")
