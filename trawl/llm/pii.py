"""Personal data: regular expressions propose spans, checksums confirm, context words score.

Base kinds (email, ip, card, phone) are always reported when their check passes. IBANs
(length by country, mod-97) are found besides. Every span has a score from its check and from words nearby;
added kinds are reported from ``ADDED_SCORE`` on, base kinds at any score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrays import released

KINDS = ("email", "ip", "card", "phone", "iban")
#: Characters on each side of a span in which context words count.
CONTEXT = 48
#: Least score of a span of an added kind.
ADDED_SCORE = 0.6

# What each kind looks like. Possessive and anchored forms match the same
# spans as the plain ones, in linear time on long runs of digits or letters.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}+")
# Characters of an IBAN by country.
_IBAN_LENGTHS = {c: int(n) for n, many in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in many.split(",")}
# Words that make a kind likelier, and words that speak against personal data.
_NEAR = {
    "email": ("mail", "contact", "write", "reach", "address", "correo", "courriel"),
    "ip": ("ip", "host", "server", "login", "client", "address", "logged"),
    "card": ("card", "visa", "master", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "llam"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
}
_AGAINST = ("example", "sample", "version", "dummy", "placeholder", "test")


def luhn(digits: str) -> bool:
    """Luhn's check over a digit string."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without blanks: country and check digits moved last, mod 97 = 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last if domain else 0))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while run := _PHONE_RUN.search(text, at):
        end = run.end()
        while not "0" <= text[end - 1] <= "9":
            end -= 1
        # a digit, at least one more character, and a last digit
        if end - run.start() >= 4:
            yield run.start(), end
            at = end
        else:
            at = run.start() + 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """At each start the longest end at a word's end that passes mod-97; countries with a
    known length have just that one."""
    last = 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.match(text, m.end()) if m.start() >= last else None
        if not rest:
            continue
        size = _IBAN_LENGTHS.get(m[0][:2])
        for end in range(rest.end(), m.end() + 10, -1):
            after = text[end:end + 1]
            if text[end - 1] == " " or after.isascii() and after.isalnum():
                continue
            code = text[m.start():end].replace(" ", "")
            if len(code) >= 15 and len(code) == (size or len(code)) and mod97(code):
                yield m.start(), end
                last = end
                break


def _score(kind: str, text: str, start: int, end: int, base: float) -> float:
    near = (text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]).lower()
    return round(min(1.0, max(0.0, base + 0.2 * any(w in near for w in _NEAR[kind]) - 0.2 * any(w in near for w in _AGAINST))), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in KINDS, then start; end exclusive,
    positions in code points."""
    out = []
    if "@" in text:
        out += [("email", a, b, _score("email", text, a, b, 0.8)) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span(), _score("ip", text, *m.span(), 0.6)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span(), _score("card", text, *m.span(), 0.7)))
    if "+" in text:
        for a, b in _phones(text):
            if 8 <= len(_digits(text[a:b])) <= 15:
                out.append(("phone", a, b, _score("phone", text, a, b, 0.6)))
    for a, b in _ibans(text):
        if (score := _score("iban", text, a, b, 0.7)) >= ADDED_SCORE:
            out.append(("iban", a, b, score))
    return out


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets (overlapping spans: their
    union is replaced by the kind of the earliest, of those the longest)."""
    parts, last = [], 0
    for kind, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= last:
            parts += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*parts, text[last:]]) if last else text


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, ends = [], [0]
        for text in batch.column(1):
            spans += find_spans(text.as_py() or "")
            ends.append(len(spans))
        columns = list(zip(*spans)) or [()] * 4
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN)], fields=list(_SPAN))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; spans are structs of kind, start, end, score.

    Null and empty texts have no spans; repeated rows and null ids stay; other columns are
    not read. Whole texts are scanned, in time linear in their length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        released(_found), f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, score: double>>")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data in its text replaced by its kind; null
    texts stay null and the length column, if there, is counted anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redact(t) for t in (x.as_py() for x in batch.column(k))]
            yield batch.set_column(k, text_col, pa.array(texts, pa.string()))

    out = docs.mapInArrow(released(run), docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
