"""Text functions and query perturbations (F1-F5, F7) as Column expressions.

Everything is built from JVM built-ins except full-Unicode accent stripping (NFKD has
no Spark built-in), which is an Arrow-batched pandas UDF over ``unicodedata``.
Randomised perturbations draw from the seeded md5 key of the row, so a rerun (or a
retried task) produces the same text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.types import StringType
from pyspark.sql import functions as F

from trawl.functions.hashing import draw_index

# fixed values: informal Portuguese abbreviations, applied in this order, each with the
# three literal replacements " w " -> " a ", "w " -> "a ", " w" -> " a"
ABBREVIATIONS = [
    ("você", "vc"),
    ("voce", "vc"),
    ("por que", "pq"),
    ("porque", "pq"),
    ("também", "tb"),
    ("tambem", "tb"),
    ("tudo", "td"),
    ("que", "q"),
    ("para", "pra"),
    ("está", "ta"),
    ("esta", "ta"),
    ("porra", "porra"),
    ("não", "naum"),
]

# fixed values: relative score-drop thresholds per perturbation
SCORE_DROP_THRESHOLD = {
    "no_accent": 0.10,
    "case_lower": 0.05,
    "case_upper": 0.10,
    "typo_2chars": 0.15,
    "abbreviations": 0.10,
}


def _strip(s: str | None) -> str | None:
    if s is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _strip_accents_udf(s: pd.Series) -> pd.Series:
    return s.map(_strip)


def strip_accents(c: Column) -> Column:
    """NFKD decomposition with combining marks removed (pandas UDF, Arrow batches)."""
    return _strip_accents_udf(c)


def case_lower(c: Column) -> Column:
    """F2."""
    return F.lower(c)


def case_upper(c: Column) -> Column:
    """F2."""
    return F.upper(c)


def _swap_adjacent(s: Column, i: Column) -> Column:
    """Swap 0-based characters i and i+1."""
    n = F.length(s)
    return F.concat(F.substr(s, F.lit(1), i), F.substr(s, i + 2, F.lit(1)), F.substr(s, i + 1, F.lit(1)),
                    F.substr(s, i + 3, n))


def typo_swaps(c: Column, seed, *key: Column, swaps: int = 2) -> Column:
    """swap two adjacent characters at a seeded position, ``swaps`` times;
    strings shorter than 4 characters are unchanged."""
    out = c
    n = F.length(c)
    for d in range(1, swaps + 1):
        i = draw_index(seed, F.greatest(n - 1, F.lit(1)), *key, F.lit(d))
        out = F.when(n >= 4, _swap_adjacent(out, i)).otherwise(out)
    return out


def abbreviations(c: Column) -> Column:
    """the ordered literal replacements of :data:`ABBREVIATIONS`."""
    out = c
    for full, abbr in ABBREVIATIONS:
        out = F.replace(out, F.lit(f" {full} "), F.lit(f" {abbr} "))
        out = F.replace(out, F.lit(f"{full} "), F.lit(f"{abbr} "))
        out = F.replace(out, F.lit(f" {full}"), F.lit(f" {abbr}"))
    return out


def perturbations(c: Column, seed, *key: Column) -> dict[str, Column]:
    """F5 registry: name -> perturbed text."""
    return {
        "no_accent": strip_accents(c),
        "case_lower": case_lower(c),
        "case_upper": case_upper(c),
        "typo_2chars": typo_swaps(c, seed, F.lit("typo_2chars"), *key),
        "abbreviations": abbreviations(c),
    }


def perturb_all(df, text_col: str, key_cols: list[str], seed=42, names: list[str] | None = None):
    """one row per (row, perturbation): ``*key_cols, perturbation, original, perturbed``."""
    reg = perturbations(F.col(text_col), seed, *[F.col(k) for k in key_cols])
    names = names or list(reg)
    arr = F.array(*[F.struct(F.lit(n).alias("perturbation"), reg[n].alias("perturbed")) for n in names])
    return df.select(*key_cols, F.col(text_col).alias("original"), F.inline(arr))


def format_ci(mean: Column, lo: Column, hi: Column, confidence: Column, decimals: int = 4) -> Column:
    """``mean [lo, hi] (CI 95%)``."""
    fmt = f"%.{decimals}f [%.{decimals}f, %.{decimals}f] (CI %d%%)"
    return F.format_string(fmt, mean, lo, hi, (confidence * 100).cast("int"))


def prefix(c: Column, n: int) -> Column:
    """first ``n`` characters (display helper)."""
    return F.left(c, F.lit(n))
