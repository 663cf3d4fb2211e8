"""DuckDB SQL text that mirrors the Column expressions of ``trawl.functions`` (oracle side)."""

from __future__ import annotations

from trawl.functions.hashing import sql_hash_key
from trawl.functions.text import ABBREVIATIONS, SCORE_DROP_THRESHOLD


def tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '([\\p{{L}}\\p{{N}}]+)', 1)"


def overlap(q: str, p: str) -> str:
    qd = f"list_distinct({tok(q)})"
    pd = f"list_distinct({tok(p)})"
    return f"round(len(list_intersect({qd}, {pd})) / greatest(len({qd}), 1), 6)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def abbreviations(c: str) -> str:
    out = c
    for full, abbr in ABBREVIATIONS:
        for a, b in ((f" {full} ", f" {abbr} "), (f"{full} ", f"{abbr} "), (f" {full}", f" {abbr}")):
            out = f"replace({out}, {sql_str(a)}, {sql_str(b)})"
    return out


def typo(c: str, seed, keys: list[str], swaps: int = 2) -> str:
    n = f"length({c})"
    out = c
    for d in range(1, swaps + 1):
        h = sql_hash_key(seed, "'typo_2chars'", *keys, str(d))
        i = f"({h} % greatest({n} - 1, 1))"
        sw = (f"(substring({out}, 1, {i}) || substring({out}, {i} + 2, 1) || substring({out}, {i} + 1, 1)"
              f" || substring({out}, {i} + 3, {n}))")
        out = f"(CASE WHEN {n} >= 4 THEN {sw} ELSE {out} END)"
    return out


def perturbations(c: str, seed, keys: list[str]) -> dict[str, str]:
    return {
        "no_accent": f"strip_accents({c})",
        "case_lower": f"lower({c})",
        "case_upper": f"upper(replace({c}, 'ß', 'SS'))",
        "typo_2chars": typo(c, seed, keys),
        "abbreviations": abbreviations(c),
    }


def thresholds_values() -> str:
    rows = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SCORE_DROP_THRESHOLD.items())
    return f"(VALUES {rows}) AS thr(perturbation, threshold)"


def bin_expr(s: str, n_bins: int = 10) -> str:
    raw = f"least(greatest(CAST(floor({s} * {n_bins}) AS INTEGER), 0), {n_bins - 1})"
    step = f"(1.0::DOUBLE / {n_bins})"
    lo = f"CAST({raw} AS DOUBLE) * {step}"
    hi = f"CAST({raw} + 1 AS DOUBLE) * {step}"
    return (f"(CASE WHEN {s} >= 0 AND {s} <= 1 THEN (CASE WHEN {s} < {lo} THEN {raw} - 1 "
            f"WHEN {raw} < {n_bins - 1} AND {s} >= {hi} THEN {raw} + 1 ELSE {raw} END) END)")


SQL_U_PAIRS = """up AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS passage
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant')"""
