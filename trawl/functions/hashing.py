"""Portable seeded hashing.

``hash_key(seed, *cols)`` = first 15 hex digits of ``md5("seed|c1|c2...")`` read as a
non-negative BIGINT. The same number is produced by DuckDB with
``('0x' || substr(md5(concat_ws('|', seed, c1, ...)), 1, 15))::BIGINT``, which is what
makes seeded sampling comparable against the SQL oracle. Ordering by this key gives a
uniform random permutation per seed; ``pmod(key, n)`` gives a uniform draw in ``[0, n)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def hash_key(seed, *parts) -> Column:
    """Seeded 60-bit md5 key over the given columns/literals."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_index(seed, n, *parts) -> Column:
    """Uniform draw in ``[0, n)`` keyed by (seed, parts)."""
    return F.pmod(hash_key(seed, *parts), _as_col(n).cast("bigint"))


def sql_hash_key(seed, *parts: str) -> str:
    """DuckDB text of :func:`hash_key` (used by the oracle SQL)."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"
