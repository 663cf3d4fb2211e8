"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads whole driver tables (or data Spark
derives from them). The oracle SQL runs on the same tables registered as DuckDB views;
columns are aliased identically on both sides. Queries without SQL (iterative or
randomised-by-training operators) are registered with ``sql=None``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from trawl.plans import (  # noqa: F401
        q_eval,
        q_sources,
        q_mining,
        q_quality,
        q_ranking,
    )
