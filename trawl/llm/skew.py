"""Joins with a table of one row per key, some of whose keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast; a key of fewer rows than LEAST never is.
MOST, LEAST = 100_000, 1000


def join_sized(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` inner-joined with ``table`` (one row per key; ``size`` is how many of the rows
    have it).

    Keys of more than LEAST rows and more than 1 / MOST of all rows are at most MOST: they are
    broadcast, and only the rows of smaller keys are shuffled. Keys are not null; both sides
    are read twice and should be written tables.
    """
    bar = max(LEAST, rows.count() // MOST)
    large = table.where(F.col(size) > bar)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(table.where(F.col(size) <= bar), keys))
