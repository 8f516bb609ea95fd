"""Joins in which one key may hold a large share of the rows.

The rows of a frequent key stay where they are and its one partner row is broadcast; all
other rows meet in a shuffle join. What is broadcast is bounded by ``MOST_HEAVY`` rows, and
beyond them no key has more than 1 / ``MOST_HEAVY`` of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.session import stage

HEAVY_ROWS = 10_000
MOST_HEAVY = 1000


def join_one(rows: DataFrame, side: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``side``, a written table of one row per key that has in ``size`` how many rows have the key."""
    partner = side.drop(size)
    heavy = side.where(F.col(size) > HEAVY_ROWS).select(*keys, size)
    if heavy.isEmpty():
        return rows.join(partner, keys)
    heavy = stage(heavy.orderBy(F.desc(size), *keys).limit(MOST_HEAVY).select(*keys), "heavy")
    few = partner.join(F.broadcast(heavy), keys, "left_semi")
    rest = rows.join(F.broadcast(heavy), keys, "left_anti").join(partner, keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)
