"""Merge several one-row-per-key tables into one wide row per key.

``unionByName`` + one ``groupBy(key).max`` replaces a chain of joins: a single
shuffle of already-aggregated rows, independent of how many parts there are.

``shuffled`` marks a join whose sides Spark must not take for small. It estimates a side by
the size of the files below it, which knows neither how far parquet has packed repeated texts
nor what an explode, a list or a JSON document adds. A side estimated at some MB may hold GB,
and a broadcast passes it whole through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """Each part must have at most one row per ``key`` and disjoint value columns."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in stacked.columns if c != key]
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in cols])


def shuffled(side: DataFrame) -> DataFrame:
    """``side``, to be joined by its key: neither it nor the other side is broadcast by an estimate."""
    return side.hint("merge")
