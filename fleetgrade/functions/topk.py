"""Top-k per group.

``row_number() <= k`` over a window is rewritten by Catalyst into a partial
``WindowGroupLimit`` before the shuffle and a final one after it, so each group
ships at most ``k`` rows per input partition: a hot group never lands in one
task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank_col: str | None = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each ``keys`` group by ``order``.

    ``order`` must end with a unique tie-break so results are deterministic
    (the reference's LIMIT has none).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    if rank_col:
        return out.withColumn(rank_col, F.col("_rn").cast("bigint")).drop("_rn")
    return out.drop("_rn")
