"""Dense numbers in a global order, without a window over the table or over a hot group."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.session import cut_lineage

_LOW = (1 << 33) - 1  # monotonically_increasing_id holds the partition above these bits


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 … in ``order``, rows that tie in the order they are read.

    Rows are range partitioned by the order (and by their place in the input, so that equal
    rows spread, too), sorted inside each partition and written once with their place there.
    Only one count per partition reaches the driver; prefix sums of the counts become the
    partitions' offsets. No task sees more than its range, whatever the keys are.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut_lineage(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, F.col("_tie"))
        .sortWithinPartitions(*keys, F.col("_tie")).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    offsets = accumulate((r["c"] for r in counts), initial=0)
    starts = spark.createDataFrame([(r["p"], o) for r, o in zip(counts, offsets)], "_p long, _first long")
    return (placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
            .withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_p", "_first", "_at"))


def numbered_within(df: DataFrame, group: str, order: list[str | Column], name: str = "number",
                    partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 … in ``order`` inside each ``group`` (null is a group of its own).

    Rows are numbered across all groups first; a group's numbers then start at its least
    one, which is a partial aggregate. A hot group stays spread over its ranges.
    """
    rows = numbered(df, [group, *order], "_global", partitions)
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_global").alias("_start"))
    return (rows.join(first, F.col(group).eqNullSafe(F.col("_group")))
            .withColumn(name, F.col("_global") - F.col("_start")).drop("_global", "_group", "_start"))
