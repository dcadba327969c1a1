"""Query-history metrics per workspace.

One scan of the window feeds D6, D6a and D7 (fused conditional aggregates);
D8 is a second aggregate on (workspace, warehouse).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.columns import count_if, ratio_pct, round_half_even
from fleetgrade.functions.percentile import approx_percentiles, exact_percentiles
from fleetgrade.functions.topk import top_k
from fleetgrade.sources.window import recent

WS = "workspace_id"
PROBS = {"p95_duration_ms": 0.95, "p99_duration_ms": 0.99}


def warehouse_counts(history: DataFrame, as_of: dt.date, days: int = 30,
                     slow_ms: int = 300_000) -> DataFrame:
    """Counts by status and duration sums per (workspace, warehouse incl. NULL).

    D6 (except percentiles), D7 and D8 all derive from this one aggregate, so
    the history window is scanned and shuffled once for them.
    """
    q = recent(history, "start_time", as_of, days)
    st, d = F.col("status"), F.col("duration")
    return q.groupBy(WS, "warehouse_id").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.sum(d.cast("double")).alias("duration_sum"),
        F.count(d).alias("duration_n"),
        count_if(st == "FINISHED").alias("succeeded"),
        count_if(st == "FAILED").alias("failed"),
        count_if(st == "CANCELED").alias("canceled"),
        count_if((st == "FINISHED") & (d > slow_ms)).alias("slow_query_count"),
    )


def query_stats(history: DataFrame, as_of: dt.date, days: int = 30,
                slow_ms: int = 300_000, percentile: str = "exact",
                counts: DataFrame | None = None, value_counts: DataFrame | None = None) -> DataFrame:
    """D6 + D7: counts by status, mean and p95/p99 duration, slow-query count."""
    c = counts if counts is not None else warehouse_counts(history, as_of, days, slow_ms)
    stats = c.groupBy(WS).agg(
        F.sum("query_count").cast("bigint").alias("total_queries"),
        F.sum("succeeded").cast("bigint").alias("succeeded"),
        F.sum("failed").cast("bigint").alias("failed"),
        F.sum("canceled").cast("bigint").alias("canceled"),
        F.try_divide(F.sum("duration_sum"), F.sum("duration_n").cast("double")).alias("avg_duration_ms"),
        F.sum("slow_query_count").cast("bigint").alias("slow_query_count"),
    )
    q = recent(history, "start_time", as_of, days).select(WS, "duration")
    if percentile == "exact":
        pcts = exact_percentiles(q, [WS], "duration", PROBS, counts=value_counts)
    else:
        pcts = approx_percentiles(q, [WS], "duration", PROBS)
    return stats.join(pcts, on=WS, how="left")


def query_failure_rate(stats: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Failed / total x 100, 2 decimals; 0 when there is no query."""
    raw = ratio_pct(F.col("failed"), F.col("total_queries"))
    return stats.select(
        WS, "total_queries", "failed", *(keep or []),
        F.coalesce(raw, F.lit(0.0)).alias("failure_rate_raw"),
        F.coalesce(round_half_even(raw, 2), F.lit(0.0)).alias("failure_rate_pct"),
    )


def slow_queries(stats: DataFrame) -> DataFrame:
    """D7 as its own table."""
    return stats.select(WS, "slow_query_count")


def warehouse_utilization(history: DataFrame, as_of: dt.date, days: int = 30,
                          k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Per warehouse query count, mean duration, failures; top ``k`` by count."""
    c = counts if counts is not None else warehouse_counts(history, as_of, days)
    agg = c.where(F.col("warehouse_id").isNotNull()).select(
        WS, "warehouse_id", "query_count",
        F.try_divide(F.col("duration_sum"), F.col("duration_n").cast("double")).alias("avg_duration_ms"),
        F.col("failed").alias("failures"))
    return top_k(agg, [WS], [F.desc("query_count"), F.asc("warehouse_id")], k)
