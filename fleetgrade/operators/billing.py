"""Billing usage metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgrade.functions.columns import pick, round_half_even
from fleetgrade.functions.topk import top_k
from fleetgrade.sources.window import recent

WS = "workspace_id"


def _window(usage: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return recent(usage, "usage_date", as_of, days)


def usage_rollup(usage: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Usage summed per (ws, SKU), (ws, date) and (ws, cluster) in ONE aggregate.

    ``GROUPING SETS`` expands each row three ways before the map-side partial
    aggregation, so the window is scanned once and shuffled once for D1-D3;
    ``level`` tells the three result sets apart.
    """
    cid = pick(usage, "usage_cluster_id", "usage_metadata.cluster_id")
    u = _window(usage, as_of, days).select(WS, "sku_name", "usage_date", cid.alias("cluster_id"), "usage_quantity")
    agg = u.groupingSets([[WS, "sku_name"], [WS, "usage_date"], [WS, "cluster_id"]],
                         WS, "sku_name", "usage_date", "cluster_id").agg(
        F.sum("usage_quantity").cast("double").alias("dbus"),
        F.grouping("sku_name").alias("_gs"), F.grouping("usage_date").alias("_gd"))
    level = F.when(F.col("_gs") == 0, F.lit("sku")).when(F.col("_gd") == 0, F.lit("date")).otherwise(F.lit("cluster"))
    return agg.select(WS, "sku_name", "usage_date", "cluster_id", "dbus", level.alias("level"))


def spend_by_sku(usage: DataFrame, as_of: dt.date, days: int = 30, k: int = 20,
                 rollup: DataFrame | None = None) -> DataFrame:
    """D1 per workspace: usage and distinct workspaces per SKU, top ``k`` by usage."""
    if rollup is not None:
        # Per-workspace grain: the distinct workspace count of a group is 1.
        agg = rollup.where(F.col("level") == "sku").select(
            WS, "sku_name", F.col("dbus").alias("total_dbus"), F.lit(1).cast("bigint").alias("workspace_count"))
    else:
        agg = _window(usage, as_of, days).groupBy(WS, "sku_name").agg(
            F.sum("usage_quantity").cast("double").alias("total_dbus"),
            F.count_distinct(WS).alias("workspace_count"),
        )
    return top_k(agg, [WS], [F.desc("total_dbus"), F.asc("sku_name")], k)


def spend_by_sku_fleet(usage: DataFrame, as_of: dt.date, days: int = 30, k: int = 20) -> DataFrame:
    """D1 over the whole fleet: the distinct-workspace count is meaningful here.

    The SKU aggregate has one row per SKU, so the final top-k is a single
    ``TakeOrderedAndProject`` over a tiny input.
    """
    agg = _window(usage, as_of, days).groupBy("sku_name").agg(
        F.sum("usage_quantity").cast("double").alias("total_dbus"),
        F.count_distinct(WS).alias("workspace_count"),
    )
    return agg.orderBy(F.desc("total_dbus"), F.asc("sku_name")).limit(k)


def total_dbus(usage: DataFrame, as_of: dt.date, days: int = 30, k: int = 20,
               rollup: DataFrame | None = None) -> DataFrame:
    """Sum of the top-``k`` SKU rows (quirk Q1) and of all SKUs.

    The top-k sum goes through the bounded per-workspace top-k; the all-SKU
    total is a plain partial aggregate of the same SKU table.
    """
    if rollup is not None:
        skus = rollup.where(F.col("level") == "sku").select(WS, F.col("dbus").alias("total_dbus"))
    else:
        skus = _window(usage, as_of, days).groupBy(WS, "sku_name").agg(
            F.sum("usage_quantity").cast("double").alias("total_dbus"))
    top = spend_by_sku(usage, as_of, days, k, rollup).groupBy(WS).agg(F.sum("total_dbus").alias("total_dbus_30d"))
    allr = skus.groupBy(WS).agg(F.sum("total_dbus").alias("total_dbus_all"))
    return top.join(allr, on=WS, how="inner")


def daily_spend(usage: DataFrame, as_of: dt.date, days: int = 30,
                rollup: DataFrame | None = None) -> DataFrame:
    """Usage per date."""
    if rollup is not None:
        return rollup.where(F.col("level") == "date").select(WS, "usage_date", F.col("dbus").alias("daily_dbus"))
    return _window(usage, as_of, days).groupBy(WS, "usage_date").agg(
        F.sum("usage_quantity").cast("double").alias("daily_dbus"))


def spend_trend(usage: DataFrame, as_of: dt.date, days: int = 30,
                rollup: DataFrame | None = None) -> DataFrame:
    """(mean of last 7 daily rows - mean of first 7) / first x 100.

    Rows, not calendar days (quirk Q2). NULL with fewer than 7 rows or a zero
    first week. A workspace has at most ``days + 1`` daily rows, so the window
    partition is bounded by the look-back, not by data volume.
    """
    d = daily_spend(usage, as_of, days, rollup)
    w = Window.partitionBy(WS)
    d = (d.withColumn("_asc", F.row_number().over(w.orderBy(F.asc("usage_date"))))
          .withColumn("_desc", F.row_number().over(w.orderBy(F.desc("usage_date")))))
    agg = d.groupBy(WS).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum(F.when(F.col("_asc") <= 7, F.col("daily_dbus"))).alias("_first"),
        F.sum(F.when(F.col("_desc") <= 7, F.col("daily_dbus"))).alias("_last"),
    )
    first = F.col("_first") / F.lit(7.0)
    last = F.col("_last") / F.lit(7.0)
    raw = F.when((F.col("n_days") >= 7) & (first > 0), (last - first) / first * F.lit(100.0))
    return agg.select(WS, "n_days", first.alias("first_week_avg"), last.alias("last_week_avg"),
                      raw.alias("trend_pct_raw"), round_half_even(raw, 1).alias("trend_pct_change"))


def top_cost_clusters(usage: DataFrame, as_of: dt.date, days: int = 30, k: int = 10,
                      rollup: DataFrame | None = None) -> DataFrame:
    """D3: usage per non-null cluster, top ``k``."""
    if rollup is not None:
        agg = rollup.where((F.col("level") == "cluster") & F.col("cluster_id").isNotNull()).select(
            WS, "cluster_id", F.col("dbus").alias("total_dbus"))
        return top_k(agg, [WS], [F.desc("total_dbus"), F.asc("cluster_id")], k)
    cid = pick(usage, "usage_cluster_id", "usage_metadata.cluster_id")
    u = _window(usage, as_of, days).select(WS, cid.alias("cluster_id"), "usage_quantity")
    agg = u.where(F.col("cluster_id").isNotNull()).groupBy(WS, "cluster_id").agg(
        F.sum("usage_quantity").cast("double").alias("total_dbus"))
    return top_k(agg, [WS], [F.desc("total_dbus"), F.asc("cluster_id")], k)
