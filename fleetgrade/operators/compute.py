"""Cluster timeline metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.columns import hours, round_half_even
from fleetgrade.functions.topk import top_k
from fleetgrade.sources.window import recent

WS = "workspace_id"


def _running_ms():
    return F.when(F.col("state") == "RUNNING", F.col("duration_ms")).otherwise(F.lit(0))


def cluster_hours(timeline: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """All (cluster_id, cluster_name) groups with RUNNING / total hours and active dates."""
    t = recent(timeline, "change_time", as_of, days)
    return t.groupBy(WS, "cluster_id", "cluster_name").agg(
        F.sum(_running_ms()).alias("running_ms"),
        hours(F.sum(_running_ms())).alias("running_hours"),
        hours(F.sum("duration_ms")).alias("total_hours"),
        F.count_distinct(F.to_date("change_time")).alias("active_days"),
    )


def cluster_uptime(timeline: DataFrame, as_of: dt.date, days: int = 30, k: int = 20,
                   hours_by_cluster: DataFrame | None = None) -> DataFrame:
    """Groups with RUNNING hours > 0, top ``k`` by RUNNING hours (Q3: id and name)."""
    h = hours_by_cluster if hours_by_cluster is not None else cluster_hours(timeline, as_of, days)
    agg = h.where(F.col("running_hours") > 0)
    return top_k(agg, [WS], [F.desc("running_hours"), F.asc("cluster_id"), F.asc("cluster_name")], k)


def _names(condition, width: int, first: int = 3):
    """The first names, by rank, of the top-k rows that meet a condition (at most k rows a workspace)."""
    name = F.substring(F.coalesce("cluster_name", "cluster_id", F.lit("?")), 1, width)
    ranked = F.sort_array(F.collect_list(F.when(condition, F.struct("rank", name.alias("name")))))
    return F.array_join(F.transform(F.slice(ranked, 1, first), lambda x: x["name"]), ", ")


ALWAYS_ON_HOURS = 500   # more in 30 days means nearly around the clock


def running_hours_total(timeline: DataFrame, as_of: dt.date, days: int = 30, k: int = 20,
                        hours_by_cluster: DataFrame | None = None) -> DataFrame:
    """Sum of the top-``k`` uptime rows, 1 decimal (Q1), plus count, max and names for rules.

    ``running_hours_all`` is the sum over every cluster, not over the top rows.
    """
    h = hours_by_cluster if hours_by_cluster is not None else cluster_hours(timeline, as_of, days)
    up = cluster_uptime(timeline, as_of, days, k, h)
    # Sum integer milliseconds, then convert: exact and independent of row order.
    s = hours(F.sum("running_ms"))
    always = F.col("running_hours") > ALWAYS_ON_HOURS
    top = up.groupBy(WS).agg(
        s.alias("running_hours_raw"),
        round_half_even(s, 1).alias("total_running_hours_30d"),
        F.count(F.lit(1)).alias("uptime_rows"),
        F.max("running_hours").alias("max_running_hours"),
        F.count_if(always).alias("always_on_rows"),
        _names(always, 25).alias("always_on_names"),
    )
    whole = h.where(F.col("running_hours") > 0).groupBy(WS).agg(round_half_even(hours(F.sum("running_ms")), 1).alias("running_hours_all"))
    return top.join(whole, WS)


def idle_clusters(timeline: DataFrame, job_runs: DataFrame, as_of: dt.date,
                  days: int = 30, k: int = 10, runs_as_of: dt.date | None = None,
                  hours_by_cluster: DataFrame | None = None) -> DataFrame:
    """Clusters with no job run in the window; RUNNING hours > 1; top ``k``.

    The reference's LEFT JOIN ... IS NULL is written as a left anti join on
    pre-aggregated sides: timeline rows collapse to one per cluster group and
    job runs to distinct cluster ids before the join, so the join moves
    (workspace, cluster) keys, not events.
    """
    idle = _idle(timeline, job_runs, as_of, days, runs_as_of, hours_by_cluster)
    return top_k(idle, [WS], [F.desc("running_hours"), F.asc("cluster_id"), F.asc("cluster_name")], k)


def _idle(timeline, job_runs, as_of, days, runs_as_of=None, hours_by_cluster=None) -> DataFrame:
    """Every idle cluster group."""
    # Same (workspace, cluster, name) aggregate as D4, so a fused plan reuses it.
    h = hours_by_cluster if hours_by_cluster is not None else cluster_hours(timeline, as_of, days)
    per_cluster = h.select(WS, "cluster_id", "cluster_name", "running_ms", "running_hours")
    r = recent(job_runs, "period_start_time", runs_as_of or as_of, days)
    used = r.where(F.col("cluster_id").isNotNull()).select(WS, "cluster_id").distinct()
    return per_cluster.join(used, on=[WS, "cluster_id"], how="left_anti").where(F.col("running_hours") > 1)


def idle_hours_total(timeline: DataFrame, job_runs: DataFrame, as_of: dt.date,
                     days: int = 30, k: int = 10, hours_by_cluster: DataFrame | None = None) -> DataFrame:
    """Sum of the top-``k`` idle rows, 1 decimal (Q1), their first names, and ``idle_hours_all`` of every idle cluster."""
    every = _idle(timeline, job_runs, as_of, days, hours_by_cluster=hours_by_cluster)
    idle = top_k(every, [WS], [F.desc("running_hours"), F.asc("cluster_id"), F.asc("cluster_name")], k)
    s = hours(F.sum("running_ms"))
    top = idle.groupBy(WS).agg(
        s.alias("idle_hours_raw"),
        round_half_even(s, 1).alias("idle_hours_30d"),
        F.count(F.lit(1)).alias("idle_rows"),
        _names(F.lit(True), 30).alias("idle_names"),
    )
    return top.join(every.groupBy(WS).agg(round_half_even(s, 1).alias("idle_hours_all")), WS)
