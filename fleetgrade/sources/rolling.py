"""The look-back window kept as daily partial aggregates.

A daily run reads one day of each operational table, reduces it to partials that add up over
days, and writes them under ``<root>/<name>/day=<date>``, replacing that day alone, so a run
that is repeated (late rows, a retry) changes nothing else. The window's aggregates are then
merged from the kept days and feed the same metrics as a scan of the window would:

* usage per (workspace, SKU, cluster): sums;
* cluster hours per (workspace, cluster, name): sums, and the day itself, so active days are
  counted exactly;
* queries per (workspace, warehouse): counts and sums, and per (workspace, duration): counts,
  from which the percentiles are exact;
* runs per (workspace, job, cluster): counts, and which clusters had runs at all;
* events per (workspace, action): counts.

Scale: a day's partials are a map-side aggregated ``groupBy`` of that day's partition; a merge
reads partials of the window's days only (partition pruning) and shuffles one row per key and
day at most. Counts of distinct values are never added up: the values themselves are kept.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.config import AssessConfig
from fleetgrade.functions.columns import count_if, hours, pick
from fleetgrade.operators.compute import _running_ms
from fleetgrade.operators.jobs import _is_failed
from fleetgrade.sources.window import recent, window_bounds

WS = "workspace_id"
TIME = {"usage": "usage_date", "cluster_timeline": "change_time", "query_history": "start_time", "job_runs": "period_start_time",
        "audit": "event_date"}


def daily(name: str, rows: DataFrame, slow_ms: int = 300_000) -> dict[str, DataFrame]:
    """Partials of operational rows per day (``day``), by the name of the kept table."""
    day = F.to_date(TIME[name]).alias("day")
    one = F.count(F.lit(1))
    if name == "usage":
        cluster = pick(rows, "usage_cluster_id", "usage_metadata.cluster_id").alias("cluster_id")
        return {"usage": rows.groupBy(day, WS, "sku_name", cluster).agg(F.sum("usage_quantity").alias("usage_quantity"))}
    if name == "cluster_timeline":
        return {"cluster_hours": rows.groupBy(day, WS, "cluster_id", "cluster_name").agg(
            F.sum(_running_ms()).alias("running_ms"), F.sum("duration_ms").alias("duration_ms"))}
    if name == "query_history":
        st, d = F.col("status"), F.col("duration")
        return {"warehouse_counts": rows.groupBy(day, WS, "warehouse_id").agg(
                    one.alias("query_count"), F.sum(d.cast("double")).alias("duration_sum"), F.count(d).alias("duration_n"),
                    count_if(st == "FINISHED").alias("succeeded"), count_if(st == "FAILED").alias("failed"),
                    count_if(st == "CANCELED").alias("canceled"), count_if((st == "FINISHED") & (d > slow_ms)).alias("slow_query_count")),
                "duration_counts": rows.where(d.isNotNull()).groupBy(day, WS, "duration").agg(one.alias("_c"))}
    if name == "job_runs":
        return {"job_counts": rows.groupBy(day, WS, "job_id", "cluster_id").agg(
            one.alias("total_runs"), count_if(F.col("result_state") == "SUCCESS").alias("succeeded"),
            count_if(_is_failed()).alias("failures"), count_if(F.col("result_state") == "CANCELED").alias("canceled"))}
    status = pick(rows, "response_status_code", "response.status_code")
    return {"action_counts": rows.groupBy(day, WS, "action_name").agg(one.alias("event_count"), count_if(status >= 400).alias("error_count"))}


def update(tables: dict[str, DataFrame], root: str, as_of: dict[str, dt.date], days: int = 0, slow_ms: int = 300_000) -> None:
    """Write the partials of ``[as_of - days, as_of]`` per source; with ``days=0`` one day is read and replaced."""
    for name, rows in tables.items():
        for kept, partial in daily(name, recent(rows, TIME[name], as_of[name], days), slow_ms).items():
            (partial.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("day").parquet(f"{root.rstrip('/')}/{kept}"))


def _kept(spark: SparkSession, root: str, name: str, as_of: dt.date, days: int) -> DataFrame:
    lo, hi = window_bounds(as_of, days)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}").where((F.col("day") >= F.lit(lo)) & (F.col("day") < F.lit(hi)))


def merged(spark: SparkSession, root: str, cfg: AssessConfig) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(stand-ins for the operational tables, shared aggregates) of the window, for ``deep_metrics``."""
    kept = lambda name, source: _kept(spark, root, name, cfg.as_of_for(source), cfg.lookback_days)
    total = lambda df, keys, cols: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])
    u = kept("usage", "usage").select(WS, "sku_name", F.col("day").alias("usage_date"), F.col("cluster_id").alias("usage_cluster_id"), "usage_quantity")
    h = kept("cluster_hours", "cluster_timeline").groupBy(WS, "cluster_id", "cluster_name").agg(
        F.sum("running_ms").alias("running_ms"), hours(F.sum("running_ms")).alias("running_hours"),
        hours(F.sum("duration_ms")).alias("total_hours"), F.count_distinct("day").alias("active_days"))
    runs = kept("job_counts", "job_runs")
    from fleetgrade.operators import billing
    shared = {
        "usage_rollup": billing.usage_rollup(u, cfg.as_of_for("usage"), cfg.lookback_days),
        "cluster_hours": h,
        "warehouse_counts": total(kept("warehouse_counts", "query_history"), [WS, "warehouse_id"],
                                  ["query_count", "duration_sum", "duration_n", "succeeded", "failed", "canceled", "slow_query_count"]),
        "duration_counts": total(kept("duration_counts", "query_history"), [WS, "duration"], ["_c"]),
        "job_counts": total(runs, [WS, "job_id"], ["total_runs", "succeeded", "failures", "canceled"]),
        "action_counts": total(kept("action_counts", "audit"), [WS, "action_name"], ["event_count", "error_count"]),
    }
    # The metrics ask the sources themselves only for durations and for the clusters that had runs.
    tables = {
        "usage": u, "cluster_timeline": h,
        "query_history": kept("duration_counts", "query_history").select(WS, F.col("day").alias("start_time"), "duration"),
        "job_runs": runs.select(WS, "cluster_id", F.col("day").alias("period_start_time")),
        "audit": kept("action_counts", "audit"),
    }
    return tables, shared
