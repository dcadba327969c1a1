"""Job run metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.columns import count_if, ratio_pct, round_half_even
from fleetgrade.functions.topk import top_k
from fleetgrade.sources.window import recent

WS = "workspace_id"
FAILED_STATES = ("FAILED", "TIMEDOUT", "INTERNAL_ERROR")


def _is_failed():
    return F.col("result_state").isin(*FAILED_STATES)


def job_counts(runs: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Runs by outcome per (workspace, job): one scan and one shuffle for D9 and D10."""
    r = recent(runs, "period_start_time", as_of, days)
    return r.groupBy(WS, "job_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        count_if(F.col("result_state") == "SUCCESS").alias("succeeded"),
        count_if(_is_failed()).alias("failures"),
        count_if(F.col("result_state") == "CANCELED").alias("canceled"),
    )


def job_run_stats(runs: DataFrame, as_of: dt.date, days: int = 30,
                  counts: DataFrame | None = None) -> DataFrame:
    """Total, succeeded, failed (three states), canceled."""
    c = counts if counts is not None else job_counts(runs, as_of, days)
    return c.groupBy(WS).agg(
        F.sum("total_runs").cast("bigint").alias("total_runs"),
        F.sum("succeeded").cast("bigint").alias("succeeded"),
        F.sum("failures").cast("bigint").alias("failed"),
        F.sum("canceled").cast("bigint").alias("canceled"),
    )


def job_success_rate(stats: DataFrame) -> DataFrame:
    """(total - failed) / total x 100, 2 decimals; canceled counts as not failed (Q4)."""
    raw = ratio_pct(F.col("total_runs") - F.col("failed"), F.col("total_runs"))
    return stats.select(
        WS, "total_runs", "failed",
        F.coalesce(raw, F.lit(0.0)).alias("success_rate_raw"),
        F.coalesce(round_half_even(raw, 2), F.lit(0.0)).alias("success_rate_pct"),
    )


def top_failing_jobs(runs: DataFrame, as_of: dt.date, days: int = 30, k: int = 10,
                     counts: DataFrame | None = None) -> DataFrame:
    """Per job runs and failures; failures > 0; top ``k`` by failures."""
    c = counts if counts is not None else job_counts(runs, as_of, days)
    agg = c.where(F.col("failures") > 0).select(WS, "job_id", "total_runs", "failures")
    return top_k(agg, [WS], [F.desc("failures"), F.asc("job_id")], k)
