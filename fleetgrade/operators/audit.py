"""Audit event metrics, fused into one scan where possible."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.columns import count_if, pick
from fleetgrade.functions.topk import top_k
from fleetgrade.sources.window import recent

WS = "workspace_id"

# Action names the reference counts.
LOGIN_ACTIONS = ("login", "tokenLogin", "aadTokenLogin")
PERMISSION_ACTIONS = (
    "changePermissions", "updatePermissions",
    "changeClusterAcl", "changeDbTokenAcl",
    "grantPermission", "revokePermission",
)


def _window(audit: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return recent(audit, "event_date", as_of, days)


def action_counts(audit: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Events and failed responses per (workspace, action): one scan, one shuffle.

    D11, D11a, D12 and D13 all derive from this table; action names per
    workspace are a bounded vocabulary, so the second level is tiny.
    """
    status = pick(audit, "response_status_code", "response.status_code")
    return _window(audit, as_of, days).groupBy(WS, "action_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        count_if(status >= 400).alias("error_count"))


def audit_by_action(audit: DataFrame, as_of: dt.date, days: int = 30, k: int = 30,
                    counts: DataFrame | None = None) -> DataFrame:
    """Events per action, top ``k``."""
    c = counts if counts is not None else action_counts(audit, as_of, days)
    return top_k(c.drop("error_count"), [WS], [F.desc("event_count"), F.asc("action_name")], k)


def audit_total(audit: DataFrame, as_of: dt.date, days: int = 30, k: int = 30,
                counts: DataFrame | None = None) -> DataFrame:
    """Sum of the top-``k`` action rows (Q1), and ``total_events_all`` of every action."""
    c = counts if counts is not None else action_counts(audit, as_of, days)
    top = audit_by_action(audit, as_of, days, k, c).groupBy(WS).agg(F.sum("event_count").cast("bigint").alias("total_events_30d"))
    return top.join(c.groupBy(WS).agg(F.sum("event_count").cast("bigint").alias("total_events_all")), WS)


def audit_summary(audit: DataFrame, as_of: dt.date, days: int = 30,
                  counts: DataFrame | None = None) -> DataFrame:
    """D12 + D13 (+ all events) from the per-action counts."""
    c = counts if counts is not None else action_counts(audit, as_of, days)
    act = F.col("action_name")
    return c.groupBy(WS).agg(
        F.sum("event_count").cast("bigint").alias("events_all"),
        F.coalesce(F.sum(F.when(act.isin(*LOGIN_ACTIONS), F.col("error_count"))), F.lit(0))
        .cast("bigint").alias("failed_logins"),
        F.coalesce(F.sum(F.when(act.isin(*PERMISSION_ACTIONS), F.col("event_count"))), F.lit(0))
        .cast("bigint").alias("permission_changes"),
    )


def failed_logins(audit: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """D12."""
    return audit_summary(audit, as_of, days).select(WS, "failed_logins")


def permission_changes(audit: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """D13."""
    return audit_summary(audit, as_of, days).select(WS, "permission_changes")
