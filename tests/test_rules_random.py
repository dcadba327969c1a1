"""Differential test: the rule engine vs the independent SQL rule oracle on random rows.

Each row is a workspace input with values drawn around every threshold the rules
use; both sides must give the same score and verified flag for all 140 rules.
"""

import random

import duckdb

from fleetgrade.plans.catalog import RULE_IDS
from fleetgrade.plans import oracles  # noqa: F401  (registers the oracle modules in order)
from fleetgrade.plans.oracles_scoring import _codes
from fleetgrade.plans.scoring import score_rules
from tests.test_rules import BASE, DOUBLES

BOOLS = {k for k, v in BASE.items() if isinstance(v, bool)} | {"has_metastore", "has_open_catalog",
                                                                 "has_settings", "dbfs_off", "ipl_on"}
STRINGS = {"host", "cloud", "metastore_name", "metastore_owner", "delta_sharing_scope", "node_type_sample"}
THRESHOLDS = [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 20, 21, 49, 50, 51, 80, 90, 100, 101, 200, 201, 500, 501]


DEEP = {"total_dbus_30d", "trend_pct_change", "top_cluster_dbus", "total_running_hours_30d", "uptime_rows",
        "max_running_hours", "idle_hours_30d", "idle_rows", "total_queries", "failure_rate_pct",
        "slow_query_count", "wh_rows", "wh_top_count", "total_runs", "success_rate_pct", "failing_jobs",
        "chronic_jobs", "failed_logins", "permission_changes"}


def _value(rng: random.Random, k: str):
    if k == "workspace_id":
        return None
    if k in BOOLS:
        return rng.random() < 0.5
    if k == "cloud":
        return rng.choice(["aws", "azure", "gcp", "unknown"])
    if k == "metastore_owner":
        return rng.choice([None, "", "Account Users", "account_users", "admins"])
    if k == "delta_sharing_scope":
        return rng.choice([None, "", "INTERNAL", "INTERNAL_AND_EXTERNAL"])
    if k in STRINGS:
        return rng.choice([None, "", "x"])
    if k in DOUBLES:
        return rng.choice([None, 0.0, 1.0, 5.0, 5.5, 20.0, 20.5, 30.0, 31.0, 50.0, 51.0, 89.99, 90.0,
                           97.99, 98.0, 100.0, 200.0, 250.0, 500.0, 600.0, 1000.0])
    if k in DEEP and rng.random() < 0.2:
        return None
    return rng.choice(THRESHOLDS)  # feature counts are never NULL (coalesced to 0)


def _cohere(row: dict) -> None:
    """Only combinations the pipeline can produce (see operators.deep)."""
    def null(*ks):
        for k in ks:
            row[k] = None
    row["has_metastore"] = bool(row["metastore_name"]) or row["has_metastore"]
    row["billing_available"] = row["total_dbus_30d"] is not None
    if row["total_dbus_30d"] is None:
        null("trend_pct_change", "top_cluster_dbus")
    up = row["uptime_rows"]
    row["compute_available"] = up is not None and up > 0
    if row["compute_available"]:
        row["total_running_hours_30d"] = row["total_running_hours_30d"] or 0.0
        row["max_running_hours"] = row["max_running_hours"] or 0.0
    else:
        null("uptime_rows", "total_running_hours_30d", "max_running_hours")
    row["audit_available"] = row["failed_logins"] is not None
    if row["failed_logins"] is None:
        null("permission_changes")
    elif row["permission_changes"] is None:
        row["permission_changes"] = 0
    if not row["total_queries"]:
        null("total_queries", "failure_rate_pct", "slow_query_count", "wh_rows", "wh_top_count")
    else:
        row["failure_rate_pct"] = row["failure_rate_pct"] or 0.0
        row["slow_query_count"] = row["slow_query_count"] or 0
        if row["wh_rows"] is None or row["wh_top_count"] is None:
            null("wh_rows", "wh_top_count")
    if not row["total_runs"]:
        null("total_runs", "success_rate_pct")
    else:
        row["success_rate_pct"] = row["success_rate_pct"] or 0.0
    if row["failing_jobs"] is None or row["chronic_jobs"] is None:
        null("failing_jobs", "chronic_jobs")
    else:
        row["chronic_jobs"] = min(row["chronic_jobs"], row["failing_jobs"])


def _schema() -> list[tuple[str, str]]:
    out = []
    for k in BASE:
        if k in DOUBLES:
            out.append((k, "double"))
        elif k in BOOLS:
            out.append((k, "boolean"))
        elif k in STRINGS:
            out.append((k, "string"))
        else:
            out.append((k, "bigint"))
    return out


def test_rule_engine_equals_sql_oracle(spark):
    rng = random.Random(20261201)
    schema = _schema()
    rows = []
    for i in range(400):
        row = {k: _value(rng, k) for k, _t in schema}
        row["workspace_id"] = i
        _cohere(row)
        rows.append(tuple(row[k] for k, _t in schema))

    df = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in schema))
    got = {(r["workspace_id"], r["rule_id"]): (r["score"], r["verified"])
           for r in score_rules(df).select("workspace_id", "rule_id", "score", "verified").collect()}

    con = duckdb.connect()
    duck_types = {"double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "bigint": "BIGINT"}
    con.execute("create table inp (" + ", ".join(f"{k} {duck_types[t]}" for k, t in schema) + ")")
    con.executemany("insert into inp values (" + ", ".join("?" for _ in schema) + ")", rows)
    sql = f"""select workspace_id, rule_id, cast(left(code, 1) as integer) as score, code <> '1U' as verified
              from ({_codes(list(RULE_IDS))})"""
    exp = {(w, r): (s, v) for w, r, s, v in con.execute(sql).fetchall()}

    assert set(got) == set(exp)
    diffs = [(k, got[k], exp[k]) for k in sorted(exp) if got[k] != exp[k]]
    assert not diffs, f"{len(diffs)} differences, e.g. {diffs[:5]}"
