"""Operator edge cases, brute-force checks and fleet-equals-single."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgrade.config import FIXTURE_CONFIG
from fleetgrade.functions.percentile import exact_percentiles
from fleetgrade.functions.substring_join import contains_any
from fleetgrade.operators import billing, queries
from fleetgrade.operators.features import cloud_of_host
from fleetgrade.plans.registered import REGISTRY
from fleetgrade.sources.fixtures import Fixtures
from fleetgrade.sources.window import recent
from tests.conftest import SF001


def _spark_percentile(values, p):
    s = sorted(values)
    pos = p * (len(s) - 1)
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    if lo == hi or s[lo] == s[hi]:
        return float(s[lo])
    return (hi - pos) * s[lo] + (pos - lo) * s[hi]


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_exact_percentile_matches_brute_force(spark, bits):
    rng = random.Random(7)
    rows = []
    groups = {}
    for g in range(5):
        n = rng.choice([1, 2, 3, 50, 400])
        for _ in range(n):
            v = rng.choice([rng.randint(0, 20), rng.randint(0, 10**6)])
            rows.append((g, v))
            groups.setdefault(g, []).append(v)
    rows.append((9, None))  # all-null group yields no row
    df = spark.createDataFrame(rows, "g int, v bigint")
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in
           exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, bucket_bits=bits).collect()}
    assert set(got) == set(groups)
    for g, vals in groups.items():
        exp = tuple(_spark_percentile(vals, p) for p in (0.5, 0.95, 0.99))
        assert got[g] == pytest.approx(exp, rel=1e-12, abs=1e-9)


def test_exact_percentile_matches_builtin(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 1000) for i in range(3000)], "g int, v bigint")
    ours = {r["g"]: r["p"] for r in exact_percentiles(df, ["g"], "v", {"p": 0.95}, bucket_bits=4).collect()}
    ref = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", 0.95).alias("p")).collect()}
    assert ours == pytest.approx(ref)


def test_substring_join_matches_brute_force(spark):
    jobs = [(1, 1, "SP-1-runner"), (1, 2, "alice@x.com"), (1, 3, None), (2, 4, "deploy-bot"),
            (2, 5, "BOTANY"), (3, 6, "anything")]
    sps = [(1, "sp-1"), (1, ""), (2, "bot"), (2, "deploy-bot-long"), (4, "x")]
    jdf = spark.createDataFrame(jobs, "workspace_id int, job_id int, creator string")
    sdf = spark.createDataFrame(sps, "workspace_id int, name string")
    got = sorted((r[0], r[1]) for r in contains_any(jdf, ["workspace_id"], ["job_id"], "creator", sdf, "name")
                 .select("workspace_id", "job_id").collect())
    exp = sorted({(w, j) for w, j, c in jobs for w2, n in sps
                  if w == w2 and c is not None and n and n.lower() in c.lower()})
    assert got == exp


def test_cloud_of_host_seeds(spark):
    cases = {"https://acme.cloud.databricks.com": "aws", "https://acme.azuredatabricks.net": "azure",
             "https://acme.gcp.databricks.com": "gcp", "": "unknown", "https://random.example.com": "unknown",
             "https://x.databricks.com/": "aws", None: "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "host string")
    got = {r["host"]: r["c"] for r in df.select("host", cloud_of_host(F.col("host")).alias("c")).collect()}
    assert got == cases


def test_window_bounds_and_pushdown(spark):
    u = Fixtures(spark, SF001).usage
    w = recent(u, "usage_date", dt.date(2001, 8, 1), 30)
    days = [r[0] for r in w.select("usage_date").distinct().collect()]
    assert min(days) >= dt.date(2001, 7, 2) and max(days) <= dt.date(2001, 8, 1)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    plan = recent(ev, "ts", dt.date(2024, 1, 31), 14)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_trend_needs_seven_days(spark):
    rows = [(1, dt.date(2024, 1, d), "s", float(d), None) for d in range(1, 6)]
    rows += [(2, dt.date(2024, 1, d), "s", 10.0 if d <= 7 else 20.0, None) for d in range(1, 15)]
    df = spark.createDataFrame(rows, "workspace_id int, usage_date date, sku_name string, "
                                     "usage_quantity double, usage_cluster_id string")
    got = {r["workspace_id"]: r["trend_pct_change"]
           for r in billing.spend_trend(df, dt.date(2024, 1, 14), 30).collect()}
    assert got == {1: None, 2: 100.0}


def test_nested_product_schema(spark):
    """Operators accept the nested production layout as well as the flat fixtures."""
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 10), "A", 5.0, ("c1",)), (1, dt.date(2024, 1, 11), "A", 7.0, (None,))],
        "workspace_id int, usage_date date, sku_name string, usage_quantity double, "
        "usage_metadata struct<cluster_id: string>")
    got = billing.top_cost_clusters(df, dt.date(2024, 1, 31), 30).collect()
    assert [(r["cluster_id"], r["total_dbus"]) for r in got] == [("c1", 5.0)]


def test_empty_window_gives_no_rows(spark):
    qh = Fixtures(spark, SF001).query_history
    st = queries.query_stats(qh, dt.date(1990, 1, 1), 30)
    assert st.count() == 0


@pytest.mark.parametrize("key", ["query_stats", "top_failing_jobs", "cluster_uptime", "features_jobs"])
def test_fleet_equals_single(spark, key):
    """A workspace's rows give the same result alone as inside the fleet."""
    full = REGISTRY[key](spark, SF001).where(F.col("workspace_id") == 3)
    fx = Fixtures(spark, SF001)
    cfg = FIXTURE_CONFIG
    if key == "query_stats":
        single = queries.query_stats(fx.query_history.where("workspace_id = 3"), cfg.as_of_for("query_history"))
        single = single.withColumn("p95_duration_ms", F.round("p95_duration_ms", 2)).withColumn(
            "p99_duration_ms", F.round("p99_duration_ms", 2))
    elif key == "top_failing_jobs":
        from fleetgrade.operators import jobs
        single = jobs.top_failing_jobs(fx.job_runs.where("workspace_id = 3"), cfg.as_of_for("job_runs"))
    elif key == "cluster_uptime":
        from fleetgrade.operators import compute
        single = compute.cluster_uptime(fx.cluster_timeline.where("workspace_id = 3"),
                                        cfg.as_of_for("cluster_timeline"))
    else:
        from fleetgrade.operators import features
        single = features.features_jobs(fx.jobs.where("workspace_id = 3"),
                                        fx.service_principals.where("workspace_id = 3"))
    a = sorted(map(tuple, full.select(*sorted(full.columns)).collect()))
    b = sorted(map(tuple, single.select(*sorted(single.columns)).collect()))
    assert a == b


def test_missing_source_makes_it_unavailable(spark):
    from fleetgrade.operators import deep
    from fleetgrade.sources.availability import operational_tables
    fx = Fixtures(spark, SF001)
    fx.audit.createOrReplaceTempView("fg_audit_present")
    tables = operational_tables(spark, {"audit": "fg_audit_present", "usage": "fg_no_such_table"})
    assert set(tables) == {"audit"}
    dm = deep.deep_metrics(tables, FIXTURE_CONFIG).collect()
    assert dm and all(r["audit_available"] and not r["billing_available"] for r in dm)


def test_nested_audit_response(spark):
    from fleetgrade.operators import audit
    rows = [(1, dt.date(2024, 1, 10), "login", (401,)), (1, dt.date(2024, 1, 10), "login", (200,)),
            (1, dt.date(2024, 1, 11), "changeClusterAcl", (200,)), (2, dt.date(2024, 1, 11), "tokenLogin", (500,))]
    df = spark.createDataFrame(rows, "workspace_id int, event_date date, action_name string, "
                                     "response struct<status_code: int>")
    got = {r["workspace_id"]: (r["events_all"], r["failed_logins"], r["permission_changes"])
           for r in audit.audit_summary(df, dt.date(2024, 1, 31)).collect()}
    assert got == {1: (3, 1, 1), 2: (1, 1, 0)}


def test_scim_list_cap(spark):
    import json
    from fleetgrade.sources import inventory as inv
    body = json.dumps({"totalResults": 150, "Resources": [{"displayName": f"g{i}", "externalId": "e"} for i in range(150)]})
    p = spark.createDataFrame([(1, inv.ENDPOINTS["scim_groups"], 0, body)], inv.PAYLOAD_SCHEMA)
    assert inv.scim_groups(p).count() == 150
    assert inv.scim_groups(p, list_cap=True).count() == 100
    assert inv.scim_counts(p, "scim_groups", "n").collect()[0]["n"] == 150


def test_approx_percentile_option(spark):
    """The sketch option returns, per workspace, a value between the exact p90 and p99."""
    import dataclasses
    from fleetgrade.operators import deep
    from fleetgrade.plans.registered import deep_tables
    cfg = dataclasses.replace(FIXTURE_CONFIG, percentile="approx")
    approx = {r["workspace_id"]: r["p95_duration_ms"] for r in
              deep.deep_metrics(deep_tables(spark, SF001), cfg).collect()}
    q = recent(Fixtures(spark, SF001).query_history, "start_time", FIXTURE_CONFIG.as_of_for("query_history"), 30)
    bounds = {r["workspace_id"]: (r["p90"], r["p99"]) for r in
              exact_percentiles(q, ["workspace_id"], "duration", {"p90": 0.90, "p99": 0.99}).collect()}
    assert set(approx) == set(bounds)
    for k, v in approx.items():
        lo, hi = bounds[k]
        assert lo - 1e-6 <= v <= hi + 1e-6


def test_scoring_with_missing_sources(spark):
    """No deep scan, or a missing source: every rule still scores (deep rules unverified)."""
    from fleetgrade.plans.assess import assess
    from fleetgrade.plans.registered import deep_tables, inventory
    for ops in (None, {"audit": deep_tables(spark, SF001)["audit"]}):
        sc = assess(inventory(spark, SF001), ops, FIXTURE_CONFIG, materialize=False).scores
        rows = sc.where(F.col("rule_id").isin("ops-024", "cost-022", "perf-026")).collect()
        assert rows and all(r["score"] == 1 and not r["verified"] for r in rows)
        assert sc.count() == 140 * 10


def test_objects_are_not_sorted_for_features(spark):
    """Only rows already reduced per workspace and text meet an aggregate of text, which sorts."""
    from fleetgrade.operators import features
    rows = spark.range(1000).select((F.col("id") % 2).alias("workspace_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), (F.col("id") % 5).cast("string"))).alias("t"),
                                    F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    spec = [("n", F.lit(1), "sum"), ("some", F.col("v") > 990, "any"), ("most", F.col("v"), "max"), ("kinds", F.col("t"), "distinct"), ("sample", F.col("t"), "min")]
    few = features.reduced(rows, spec)
    assert few.count() == 10 and "SortAggregate" not in few._jdf.queryExecution().executedPlan().toString()
    again = few.groupBy("workspace_id").agg(*[features._AGG[a](F.col(n)).alias(n) for n, _e, a in spec])
    assert sorted(again.collect()) == sorted(features._aggregate(rows, spec).collect())
