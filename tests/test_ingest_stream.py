"""Payload normalization edge cases and the snapshot re-scoring stream."""

import json
import tempfile

from pyspark.sql import functions as F

from fleetgrade.config import FIXTURE_CONFIG
from fleetgrade.plans.assess import assess
from fleetgrade.plans.registered import deep_tables, inventory
from fleetgrade.sources import inventory as inv
from fleetgrade.sources.fixtures import Fixtures
from fleetgrade.sources.landing import land
from fleetgrade.streaming.rescore import start_rescoring
from tests.conftest import SF001


def payloads(spark, rows):
    return spark.createDataFrame(rows, inv.PAYLOAD_SCHEMA)


def test_bad_json_is_not_ok_and_skipped(spark):
    p = payloads(spark, [
        (1, inv.ENDPOINTS["clusters"], 0, json.dumps({"clusters": [{"cluster_id": "a", "state": "RUNNING"}, "junk", 3]})),
        (2, inv.ENDPOINTS["clusters"], 0, "{not json"),
    ])
    pg = {r["workspace_id"]: r["ok"] for r in inv.pages(p, "clusters").collect()}
    assert pg == {1: True, 2: False}
    rows = inv.clusters(p).collect()
    assert [(r["workspace_id"], r["cluster_id"]) for r in rows] == [(1, "a")]
    # non-object members still count toward the list size
    assert inv.list_count(p, "clusters", "clusters", "n").collect()[0]["n"] == 3


def test_alternate_keys(spark):
    p = payloads(spark, [
        (1, inv.ENDPOINTS["pipelines"], 0, json.dumps({"statuses": [], "pipelines": [{"pipeline_id": "p1"}]})),
        (2, inv.ENDPOINTS["tokens"], 0, json.dumps({"tokens": [{"id": f"t{i}"} for i in range(12)]})),
        (3, inv.ENDPOINTS["service_principals"], 0, json.dumps({"Resources": [{"displayName": "x"}]})),
        (4, inv.ENDPOINTS["current_user"], 0, json.dumps({"display_name": "ann", "group_names": ["g"]})),
        (5, inv.ENDPOINTS["catalogs"], 0, json.dumps({"catalogs": [{"name": "c", "properties": {"isolation_mode": "OPEN"},
                                                                   "owner_id": "o"}]})),
    ])
    assert [r["pipeline_id"] for r in inv.pipelines(p).collect()] == ["p1"]
    t = inv.tokens(p).collect()[0]
    assert t["token_count"] == 12 and t["token_ids"] == [f"t{i}" for i in range(10)]
    assert inv.scim_counts(p, "service_principals", "n").collect()[0]["n"] == 1
    sp = inv.service_principals(p).collect()[0]
    assert sp["active"] is True
    ident = inv.identity(p).collect()[0]
    assert ident["user"] == "ann" and ident["groups"] == ["g"]
    c = inv.catalogs(p).collect()[0]
    assert (c["isolation_mode"], c["owner"]) == ("OPEN", "o")


def test_auth_text(spark):
    df = spark.createDataFrame([(1, "Host: x\nUser: ann@example.com\nOther"), (2, "no user")],
                               "workspace_id long, output string")
    got = {r["workspace_id"]: r["user"] for r in inv.auth_user(df).collect()}
    assert got == {1: "ann@example.com", 2: None}


def test_landing_pages_are_bounded(spark):
    p = land(spark, SF001, ["jobs"])
    per_page = inv.pages(p, "jobs").select(F.size("doc.jobs").alias("n")).agg(F.max("n")).collect()[0][0]
    assert per_page <= 200


def test_stream_rescoring_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="fg-stream-")
    land(spark, SF001).write.parquet(f"{base}/payloads")
    fx = Fixtures(spark, SF001)
    q = start_rescoring(spark, f"{base}/payloads", fx.workspaces, deep_tables(spark, SF001), FIXTURE_CONFIG,
                        f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out").select("workspace_id", "rule_id", "score", "verified")
    exp = assess(inventory(spark, SF001), deep_tables(spark, SF001), FIXTURE_CONFIG, materialize=False).scores
    exp = exp.select("workspace_id", "rule_id", "score", "verified")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_score_sheet_csv_and_call_log_append(spark):
    import os

    from fleetgrade.plans.registered import assessed, call_log
    from fleetgrade.plans import reports
    from fleetgrade.sources import store
    base = tempfile.mkdtemp(prefix="fg-sink-")
    a = assessed(spark, SF001)
    sheet = reports.score_sheet(spark, a.scores, a.inputs)
    store.write_score_sheet(sheet, f"{base}/sheet")
    parts = sorted(d for d in os.listdir(f"{base}/sheet") if d.startswith("workspace_id="))
    assert len(parts) == a.inputs.count()
    back = spark.read.option("header", True).csv(f"{base}/sheet")
    assert back.count() == sheet.count()
    calls = call_log(spark, SF001)
    store.append_calls(calls, f"{base}/calls", sql_calls=True)
    store.append_calls(calls, f"{base}/calls", sql_calls=True)
    assert spark.read.parquet(f"{base}/calls").count() == 2 * calls.count()


def test_readme_usage_flow(spark):
    """The README's fleet flow: tables by name, landed payloads, assess, snapshot, plan."""
    from fleetgrade.plans import remediation
    from fleetgrade.plans.registered import deep_tables
    from fleetgrade.sources import store
    from fleetgrade.sources.availability import operational_tables
    for name, df in deep_tables(spark, SF001).items():
        df.createOrReplaceTempView(f"fg_sys_{name}")
    ops = operational_tables(spark, {k: f"fg_sys_{k}" for k in
                                     ("usage", "cluster_timeline", "job_runs", "query_history", "audit")})
    base = tempfile.mkdtemp(prefix="fg-usage-")
    land(spark, SF001).write.parquet(f"{base}/payloads")
    payloads = spark.read.parquet(f"{base}/payloads")
    workspaces = Fixtures(spark, SF001).workspaces.select("workspace_id", "host")
    a = assess(inv.inventory_tables(payloads, workspaces), ops, FIXTURE_CONFIG)
    store.write_snapshot({"inputs": a.inputs, "scores": a.scores, "assessment": a.assessment},
                         f"{base}/snap", FIXTURE_CONFIG.as_of)
    back = store.read_snapshot(spark, f"{base}/snap", "assessment", FIXTURE_CONFIG.as_of)
    assert back.count() == 10
    plan = remediation.remediation_plan(a.scores, remediation.remediation_match(spark))
    assert plan.count() > 0


def test_small_list_normalizers(spark):
    p = payloads(spark, [
        (1, inv.ENDPOINTS["endpoints"], 0, json.dumps({"endpoints": [{"name": "e1", "state": {"ready": "READY"}}, 7]})),
        (1, inv.ENDPOINTS["init_scripts"], 0, json.dumps({"scripts": [{"name": "s", "enabled": False, "script_id": "i"}]})),
        (1, inv.ENDPOINTS["pools"], 0, json.dumps({"instance_pools": [{"name": "p", "node_type_id": "n"}]})),
        (1, inv.ENDPOINTS["ip_access_lists"], 0, json.dumps({"ip_access_lists": [{"label": "l", "list_type": "ALLOW",
                                                                                 "enabled": True}]})),
        (1, inv.ENDPOINTS["groups"], 0, json.dumps({"groups": ["a", "b"]})),
    ])
    assert [(r["name"], r["state"]) for r in inv.serving_endpoints(p).collect()] == [("e1", "READY")]
    assert inv.list_count(p, "endpoints", "endpoints", "n").collect()[0]["n"] == 2
    assert [(r["name"], r["enabled"]) for r in inv.init_scripts(p).collect()] == [("s", False)]
    assert [r["name"] for r in inv.instance_pools(p).collect()] == ["p"]
    assert [r["list_type"] for r in inv.ip_access_lists(p).collect()] == ["ALLOW"]
    assert inv.list_count(p, "groups", ["group_names", "groups"], "n").collect()[0]["n"] == 2


def test_stream_restart_does_not_duplicate(spark):
    """A restarted stream resumes from its checkpoint; each epoch's output is written once."""
    base = tempfile.mkdtemp(prefix="fg-restart-")
    land(spark, SF001, ["clusters", "metastore"]).write.parquet(f"{base}/payloads")
    fx = Fixtures(spark, SF001)
    for _ in range(2):
        q = start_rescoring(spark, f"{base}/payloads", fx.workspaces, None, FIXTURE_CONFIG,
                            f"{base}/out", f"{base}/ckpt")
        q.awaitTermination(300)
    out = spark.read.parquet(f"{base}/out")
    assert out.select("epoch").distinct().count() == 1
    assert out.count() == out.select("workspace_id", "rule_id").distinct().count()
