"""Branch tests: one hand-built input row per branch, scored through the engine."""

import pytest
from pyspark.sql import functions as F

from fleetgrade.plans.catalog import RULE_IDS, rules
from fleetgrade.plans.rules import check_complete
from fleetgrade.plans.scoring import UNVERIFIABLE_PHRASES, reflag_verified, score_rules

# Neutral input: a scanned workspace with nothing in it.
BASE = dict(
    workspace_id=1, host="https://a.cloud.databricks.com", cloud="aws", metastore_name=None,
    metastore_owner=None, delta_sharing_scope=None, has_metastore=False,
    cluster_count=0, running_clusters=0, photon_clusters=0, autoscale_clusters=0, total_workers=0,
    max_workers=0, node_type_count=0, node_type_sample=None, running_no_autoterm=0, autoterm_clusters=0,
    tagged_clusters=0, versioned_clusters=0, recent_runtime_clusters=0, gpu_clusters=0, spot_clusters=0,
    standard_mode_clusters=0, dedicated_mode_clusters=0, none_mode_clusters=0, efficient_aws=0,
    efficient_azure=0, efficient_gcp=0, warehouse_count=0, pro_or_serverless_wh=0, multi_or_serverless_wh=0,
    multi_cluster_wh=0, photon_wh=0, autostop_wh=0, running_wh=0, job_count=0, git_jobs=0, retry_jobs=0,
    job_cluster_jobs=0, dab_jobs=0, iac_jobs=0, sp_owned_jobs=0, pipeline_count=0, failed_pipelines=0,
    connect_pipelines=0, autoscale_pipelines=0, catalog_count=0, has_open_catalog=False, scim_count=0,
    idp_synced=0, sp_count=0, has_settings=False, dbfs_off=False, ipl_on=False,
    policy_count=0, pool_count=0, endpoint_count=0, repo_count=0, init_script_count=0, group_count=0,
    scope_count=0, ip_access_list_count=0, token_count=0, external_location_count=0,
    storage_credential_count=0, workspace_object_count=0,
    total_dbus_30d=None, trend_pct_change=None, top_cluster_dbus=None, total_running_hours_30d=None,
    uptime_rows=None, max_running_hours=None, idle_hours_30d=None, idle_rows=None, total_queries=None,
    failure_rate_pct=None, slow_query_count=None, wh_rows=None, wh_top_count=None, total_runs=None,
    success_rate_pct=None, failing_jobs=None, chronic_jobs=None, failed_logins=None, permission_changes=None,
    billing_available=False, compute_available=False, query_available=False, jobs_available=False,
    audit_available=False,
)
DOUBLES = {"trend_pct_change", "top_cluster_dbus", "total_dbus_30d", "total_running_hours_30d",
           "max_running_hours", "idle_hours_30d", "failure_rate_pct", "success_rate_pct"}


def score(spark, rid, **overrides):
    row = {**BASE, **overrides}
    fields = []
    for k, v in row.items():
        if k in DOUBLES:
            t = "double"
        elif isinstance(v, bool) or k.endswith("_available") or k in ("has_metastore", "has_open_catalog",
                                                                     "has_settings", "dbfs_off", "ipl_on"):
            t = "boolean"
        elif isinstance(v, str) or k in ("metastore_name", "metastore_owner", "delta_sharing_scope",
                                          "node_type_sample", "host", "cloud"):
            t = "string"
        else:
            t = "bigint"
        fields.append(f"{k} {t}")
    df = spark.createDataFrame([tuple(row.values())], ", ".join(fields))
    r = score_rules(df, rule_ids=[rid]).collect()[0]
    return r["score"], r["verified"]


def test_catalog_complete():
    assert len(RULE_IDS) == 140
    assert check_complete() == []
    per = {}
    for r in rules():
        per[r[3]] = per.get(r[3], 0) + 1
    assert per == {"Data & AI Governance": 15, "Interoperability & Usability": 15,
                   "Operational Excellence": 24, "Security": 14, "Reliability": 21,
                   "Performance": 28, "Cost": 23}


@pytest.mark.parametrize("rid,overrides,expected", [
    ("gov-001", {}, (0, True)),
    ("gov-001", dict(has_metastore=True, metastore_name="m"), (1, True)),
    ("gov-001", dict(has_metastore=True, metastore_name="m", catalog_count=5), (2, True)),
    ("gov-001", dict(has_metastore=True, metastore_name="m", catalog_count=101), (1, True)),
    ("gov-007", dict(metastore_owner="Account Users"), (0, True)),
    ("gov-007", dict(metastore_owner="admins"), (2, True)),
    ("gov-007", dict(has_open_catalog=True), (1, True)),
    ("gov-012", dict(metastore_name="m", catalog_count=1), (1, False)),
    ("gov-014", dict(catalog_count=4, external_location_count=0), (2, True)),
    ("gov-014", dict(catalog_count=4, external_location_count=3), (0, True)),
    ("gov-014", dict(catalog_count=4, external_location_count=2), (1, True)),
    ("int-004", dict(pipeline_count=3, failed_pipelines=1), (1, True)),
    ("int-004", dict(pipeline_count=3), (2, True)),
    ("int-011", dict(policy_count=21), (1, True)),
    ("int-011", dict(policy_count=2), (2, True)),
    ("ops-007", dict(iac_jobs=2), (1, True)),
    ("ops-023", dict(running_no_autoterm=1, running_clusters=1), (0, True)),
    ("ops-023", dict(running_clusters=2), (1, True)),
    ("ops-023", {}, (2, True)),
    ("ops-024", {}, (1, False)),
    ("ops-024", dict(compute_available=True, uptime_rows=2, max_running_hours=600.0,
                     total_running_hours_30d=700.0), (0, True)),
    ("ops-024", dict(compute_available=True, uptime_rows=2, max_running_hours=300.0,
                     total_running_hours_30d=500.0), (1, True)),
    ("ops-024", dict(compute_available=True, uptime_rows=2, max_running_hours=30.0,
                     total_running_hours_30d=50.0), (2, True)),
    ("sec-002", dict(cloud="unknown"), (1, False)),
    ("sec-002", dict(cloud="gcp"), (1, True)),
    ("sec-005", dict(dbfs_off=True, ipl_on=True, has_settings=True), (2, True)),
    ("sec-005", dict(has_settings=True), (1, True)),
    ("sec-005", {}, (1, False)),
    ("sec-012", dict(has_settings=True), (0, True)),
    ("sec-013", dict(audit_available=True, failed_logins=51), (0, True)),
    ("sec-013", dict(audit_available=True, failed_logins=11), (1, True)),
    ("sec-013", dict(audit_available=True, failed_logins=10), (2, True)),
    ("rel-019", dict(sp_count=2, sp_owned_jobs=1, job_count=3), (2, True)),
    ("rel-019", dict(sp_count=2, job_count=3), (1, True)),
    ("rel-019", dict(job_count=3), (0, True)),
    ("rel-019", {}, (1, True)),
    ("rel-020", dict(jobs_available=True, total_runs=100, success_rate_pct=89.99), (0, True)),
    ("rel-020", dict(jobs_available=True, total_runs=100, success_rate_pct=97.0), (1, True)),
    ("rel-020", dict(jobs_available=True, total_runs=100, success_rate_pct=98.0), (2, True)),
    ("rel-021", dict(jobs_available=True, failing_jobs=0), (2, True)),
    ("rel-021", dict(jobs_available=True, failing_jobs=5, chronic_jobs=3), (0, True)),
    ("rel-021", dict(jobs_available=True, failing_jobs=5, chronic_jobs=1), (1, True)),
    ("perf-024", dict(cluster_count=3, efficient_aws=1), (2, True)),
    ("perf-024", dict(cluster_count=3, efficient_azure=1), (0, True)),
    ("perf-025", dict(cluster_count=3, standard_mode_clusters=3), (2, True)),
    ("perf-025", dict(cluster_count=3, standard_mode_clusters=1, none_mode_clusters=2), (1, True)),
    ("perf-025", dict(cluster_count=3, none_mode_clusters=3), (0, True)),
    ("perf-025", dict(cluster_count=3, dedicated_mode_clusters=3), (1, True)),
    ("perf-027", dict(query_available=True, total_queries=100, slow_query_count=6), (0, True)),
    ("perf-027", dict(query_available=True, total_queries=100, slow_query_count=2), (1, True)),
    ("perf-027", dict(query_available=True, total_queries=100, slow_query_count=1), (2, True)),
    ("perf-028", dict(query_available=True, total_queries=100, wh_rows=1, wh_top_count=100), (1, True)),
    ("perf-028", dict(query_available=True, total_queries=100, wh_rows=3, wh_top_count=50), (2, True)),
    ("cost-021", dict(compute_available=True, idle_rows=0), (2, True)),
    ("cost-021", dict(compute_available=True, idle_rows=3, idle_hours_30d=101.0), (0, True)),
    ("cost-022", dict(billing_available=True), (1, True)),
    ("cost-022", dict(billing_available=True, trend_pct_change=20.5), (0, True)),
    ("cost-022", dict(billing_available=True, trend_pct_change=5.0), (2, True)),
    ("cost-023", dict(billing_available=True, total_dbus_30d=100.0, top_cluster_dbus=51.0), (0, True)),
    ("cost-023", dict(billing_available=True, total_dbus_30d=100.0, top_cluster_dbus=31.0), (1, True)),
    ("cost-023", dict(billing_available=True, total_dbus_30d=100.0, top_cluster_dbus=30.0), (2, True)),
    ("perf-014", {}, (1, True)),
    # Q7: readable table, no rows for the workspace -> verified "no history" branches
    ("perf-026", dict(query_available=True), (1, True)),
    ("perf-028", dict(query_available=True), (1, True)),
    ("rel-020", dict(jobs_available=True), (1, True)),
    ("rel-021", dict(jobs_available=True), (2, True)),
])
def test_branch(spark, rid, overrides, expected):
    assert score(spark, rid, **overrides) == expected


def test_notes_agree_with_verified_flag(spark):
    """Re-deriving E2 from the note text gives the branch flag for every rule."""
    df = spark.createDataFrame([tuple(BASE.values())], ", ".join(
        f"{k} {'double' if k in DOUBLES else ('boolean' if isinstance(v, bool) else ('string' if k in ('host','cloud','metastore_name','metastore_owner','delta_sharing_scope','node_type_sample') else 'bigint'))}"
        for k, v in BASE.items()))
    sc = score_rules(df)
    back = reflag_verified(sc.withColumnRenamed("verified", "v0"))
    bad = back.where(F.col("v0") != F.col("verified")).select("rule_id").collect()
    assert bad == []
    assert len(UNVERIFIABLE_PHRASES) == 11
