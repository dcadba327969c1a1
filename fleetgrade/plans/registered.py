"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each reads the fixture views over the whole test tables and applies the product
operator with the fixture calendar. Presentation-only steps (casts, rounding of
floating results whose last bits depend on summation order) happen here, not in
the operators.

Like a production run, the scoring keys share one materialised assessment per
Spark application and input directory (``assessed``: inputs and scores written
once to the checkpoint folder), and the ingest keys share one landed payload
table (``landed``); the first key that needs them pays for building them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.config import FIXTURE_CONFIG as CFG
from fleetgrade.operators import audit, billing, compute, jobs, queries
from fleetgrade.sources.fixtures import Fixtures

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DAYS = CFG.lookback_days


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _asof(src: str):
    return CFG.as_of_for(src)


# --- deep metrics: billing -------------------------------------------------------------

@register("spend_by_sku")
def _spend_by_sku(spark, sf):
    u = Fixtures(spark, sf).usage
    return billing.spend_by_sku_fleet(u, _asof("usage"), DAYS)


@register("spend_by_sku_ws")
def _spend_by_sku_ws(spark, sf):
    u = Fixtures(spark, sf).usage
    return billing.spend_by_sku(u, _asof("usage"), DAYS)


@register("total_dbus")
def _total_dbus(spark, sf):
    return billing.total_dbus(Fixtures(spark, sf).usage, _asof("usage"), DAYS)


@register("daily_spend")
def _daily_spend(spark, sf):
    return billing.daily_spend(Fixtures(spark, sf).usage, _asof("usage"), DAYS)


@register("spend_trend")
def _spend_trend(spark, sf):
    return billing.spend_trend(Fixtures(spark, sf).usage, _asof("usage"), DAYS)


@register("top_cost_clusters")
def _top_cost_clusters(spark, sf):
    return billing.top_cost_clusters(Fixtures(spark, sf).usage, _asof("usage"), DAYS)


# --- deep metrics: compute --------------------------------------------------------------

@register("cluster_uptime")
def _cluster_uptime(spark, sf):
    return compute.cluster_uptime(Fixtures(spark, sf).cluster_timeline, _asof("cluster_timeline"), DAYS)


@register("running_hours_total")
def _running_hours_total(spark, sf):
    return compute.running_hours_total(Fixtures(spark, sf).cluster_timeline, _asof("cluster_timeline"), DAYS)


@register("idle_clusters")
def _idle_clusters(spark, sf):
    fx = Fixtures(spark, sf)
    return compute.idle_clusters(fx.cluster_timeline, fx.job_runs, _asof("cluster_timeline"), DAYS)


@register("idle_hours_total")
def _idle_hours_total(spark, sf):
    fx = Fixtures(spark, sf)
    return compute.idle_hours_total(fx.cluster_timeline, fx.job_runs, _asof("cluster_timeline"), DAYS)


# --- deep metrics: query history ------------------------------------------------------------

@register("query_stats")
def _query_stats(spark, sf):
    st = queries.query_stats(Fixtures(spark, sf).query_history, _asof("query_history"), DAYS)
    # Interpolated percentiles differ between engines in the last bits.
    return st.withColumn("p95_duration_ms", F.round("p95_duration_ms", 2)).withColumn(
        "p99_duration_ms", F.round("p99_duration_ms", 2))


@register("query_failure_rate")
def _query_failure_rate(spark, sf):
    st = queries.query_stats(Fixtures(spark, sf).query_history, _asof("query_history"), DAYS)
    return queries.query_failure_rate(st)


@register("slow_queries")
def _slow_queries(spark, sf):
    st = queries.query_stats(Fixtures(spark, sf).query_history, _asof("query_history"), DAYS)
    return queries.slow_queries(st)


@register("warehouse_utilization")
def _warehouse_utilization(spark, sf):
    return queries.warehouse_utilization(Fixtures(spark, sf).query_history, _asof("query_history"), DAYS)


# --- deep metrics: job runs ---------------------------------------------------------------------

@register("job_run_stats")
def _job_run_stats(spark, sf):
    return jobs.job_run_stats(Fixtures(spark, sf).job_runs, _asof("job_runs"), DAYS)


@register("job_success_rate")
def _job_success_rate(spark, sf):
    return jobs.job_success_rate(jobs.job_run_stats(Fixtures(spark, sf).job_runs, _asof("job_runs"), DAYS))


@register("top_failing_jobs")
def _top_failing_jobs(spark, sf):
    return jobs.top_failing_jobs(Fixtures(spark, sf).job_runs, _asof("job_runs"), DAYS)


@register("top_failing_jobs_365d")
def _top_failing_jobs_365(spark, sf):
    return jobs.top_failing_jobs(Fixtures(spark, sf).job_runs, _asof("job_runs"), 365)


# --- deep metrics: audit --------------------------------------------------------------------------

@register("audit_by_action")
def _audit_by_action(spark, sf):
    return audit.audit_by_action(Fixtures(spark, sf).audit, _asof("audit"), DAYS)


@register("audit_total")
def _audit_total(spark, sf):
    return audit.audit_total(Fixtures(spark, sf).audit, _asof("audit"), DAYS)


@register("failed_logins")
def _failed_logins(spark, sf):
    return audit.failed_logins(Fixtures(spark, sf).audit, _asof("audit"), DAYS)


@register("permission_changes")
def _permission_changes(spark, sf):
    return audit.permission_changes(Fixtures(spark, sf).audit, _asof("audit"), DAYS)


@register("audit_summary_14d")
def _audit_summary_14(spark, sf):
    return audit.audit_summary(Fixtures(spark, sf).audit, _asof("audit"), 14)


# --- workspace features -------------------------------------------------------------------

from fleetgrade.operators import features  # noqa: E402

INVENTORY = ("workspaces", "clusters", "warehouses", "jobs", "pipelines", "catalogs",
             "scim_groups", "service_principals", "settings", "object_counts")


def inventory(spark, sf) -> dict[str, DataFrame]:
    fx = Fixtures(spark, sf)
    return {name: fx.table(name) for name in INVENTORY}


@register("cloud_of_host")
def _cloud_of_host(spark, sf):
    w = Fixtures(spark, sf).workspaces
    return w.select("workspace_id", "host", features.cloud_of_host(F.col("host")).alias("cloud"))


@register("best_warehouse")
def _best_warehouse(spark, sf):
    return features.best_warehouse(Fixtures(spark, sf).warehouses)


@register("features_clusters")
def _features_clusters(spark, sf):
    return features.features_clusters(Fixtures(spark, sf).clusters)


@register("features_warehouses")
def _features_warehouses(spark, sf):
    return features.features_warehouses(Fixtures(spark, sf).warehouses)


@register("features_jobs")
def _features_jobs(spark, sf):
    fx = Fixtures(spark, sf)
    return features.features_jobs(fx.jobs, fx.service_principals)


@register("features_pipelines")
def _features_pipelines(spark, sf):
    return features.features_pipelines(Fixtures(spark, sf).pipelines)


@register("features_catalogs")
def _features_catalogs(spark, sf):
    return features.features_catalogs(Fixtures(spark, sf).catalogs)


@register("features_scim")
def _features_scim(spark, sf):
    fx = Fixtures(spark, sf)
    return features.features_scim(fx.scim_groups).join(
        features.features_service_principals(fx.service_principals), on="workspace_id", how="full")


@register("features_settings")
def _features_settings(spark, sf):
    return features.features_settings(Fixtures(spark, sf).settings)


@register("features_counts")
def _features_counts(spark, sf):
    return features.features_counts(Fixtures(spark, sf).object_counts)


@register("workspace_features")
def _workspace_features(spark, sf):
    return features.workspace_features(inventory(spark, sf))


# --- scoring and roll-ups -------------------------------------------------------------------

from fleetgrade.operators import deep  # noqa: E402
from fleetgrade.plans import scoring  # noqa: E402
from fleetgrade.plans.catalog import PILLARS  # noqa: E402

DEEP = ("usage", "cluster_timeline", "job_runs", "query_history", "audit")


def deep_tables(spark, sf) -> dict[str, DataFrame]:
    fx = Fixtures(spark, sf)
    return {name: fx.table(name) for name in DEEP}


def assessed(spark, sf):
    """The materialised assessment of the fixture fleet (inputs and scores checkpointed)."""
    from fleetgrade.plans.assess import assess, assess_once
    return assess_once(spark, sf, lambda: assess(inventory(spark, sf), deep_tables(spark, sf), CFG), CFG)


@register("deep_metrics")
def _deep_metrics(spark, sf):
    out = deep.deep_metrics(deep_tables(spark, sf), CFG, materialize=True)
    return out.withColumn("p95_duration_ms", F.round("p95_duration_ms", 2)).drop(
        "running_hours_raw", "idle_hours_raw")


def _pillar_rules(prefix: str):
    def q(spark, sf):
        sc = assessed(spark, sf).scores
        return (sc.where(F.col("rule_id").startswith(prefix + "-"))
                .select("workspace_id", "rule_id", "score", "verified"))
    return q


for _p in PILLARS:
    REGISTRY[f"rules_{_p[0]}"] = _pillar_rules(_p[0])


@register("deep_findings")
def _deep_findings(spark, sf):
    """The deep rules with the evidence in their notes: names, hours, shares and P95."""
    from fleetgrade.plans.oracles_scoring import DEEP_NOTES
    return assessed(spark, sf).scores.where(F.col("rule_id").isin(*DEEP_NOTES)).select(
        "workspace_id", "rule_id", "score", "verified", "finding_notes")


@register("pillar_scores")
def _pillar_scores(spark, sf):
    return assessed(spark, sf).pillar_scores


@register("assessment")
def _assessment(spark, sf):
    return assessed(spark, sf).assessment


# --- report tables -------------------------------------------------------------------------------

from fleetgrade.plans import remediation, reports  # noqa: E402


def _scores(spark, sf):
    return assessed(spark, sf).scores


def _inputs(spark, sf):
    return assessed(spark, sf).inputs


@register("maturity")
def _maturity(spark, sf):
    return assessed(spark, sf).assessment.select("workspace_id", "maturity")


@register("pillar_summary")
def _pillar_summary(spark, sf):
    a = assessed(spark, sf)
    return reports.pillar_summary(spark, a.pillar_scores, a.assessment)


@register("verified_summary")
def _verified_summary(spark, sf):
    return reports.verified_summary(spark, assessed(spark, sf).pillar_scores)


@register("pillar_stats")
def _pillar_stats(spark, sf):
    a = assessed(spark, sf)
    # The TOTAL row averages seven means; compare at 9 decimals (summation order).
    return reports.pillar_stats(spark, a.scores, a.pillar_scores).withColumn("avg_score", F.round("avg_score", 9))


@register("recommendations")
def _recommendations(spark, sf):
    return reports.recommendations(_scores(spark, sf)).drop("finding_notes")


@register("critical_findings")
def _critical_findings(spark, sf):
    return reports.critical_findings(_scores(spark, sf)).drop("finding_notes")


@register("roadmap")
def _roadmap(spark, sf):
    r = reports.roadmap(_scores(spark, sf))
    # Zero-score actions embed the note text; compare the rest.
    return r.withColumn("action", F.when(F.col("score") == 0, F.lit(None).cast("string")).otherwise(F.col("action")))


@register("unverified_rules")
def _unverified_rules(spark, sf):
    return reports.unverified_rules(_scores(spark, sf)).drop("finding_notes")


@register("top_findings")
def _top_findings(spark, sf):
    return reports.top_findings(_scores(spark, sf)).drop("finding")


@register("pillar_highlights")
def _pillar_highlights(spark, sf):
    return reports.pillar_highlights(_scores(spark, sf)).drop("text")


@register("inventory_summary")
def _inventory_summary(spark, sf):
    return reports.inventory_summary(_inputs(spark, sf))


@register("inventory_health")
def _inventory_health(spark, sf):
    return reports.inventory_health(_inputs(spark, sf))


@register("setting_advice")
def _setting_advice(spark, sf):
    return reports.setting_advice(_inputs(spark, sf))


@register("current_state")
def _current_state(spark, sf):
    return reports.current_state(_inputs(spark, sf))


@register("next_steps")
def _next_steps(spark, sf):
    return reports.next_steps(_inputs(spark, sf))


@register("score_sheet")
def _score_sheet(spark, sf):
    return reports.score_sheet(spark, _scores(spark, sf), _inputs(spark, sf)).drop("Finding/Notes")


@register("issue_counts")
def _issue_counts(spark, sf):
    return reports.issue_counts(_scores(spark, sf))


@register("rule_status")
def _rule_status(spark, sf):
    return reports.rule_status(_scores(spark, sf))


@register("evidence_map")
def _evidence_map(spark, sf):
    return reports.evidence_map(_scores(spark, sf)).drop("finding_notes")


@register("score_bands")
def _score_bands(spark, sf):
    a = assessed(spark, sf)
    return reports.score_bands(reports.pillar_summary(spark, a.pillar_scores, a.assessment))


@register("remediation_match")
def _remediation_match(spark, sf):
    # Static rule -> topic map, applied to every workspace's scores.
    m = remediation.remediation_match(spark)
    return _scores(spark, sf).select("workspace_id", "rule_id").join(F.broadcast(m), on="rule_id", how="left")


@register("remediation_plan")
def _remediation_plan(spark, sf):
    return remediation.remediation_plan(_scores(spark, sf), remediation.remediation_match(spark))


@register("remediation_docs")
def _remediation_docs(spark, sf):
    plan = remediation.remediation_plan(_scores(spark, sf), remediation.remediation_match(spark))
    return remediation.remediation_docs(plan, _inputs(spark, sf), remediation.remediation_kb(spark))


def call_log(spark, sf) -> DataFrame:
    """The call log in product form (``command`` as an array of words)."""
    c = Fixtures(spark, sf).call_log
    return c.withColumn("command", F.split("command_text", " ")).drop("command_text")


@register("call_summary")
def _call_summary(spark, sf):
    # Float sums depend on summation order; compare at 6 decimals.
    return reports.call_summary(call_log(spark, sf)).withColumn("total_seconds", F.round("total_seconds", 6))


@register("call_entries")
def _call_entries(spark, sf):
    return reports.call_entries(call_log(spark, sf))


# --- ingest: landed API payloads -> inventory tables -> features -----------------------------------

from fleetgrade.sources import inventory as inv  # noqa: E402
from fleetgrade.sources.landing import landed  # noqa: E402


@register("ingest_clusters")
def _ingest_clusters(spark, sf):
    return features.features_clusters(inv.clusters(landed(spark, sf)))


@register("ingest_warehouses")
def _ingest_warehouses(spark, sf):
    return features.features_warehouses(inv.warehouses(landed(spark, sf)))


@register("ingest_jobs")
def _ingest_jobs(spark, sf):
    p = landed(spark, sf)
    return features.features_jobs(inv.jobs(p), inv.service_principals(p))


@register("ingest_pipelines")
def _ingest_pipelines(spark, sf):
    return features.features_pipelines(inv.pipelines(landed(spark, sf)))


@register("ingest_catalogs")
def _ingest_catalogs(spark, sf):
    return features.features_catalogs(inv.catalogs(landed(spark, sf)))


@register("ingest_scim")
def _ingest_scim(spark, sf):
    p = landed(spark, sf)
    groups = features.features_scim(inv.scim_groups(p)).drop("scim_count").join(
        inv.scim_counts(p, "scim_groups", "scim_count"), on="workspace_id", how="full")
    return groups.join(inv.scim_counts(p, "service_principals", "sp_count"), on="workspace_id", how="full")


@register("ingest_settings")
def _ingest_settings(spark, sf):
    return features.features_settings(inv.settings(landed(spark, sf)))


@register("ingest_counts")
def _ingest_counts(spark, sf):
    return features.features_counts(inv.object_counts(landed(spark, sf)))


@register("ingest_workspace_objects")
def _ingest_workspace_objects(spark, sf):
    return inv.workspace_object_summary(inv.workspace_objects(landed(spark, sf)))


@register("ingest_workspace_features")
def _ingest_workspace_features(spark, sf):
    p = landed(spark, sf)
    return features.workspace_features(inv.inventory_tables(p, Fixtures(spark, sf).workspaces))


# --- sinks and cache round trips ------------------------------------------------------------------

from fleetgrade.sources import store  # noqa: E402


def _snapshot_root(spark) -> str:
    from fleetgrade.session import ensure_checkpoint_dir
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetgrade/snapshots-{uuid.uuid4().hex}"


@register("rescore_from_cache")
def _rescore_from_cache(spark, sf):
    """S6 + S7: write the assessment inputs as a dated snapshot, read that date back, re-score."""
    a = assessed(spark, sf)
    root = _snapshot_root(spark)
    store.write_snapshot({"inputs": a.inputs}, root, CFG.as_of)
    back = store.read_snapshot(spark, root, "inputs", CFG.as_of)
    return scoring.assessment(scoring.score_rules(back, as_of=CFG.as_of), back)


@register("rescore_from_notes")
def _rescore_from_notes(spark, sf):
    """S7 with a foreign score cache: the verified flag is re-derived from the note text."""
    a = assessed(spark, sf)
    root = _snapshot_root(spark)
    store.write_snapshot({"scores": a.scores.drop("verified")}, root, CFG.as_of)
    back = scoring.reflag_verified(store.read_snapshot(spark, root, "scores", CFG.as_of)
                                   .withColumn("as_of", F.lit(CFG.as_of)))
    return scoring.assessment(back, a.inputs)


@register("call_log_flat")
def _call_log_flat(spark, sf):
    """S8 + S9: flattened call log; only the output of SQL calls is cut to 2000 characters."""
    return store.cut_sql_output(store.flatten_calls(call_log(spark, sf)))


@register("collector_runs")
def _collector_runs(spark, sf):
    # Float sums depend on summation order; compare at 6 decimals.
    return reports.collector_runs(call_log(spark, sf)).withColumn("seconds", F.round("seconds", 6))


# Queries over landed runs, caches and committed calls register themselves.
from fleetgrade.plans import registered_runs  # noqa: E402,F401
