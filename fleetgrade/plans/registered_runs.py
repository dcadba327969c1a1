"""Registered queries over landed runs, caches and the call log (S2, S7, S8) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.config import FIXTURE_CONFIG as CFG
from fleetgrade.operators import billing, compute, deep, features, jobs, queries
from fleetgrade.plans import incremental, reports, rule_table, scoring
from fleetgrade.plans.catalog import rule_catalog, rules as catalog_rules
from fleetgrade.plans.oracles import ORACLES, oracle, oracles_scoring
from fleetgrade.plans.registered import _snapshot_root, assessed, call_log, deep_tables, inventory, register
from fleetgrade.session import cut_lineage
from fleetgrade.sources import inventory as inv
from fleetgrade.sources import json_cache, rolling, snapshots, store
from fleetgrade.sources.fixtures import Fixtures
from fleetgrade.sources.landing import landed
from fleetgrade.sources.testdata import load_raw

WS = "workspace_id"


# --- S2: pages that land more than once ------------------------------------------------------------

def relanded(spark, sf) -> DataFrame:
    """The fixture's pages as several runs: outdated, repeated, torn and late ones around the right one.

    Run 1 is complete and old, with half of the pages. Run 2 holds everything, with a third of
    its pages landed twice (the older copy empty). For every fifth workspace run 2 lacks a page
    and run 4 holds everything, its first pages landing last. Run 3 is torn everywhere.
    """
    base = landed(spark, sf).withColumn("page", F.dense_rank().over(_by_page()) - 1)
    base = base.withColumn("pages", F.max("page").over(_by_endpoint()) + 1)
    late = F.col(WS) % 5 == 0
    at = lambda run, when: (F.lit(run).cast("long").alias("landing"), F.lit(when).cast("long").alias("landed_at"))
    whole = [WS, "endpoint", "page", "body", "pages"]
    empty = F.lit("{}").alias("body")
    old = base.where("page = 0").select(WS, "endpoint", "page", empty, F.lit(1).alias("pages"), *at(1, 100))
    main = base.where(~late).select(*whole, *at(2, 200))
    again = base.where(~late & (F.pmod(F.xxhash64("endpoint", "page"), F.lit(3)) == 0)).select(
        WS, "endpoint", "page", empty, "pages", *at(2, 150))
    lacking = base.where(late).select(WS, "endpoint", "page", empty, (F.col("pages") + 1).alias("pages"), *at(2, 200))
    torn = base.where("page % 2 = 0").select(WS, "endpoint", "page", empty, (F.col("pages") + 1).alias("pages"), *at(3, 300))
    done = base.where(late).select(*whole, F.lit(4).cast("long").alias("landing"), (F.lit(900) - F.col("page")).cast("long").alias("landed_at"))
    out = old
    for part in (main, again, lacking, torn, done, done):      # the late run's files land twice, byte for byte
        out = out.unionByName(part)
    return out


def _by_endpoint():
    from pyspark.sql import Window

    return Window.partitionBy(WS, "endpoint")


def _by_page():
    return _by_endpoint().orderBy("page")


@register("ingest_relanded")
def _ingest_relanded(spark, sf):
    """Features from the newest complete runs of a landing table with repeated, torn and late runs."""
    pages = cut_lineage(snapshots.current_pages(cut_lineage(relanded(spark, sf), "landings")), "current-pages", ["endpoint"])
    return features.workspace_features(inv.inventory_tables(pages, Fixtures(spark, sf).workspaces))


@register("landing_report")
def _landing_report(spark, sf):
    """Which run each workspace's cluster pages come from."""
    rows = relanded(spark, sf).where(F.col("endpoint") == inv.ENDPOINTS["settings"])
    return snapshots.landing_report(rows.withColumn(WS, F.col(WS).cast("long")))


@register("ingest_member_counts")
def _ingest_member_counts(spark, sf):
    """List counts where lists hold members that are no objects and SCIM answers state a larger total."""
    pages = landed(spark, sf)
    first = F.col("page") == F.min("page").over(_by_endpoint())
    mixed = F.when(first, F.regexp_replace("body", r'^\{"(clusters|warehouses|jobs)":\[', '{"$1":["junk",7,')).otherwise(F.col("body"))
    total = F.regexp_replace(mixed, r'"totalResults":[0-9]+', F.concat(F.lit('"totalResults":'), (F.lit(90000) + F.col(WS)).cast("string")))
    counts = features.workspace_features(inv.inventory_tables(pages.withColumn("body", total), Fixtures(spark, sf).workspaces))
    return counts.select(WS, "cluster_count", "running_clusters", "warehouse_count", "job_count", "pipeline_count", "catalog_count",
                         "scim_count", "idp_synced", "sp_count")


# --- S7: cached JSON documents ---------------------------------------------------------------------------

def deep_lists(spark, sf) -> dict[str, DataFrame]:
    """The deep scan's result rows by the name of their field in a cached document."""
    t, d = deep_tables(spark, sf), CFG.lookback_days
    at = CFG.as_of_for
    return {
        "top_cost_clusters": billing.top_cost_clusters(t["usage"], at("usage"), d).drop("rank"),
        "cluster_uptime": compute.cluster_uptime(t["cluster_timeline"], at("cluster_timeline"), d).drop("rank"),
        "idle_clusters": compute.idle_clusters(t["cluster_timeline"], t["job_runs"], at("cluster_timeline"), d).drop("rank"),
        "warehouse_utilization": queries.warehouse_utilization(t["query_history"], at("query_history"), d).drop("rank"),
        "top_failing_jobs": jobs.top_failing_jobs(t["job_runs"], at("job_runs"), d).drop("rank"),
    }


def cached_documents(spark, sf) -> DataFrame:
    """The fixture fleet's assessment as cached documents, written as a table."""
    a = assessed(spark, sf)
    return cut_lineage(json_cache.documents(inventory(spark, sf), a.inputs, deep_lists(spark, sf), a.scores,
                                            store.flatten_calls(call_log(spark, sf)).withColumnRenamed("duration", "duration_seconds")), "documents", wide=True)


@register("rescore_from_json_cache")
def _rescore_from_json_cache(spark, sf):
    """Cached documents read back as inventory and deep rows, featured and scored again."""
    cache = json_cache.read(cached_documents(spark, sf), rule_catalog(spark))
    feats = cut_lineage(features.workspace_features(cache.inventory), "cache-features")
    inputs = cut_lineage(deep.assessment_input(feats, cache.deep), "cache-inputs")
    return scoring.assessment(scoring.score_rules(inputs, as_of=CFG.as_of), inputs)


@register("report_from_json_cache")
def _report_from_json_cache(spark, sf):
    """The scores of cached documents as they stand, rolled up for reports."""
    cache = json_cache.read(cached_documents(spark, sf), rule_catalog(spark))
    base = features.workspace_base(cache.inventory["workspaces"])
    return scoring.assessment(cut_lineage(cache.scores, "cache-scores"), base)


# --- S8: calls committed once ----------------------------------------------------------------------------

_CALL = "workspace_id long, seq long, collector string, command string, output string, duration_seconds double, success boolean, error string"


@register("call_log_committed")
def _call_log_committed(spark, sf):
    """A run whose upload is retried, a torn attempt and a run that goes on after one collector."""
    root = f"{_snapshot_root(spark)}-calls"
    calls = call_log(spark, sf).withColumn("command", F.concat_ws(" ", "command")).withColumn(WS, F.col(WS).cast("long"))
    odd, even = calls.where("seq % 2 = 1"), calls.where("seq % 2 = 0")
    odd.write.parquet(f"{root}/data/run=r1/attempt={uuid.uuid4().hex}")          # an attempt that failed before its commit
    store.commit_calls(odd, root, "r1")
    store.commit_calls(odd, root, "r1")
    store.commit_calls(even.where("collector <= 'collector_d'"), root, "r2")
    store.commit_calls(even, root, "r2")
    return store.read_calls(spark, root, _CALL).select(
        WS, "seq", "collector", "command", "output", F.col("duration_seconds").alias("duration"), "success", "error", "run")


# --- SQL --------------------------------------------------------------------------------------------------

ORACLES["ingest_relanded"] = ORACLES["ingest_workspace_features"]
ORACLES["rescore_from_json_cache"] = ORACLES["assessment"]
ORACLES["report_from_json_cache"] = ORACLES["assessment"]
_members = ORACLES["ingest_workspace_features"]
ORACLES["ingest_member_counts"] = f"""
select workspace_id, case when cluster_count > 0 then cluster_count + 2 else 0 end as cluster_count, running_clusters,
       case when warehouse_count > 0 then warehouse_count + 2 else 0 end as warehouse_count,
       case when job_count > 0 then job_count + 2 else 0 end as job_count, pipeline_count, catalog_count,
       case when scim_count > 0 then 90000 + workspace_id else 0 end as scim_count, idp_synced,
       case when sp_count > 0 then 90000 + workspace_id else 0 end as sp_count
from ({_members})"""
oracle("landing_report", ["settings"], f"""
select cast(workspace_id as bigint) as workspace_id, '{inv.ENDPOINTS["settings"]}' as endpoint,
       cast(case when workspace_id % 5 = 0 then 4 else 2 end as bigint) as landing_used,
       cast(case when workspace_id % 5 = 0 then 4 else 3 end as bigint) as landing_newest,
       cast(case when workspace_id % 5 = 0 then 4 else 3 end as bigint) as runs,
       cast(case when workspace_id % 5 = 0 then 2 else 1 end as bigint) as incomplete_runs,
       cast(case when workspace_id % 5 = 0 then 1 else 0 end as bigint) + repeated as repeated_pages,
       workspace_id % 5 <> 0 as stale
from (select distinct workspace_id from settings), (select 0 as repeated)""")
oracle("call_log_committed", ["call_log"], """
select cast(workspace_id as bigint) as workspace_id, seq, collector, command_text as command,
       case when contains(command_text, '/api/2.0/sql/statements') then substr(output, 1, 2000) else output end as output,
       duration_seconds as duration, success, error, case when seq % 2 = 1 then 'r1' else 'r2' end as run
from call_log""")


# --- S1: the window from daily partials -------------------------------------------------------------------

@register("deep_metrics_rolling")
def _deep_metrics_rolling(spark, sf):
    """Deep metrics merged from daily partials: a first fill of the window, then the last day run again."""
    root = f"{_snapshot_root(spark)}-days"
    tables = deep_tables(spark, sf)
    last = {name: CFG.as_of_for(name) for name in tables}
    rolling.update(tables, root, last, CFG.lookback_days)
    rolling.update(tables, root, last)
    stand_ins, shared = rolling.merged(spark, root, CFG)
    shared = {k: cut_lineage(v, k) for k, v in shared.items()}
    out = deep.deep_metrics(stand_ins, CFG, shared=shared)
    return out.withColumn("p95_duration_ms", F.round("p95_duration_ms", 2)).drop("running_hours_raw", "idle_hours_raw")


ORACLES["deep_metrics_rolling"] = ORACLES["deep_metrics"]


# --- S6: only changed workspaces are scored ---------------------------------------------------------------

@register("rescore_incremental")
def _rescore_incremental(spark, sf):
    """A stored run in which some workspaces looked otherwise, brought up to the present inputs."""
    a = assessed(spark, sf)
    before = a.inputs.withColumn("cluster_count", F.when(F.col(WS) % 50 == 7, F.lit(999)).otherwise(F.col("cluster_count"))).where(F.col(WS) != 3)
    before = incremental.with_digest(before)
    root = _snapshot_root(spark)
    store.write_snapshot({"inputs": before, "scores": scoring.score_rules(before.drop("digest", "version"))}, root, CFG.as_of)
    stored = {n: store.read_snapshot(spark, root, n, CFG.as_of) for n in ("inputs", "scores")}
    scores, _ = incremental.rescore(a.inputs, stored["inputs"], stored["scores"], CFG.as_of)
    return scoring.assessment(cut_lineage(scores, "scores"), a.inputs)


ORACLES["rescore_incremental"] = ORACLES["assessment"]


# --- E10: rules from a table -------------------------------------------------------------------------------

RULE_ROWS = (
    ("cost-024", 1, "warehouse_count = 0 and cluster_count = 0", 1, False, "Nothing to compare: requires compute.", False),
    ("cost-024", 2, "cluster_count > 4 * warehouse_count", 0, True, "{cluster_count} clusters beside {warehouse_count} warehouses.", True),
    ("cost-024", 3, "cluster_count > warehouse_count", 1, True, "More clusters ({cluster_count}) than warehouses.", False),
    ("cost-024", 4, None, 2, True, "Warehouses carry the load.", False),
    ("ops-023", 1, "coalesce(running_no_autoterm, 0) > 2", 0, True, "{running_no_autoterm} running clusters never stop.", False),
    ("ops-023", 2, None, 2, True, "Clusters stop by themselves.", False),
)


@register("rules_from_table")
def _rules_from_table(spark, sf):
    """One rule added and one replaced by a rule table, scored beside the built-in ones."""
    columns = "rule_id string, seq int, condition string, score int, verified boolean, note string, quick_fix boolean"
    table = spark.createDataFrame(list(RULE_ROWS), columns)
    new = F.col("rule_id") == "cost-024"
    table = table.select("*", F.when(new, "Balance clusters and warehouses").alias("name"), F.when(new, "Cost").alias("pillar"),
                         F.when(new, "Right-sizing").alias("principle"), F.when(new, 141).alias("ord"))
    scores = rule_table.score_with_table(assessed(spark, sf).inputs, table)
    return scores.where(F.col("rule_id").isin("cost-024", "ops-023", "ops-001")).select(
        WS, "ord", "rule_id", "pillar", "score", "verified", F.when(F.col("rule_id") != "ops-001", F.col("finding_notes")).alias("finding_notes"))


ORACLES["rules_from_table"] = oracles_scoring.rule_codes(["ops-001"], f"""
select workspace_id, ord, rule_id, pillar, score, verified, cast(null as varchar) as finding_notes from sc
union all
select workspace_id, 141, 'cost-024', 'Cost',
       case when warehouse_count = 0 and cluster_count = 0 then 1 when cluster_count > 4 * warehouse_count then 0
            when cluster_count > warehouse_count then 1 else 2 end,
       not (warehouse_count = 0 and cluster_count = 0),
       case when warehouse_count = 0 and cluster_count = 0 then 'Nothing to compare: requires compute.'
            when cluster_count > 4 * warehouse_count then cluster_count || ' clusters beside ' || warehouse_count || ' warehouses.'
            when cluster_count > warehouse_count then 'More clusters (' || cluster_count || ') than warehouses.'
            else 'Warehouses carry the load.' end from inp
union all
select workspace_id, {next(r[0] for r in catalog_rules() if r[1] == "ops-023")}, 'ops-023', 'Operational Excellence',
       case when running_no_autoterm > 2 then 0 else 2 end, true,
       case when running_no_autoterm > 2 then running_no_autoterm || ' running clusters never stop.' else 'Clusters stop by themselves.' end
from inp""")


# --- N7-N20: values in another form than the endpoint documents ----------------------------------------------

def drifted(spark, sf) -> DataFrame:
    """The fixture's pages with numbers and flags sent as text, and whole numbers with a fraction."""
    body = F.regexp_replace("body", r'"(num_workers|auto_termination_minutes|auto_stop_mins|max_num_clusters|job_id|first_on_demand)":([0-9]+)', '"$1":"$2"')
    body = F.regexp_replace(body, r'"(enable_photon|enable_serverless_compute|enabled)":(true|false)', '"$1":"$2"')
    body = F.regexp_replace(body, r'"(max_retries|max_workers)":([0-9]+)', '"$1":$2.0')
    return landed(spark, sf).withColumn("body", body)


@register("ingest_drift")
def _ingest_drift(spark, sf):
    return features.workspace_features(inv.inventory_tables(drifted(spark, sf), Fixtures(spark, sf).workspaces))


@register("ingest_rejects")
def _ingest_rejects(spark, sf):
    """Values no number can be read from, per workspace and field."""
    bad = F.regexp_replace("body", r'"num_workers":([567])', '"num_workers":"about $1"')
    rows = inv.rejected_fields(landed(spark, sf).withColumn("body", bad), "clusters", "clusters")
    return rows.groupBy(WS, "kind", "field").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("first_value"))


@register("catalog_facts")
def _catalog_facts(spark, sf):
    facts = inv.catalog_facts(landed(spark, sf))
    return facts.select(WS, "catalogs", F.array_join("isolation_modes", ",").alias("isolation_modes"), F.array_join("owners", ",").alias("owners"))


ORACLES["ingest_drift"] = ORACLES["ingest_workspace_features"]
oracle("ingest_rejects", ["clusters"], """
select cast(workspace_id as bigint) as workspace_id, 'clusters' as kind, 'num_workers' as field, count(*) as values,
       min('"about ' || num_workers || '"') as first_value
from clusters where num_workers in (5, 6, 7) group by workspace_id""")
oracle("catalog_facts", ["catalogs"], """
select cast(workspace_id as bigint) as workspace_id, count(*) as catalogs,
       array_to_string(list_sort(list(distinct isolation_mode)), ',') as isolation_modes,
       array_to_string(list_sort(list(distinct owner)), ',') as owners
from catalogs group by workspace_id""")


# --- N1, N2, N10, N12, N13, N18, N20 rows; S5 file --------------------------------------------------------------

def identity_payloads(spark, sf) -> DataFrame:
    """An identity answer per customer, in the forms that the endpoint uses."""
    c = load_raw(spark, sf, "customer")
    n = F.col("c_custkey")
    groups = F.when(n % 3 == 0, F.struct(F.col("c_name").alias("userName"), F.array(F.lit("admins"), F.col("c_mktsegment")).alias("groups")))
    scalar = F.struct(F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("group_names"), F.lit("viewer").alias("roles"))
    none = F.struct(F.lit("").alias("userName"), F.col("c_name").alias("user_name"), F.array().cast("array<string>").alias("roles"))
    body = F.when(n % 3 == 0, F.to_json(groups)).when(n % 3 == 1, F.to_json(scalar)).otherwise(F.to_json(none))
    return c.select(n.cast("long").alias(WS), F.lit(inv.ENDPOINTS["current_user"]).alias("endpoint"), F.lit(0).alias("page"), body.alias("body"))


@register("identities")
def _identities(spark, sf):
    """User, groups and roles of identity answers in their alternate forms."""
    return inv.identity(identity_payloads(spark, sf)).select(
        WS, "user", F.array_join("groups", ",").alias("groups"), F.array_join("roles", ",").alias("roles"))


@register("auth_users")
def _auth_users(spark, sf):
    """The user named in the text that the auth command prints."""
    c = load_raw(spark, sf, "customer")
    line = F.when(F.col("c_custkey") % 4 == 0, F.lit("no one")).otherwise(F.concat(F.lit("  User:  "), F.col("c_name"), F.lit(" ")))
    text = F.concat(F.lit("Host: https://h\n"), line, F.lit("\nUser agent: x"))
    return inv.auth_user(c.select(F.col("c_custkey").cast("long").alias(WS), text.alias("output")))


@register("ingest_small_lists")
def _ingest_small_lists(spark, sf):
    """Rows of the small lists, summed up per workspace."""
    p = landed(spark, sf)
    named = lambda kind, rows, off: rows.groupBy(WS).agg(
        F.count(F.lit(1)).alias("rows"), F.min("name").alias("first_name"), F.count_if(off).alias("off")).select(WS, F.lit(kind).alias("kind"), "rows", "first_name", "off")
    no = F.lit(False)
    parts = [named("pool", inv.instance_pools(p), no), named("endpoint", inv.serving_endpoints(p), no),
             named("init_script", inv.init_scripts(p), ~F.col("enabled")),
             named("ip_access_list", inv.ip_access_lists(p).withColumn("name", F.col("label")), F.col("enabled")),
             inv.tokens(p).select(WS, F.lit("token").alias("kind"), F.col("token_count").alias("rows"), F.array_min("token_ids").alias("first_name"),
                                  (F.col("token_count") - F.size("token_ids")).alias("off"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("score_sheet_file")
def _score_sheet_file(spark, sf):
    """The score sheet written as CSV per workspace and read back."""
    a = assessed(spark, sf)
    sheet = reports.score_sheet(spark, a.scores, a.inputs)
    path = f"{_snapshot_root(spark)}-sheet"
    store.write_score_sheet(sheet, path)
    back = spark.read.schema(sheet.schema).option("header", True).csv(path)
    return back.select([F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in back.dtypes]).drop("Finding/Notes")


ORACLES["identities"] = """
select cast(c_custkey as bigint) as workspace_id, c_name as user,
       case c_custkey % 3 when 0 then 'admins,' || c_mktsegment when 1 then c_mktsegment else '' end as groups,
       case c_custkey % 3 when 1 then 'viewer' else '' end as roles
from customer"""
ORACLES["auth_users"] = """
select cast(c_custkey as bigint) as workspace_id, case when c_custkey % 4 = 0 then null else c_name end as user from customer"""
oracle("ingest_small_lists", ["object_counts"], """
select cast(workspace_id as bigint) as workspace_id, kind, n as rows,
       case when kind = 'ip_access_list' then null else kind || '-1' end as first_name,
       case kind when 'init_script' then cast(floor((n + 1) / 2) as bigint) else 0 end as off
from object_counts where n > 0 and kind in ('pool', 'endpoint', 'init_script', 'ip_access_list', 'token')""")
ORACLES["score_sheet_file"] = f"""select * replace (coalesce("Verified", '') as "Verified") from ({ORACLES["score_sheet"]})"""
