"""Assessments cached as JSON documents, read back as tables.

A cached assessment is three documents per workspace, here rows ``(workspace_id, kind, body)``:
``collected`` (findings by collector), ``audit`` (the flattened calls) and ``scored`` (scores,
roll-ups, host and date). ``read`` parses every document once, writes the parsed structs, and
derives all tables from them by column pruning: the ten inventory tables, the deep row, the
scores and the call log.

The deep section holds query results whose numbers may be text (results come back as text
arrays); they are read as text and converted, and a value that is no number counts as absent.
What the documents do not hold stays NULL: totals over all rows (``total_dbus_all``), unrounded
hours, each catalog's own isolation mode (only the distinct modes are kept, so every catalog
row carries ``OPEN`` where that is among them, else the first one). Counts that exceed the
listed members come back as ``unlisted`` rows. A document that is not a JSON object, and a
collector that failed (an empty object), give no rows; the workspace itself stays.

``documents`` writes the same form for exchange with tools that read it. A workspace may hold
any number of clusters, jobs or calls, so a document is written in parts ``(workspace_id, kind,
part, body)``, each a document of its own form that holds at most about ``MEMBERS`` members of
a list or ``CALLS`` calls: no row and no task holds a workspace's whole lists. ``part`` 0 holds
everything that is said once; further ``collected`` parts hold further members (and the distinct
isolation modes and owners, which their catalogs need), and the part of an ``audit`` document is
the position of its first call. Documents without ``part`` are whole. The fleet's own snapshots
are the partitioned tables of ``store``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrade.functions.fold import fold_by_key, shuffled
from fleetgrade.functions.numbering import numbered_within
from fleetgrade.operators.compute import ALWAYS_ON_HOURS
from fleetgrade.operators.deep import DEEP_COLUMNS, DEEP_TYPES, FLAGS
from fleetgrade.session import cut_lineage

WS = "workspace_id"
MEMBERS, CALLS = 1000, 256   # members of a list and calls in one part of a document
S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _arr(*fields) -> T.ArrayType:
    return T.ArrayType(_st(*fields))


_ROWS = T.ArrayType(T.MapType(S, S))   # result rows of the deep scan, numbers as text

# The collectors' names and the fields of their findings.
COLLECTED = _st(
    ("GovernanceCollector", _st(
        ("catalog_count", L), ("catalogs", T.ArrayType(S)), ("isolation_modes", T.ArrayType(S)), ("owners", T.ArrayType(S)),
        ("metastore_name", S), ("metastore_summary", _st(("name", S), ("owner", S), ("delta_sharing_scope", S))),
        ("external_location_count", L), ("storage_credential_count", L))),
    ("ComputeCollector", _st(
        ("cluster_count", L), ("clusters", _arr(
            ("cluster_name", S), ("cluster_id", S), ("state", S), ("autoscale", _st(("min_workers", I), ("max_workers", I))),
            ("num_workers", I), ("node_type_id", S), ("driver_node_type_id", S), ("runtime_engine", S), ("spark_version", S),
            ("auto_termination_minutes", I), ("policy_id", S), ("custom_tags", T.MapType(S, S)), ("cluster_source", S),
            ("data_security_mode", S), ("first_on_demand", I), ("availability", S))),
        ("warehouse_count", L), ("warehouses", _arr(
            ("name", S), ("id", S), ("size", S), ("state", S), ("warehouse_type", S), ("enable_serverless_compute", B),
            ("auto_stop_mins", I), ("max_num_clusters", I), ("min_num_clusters", I), ("cluster_size", S), ("enable_photon", B))),
        ("policy_count", L), ("pool_count", L))),
    ("SecurityCollector", _st(
        ("security_settings", T.MapType(S, S)), ("ip_access_list_count", L), ("token_info", _st(("count", L))),
        ("service_principal_count", L), ("service_principals", _arr(("displayName", S), ("applicationId", S), ("active", B))),
        ("scim_group_count", L), ("scim_groups", _arr(("displayName", S), ("externalId", S))))),
    ("OperationsCollector", _st(
        ("job_count", L), ("jobs", _arr(
            ("job_id", L), ("name", S), ("has_git_source", B), ("max_retries", I), ("has_existing_cluster_id", B),
            ("has_job_clusters", B), ("creator_user_name", S))),
        ("pipeline_count", L), ("pipelines", _arr(("pipeline_id", S), ("name", S), ("state", S), ("creator_user_name", S))),
        ("endpoint_count", L), ("repo_count", L), ("init_script_count", L), ("init_scripts", _arr(("name", S), ("enabled", B))), ("group_count", L), ("scope_count", L))),
    ("WorkspaceCollector", _st(("object_count", L), ("untitled_notebooks_count", L))),
    ("SystemTablesCollector", _st(
        ("available", B),
        ("billing", _st(("available", B), ("total_dbus_30d", S), ("trend_pct_change", S), ("top_cost_clusters", _ROWS))),
        ("compute_history", _st(("available", B), ("cluster_uptime", _ROWS), ("total_running_hours_30d", S),
                                ("idle_clusters", _ROWS), ("idle_hours_30d", S))),
        ("query_history", _st(("available", B), ("total_queries_30d", S), ("failed_queries_30d", S), ("failure_rate_pct", S),
                              ("p95_duration_ms", S), ("slow_queries_30d", S), ("warehouse_utilization", _ROWS))),
        ("job_runs", _st(("available", B), ("total_runs_30d", S), ("failed_runs_30d", S), ("success_rate_pct", S),
                         ("top_failing_jobs", _ROWS))),
        ("audit_events", _st(("available", B), ("total_events_30d", S), ("failed_logins_30d", S), ("permission_changes_30d", S))))))
SCORED = _st(
    ("workspace_host", S), ("assessment_date", S), ("cloud_provider", S), ("overall_score", D), ("maturity_level", S),
    ("best_practice_scores", _arr(("name", S), ("pillar", S), ("principle", S), ("score", I), ("finding_notes", S), ("verified", B))))
AUDIT = _arr(("command", S), ("output", S), ("timestamp", S), ("duration", S))

# Fixed values: (count-only kind, collector, field).
_COUNTS = (
    ("policy", "ComputeCollector", "policy_count"), ("pool", "ComputeCollector", "pool_count"),
    ("endpoint", "OperationsCollector", "endpoint_count"), ("repo", "OperationsCollector", "repo_count"),
    ("init_script", "OperationsCollector", "init_script_count"), ("group", "OperationsCollector", "group_count"),
    ("scope", "OperationsCollector", "scope_count"), ("ip_access_list", "SecurityCollector", "ip_access_list_count"),
    ("token", "SecurityCollector", "token_info.count"), ("external_location", "GovernanceCollector", "external_location_count"),
    ("storage_credential", "GovernanceCollector", "storage_credential_count"), ("workspace_object", "WorkspaceCollector", "object_count"),
    ("untitled_notebook", "WorkspaceCollector", "untitled_notebooks_count"))
# (feature count, collector, count field, list field): the count also holds members that are no objects.
_LISTED = (
    ("cluster", "ComputeCollector", "cluster_count", "clusters"), ("warehouse", "ComputeCollector", "warehouse_count", "warehouses"),
    ("job", "OperationsCollector", "job_count", "jobs"), ("pipeline", "OperationsCollector", "pipeline_count", "pipelines"),
    ("catalog", "GovernanceCollector", "catalog_count", "catalogs"), ("scim", "SecurityCollector", "scim_group_count", "scim_groups"),
    ("sp", "SecurityCollector", "service_principal_count", "service_principals"))
# (deep column, path in the deep section) of the plain numbers.
_NUMBERS = (
    ("total_dbus_30d", "billing.total_dbus_30d"), ("trend_pct_change", "billing.trend_pct_change"),
    ("total_running_hours_30d", "compute_history.total_running_hours_30d"), ("idle_hours_30d", "compute_history.idle_hours_30d"),
    ("total_queries", "query_history.total_queries_30d"), ("failed_queries", "query_history.failed_queries_30d"),
    ("failure_rate_pct", "query_history.failure_rate_pct"), ("slow_query_count", "query_history.slow_queries_30d"),
    ("p95_duration_ms", "query_history.p95_duration_ms"), ("total_runs", "job_runs.total_runs_30d"),
    ("failed_runs", "job_runs.failed_runs_30d"), ("success_rate_pct", "job_runs.success_rate_pct"),
    ("total_events_30d", "audit_events.total_events_30d"), ("failed_logins", "audit_events.failed_logins_30d"),
    ("permission_changes", "audit_events.permission_changes_30d"))


@dataclass
class Cache:
    inventory: dict[str, DataFrame]
    deep: DataFrame
    scores: DataFrame
    calls: DataFrame
    rejected: DataFrame        # workspace_id, kind of documents that are not of their kind's JSON form


def _number(text: Column, of: str = "double") -> Column:
    """A number that may be written as text; counts may be written with a fraction."""
    value = text.try_cast("double")
    return value if of == "double" else value.cast(of)


def read(documents: DataFrame, catalog: DataFrame) -> Cache:
    """The tables of cached documents; ``catalog`` (name, pillar, rule_id, ord) names the scores' rules."""
    body = lambda kind, schema: F.when(F.col("kind") == kind, F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    part = F.col("part") if "part" in documents.columns else F.lit(0)
    docs = cut_lineage(documents.select(
        WS, "kind", part.cast("long").alias("part"), body("collected", COLLECTED).alias("c"), body("scored", SCORED).alias("s"), body("audit", AUDIT).alias("a"),
        F.when(F.col("kind") == "audit", F.col("body").rlike(r"^\s*\[")).otherwise(F.col("body").rlike(r"^\s*\{")).alias("form"),
        F.is_valid_utf8("body").alias("utf8"), F.try_parse_json("body").isNotNull().alias("json")), "json-cache", wide=True)
    fine = F.col("form") & F.col("utf8") & F.col("json")
    rejected = docs.where(~F.coalesce(fine, F.lit(False))).select(WS, "kind")
    docs = docs.where(fine)
    c = docs.where("kind = 'collected'").select(WS, "part", "c.*")
    once = c.where("part = 0")        # what is no list stands in the first part
    s = docs.where("kind = 'scored'").select(WS, "s.*")

    def listed(path: str) -> DataFrame:
        return c.select(WS, F.explode(path).alias("m")).where(F.col("m").isNotNull())

    clusters = listed("ComputeCollector.clusters").select(WS, "m.*")
    warehouses = listed("ComputeCollector.warehouses").select(WS, "m.*").withColumnRenamed("id", "warehouse_id")
    jobs = listed("OperationsCollector.jobs").select(WS, "m.*").withColumn("name", F.coalesce("name", F.lit("")))
    modes = F.col("GovernanceCollector.isolation_modes")
    mode = F.when(F.array_contains(modes, "OPEN"), "OPEN").otherwise(F.get(modes, F.lit(0)))
    catalogs = c.select(WS, F.explode("GovernanceCollector.catalogs").alias("catalog_name"), mode.alias("isolation_mode"),
                        F.get("GovernanceCollector.owners", F.lit(0)).alias("owner"))
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{at}.{f}").alias("n")) for k, at, f in _COUNTS])
    unlisted = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{at}.{n}").alias("all"), F.size(F.coalesce(f"{at}.{lst}", F.array())).alias("rows"))
                         for k, at, n, lst in _LISTED])
    ms = "GovernanceCollector.metastore_summary"
    hosts = documents.select(WS).distinct().join(shuffled(s.groupBy(WS).agg(F.max("workspace_host").alias("host"))), WS, "left")
    stores = once.select(WS, F.coalesce(f"{ms}.name", "GovernanceCollector.metastore_name").alias("metastore_name"),
                      F.col(f"{ms}.owner").alias("metastore_owner"), F.col(f"{ms}.delta_sharing_scope").alias("delta_sharing_scope"))
    inventory = {
        "workspaces": hosts.join(shuffled(stores), WS, "left"), "clusters": clusters, "warehouses": warehouses, "jobs": jobs,
        "pipelines": listed("OperationsCollector.pipelines").select(WS, "m.*"), "catalogs": catalogs,
        "scim_groups": listed("SecurityCollector.scim_groups").select(WS, F.col("m.displayName").alias("display_name"),
                                                                      F.col("m.externalId").alias("external_id")),
        "service_principals": listed("SecurityCollector.service_principals").select(
            WS, F.coalesce("m.displayName", F.lit("")).alias("display_name"), F.col("m.applicationId").alias("application_id"),
            F.coalesce("m.active", F.lit(True)).alias("active")),
        "settings": once.select(WS, F.explode("SecurityCollector.security_settings").alias("setting", "value")),
        "object_counts": once.select(WS, F.inline(counts)).where(F.col("n").isNotNull()).unionByName(
            listed("OperationsCollector.init_scripts").where(~F.col("m.enabled")).groupBy(WS).agg(F.count(F.lit(1)).alias("n"))
            .select(WS, F.lit("disabled_init_script").alias("kind"), "n")),
        "unlisted": c.select(WS, F.inline(unlisted)).groupBy(WS, "kind").agg((F.sum("all") - F.sum("rows")).alias("n")).where(F.col("n") != 0),
    }
    calls = docs.where("kind = 'audit'").select(WS, "part", F.posexplode("a").alias("pos", "e")).select(
        WS, (F.col("part") + F.col("pos")).alias("seq"), "e.command", "e.output", "e.timestamp", _number(F.col("e.duration")).alias("duration_seconds"))
    scores = (s.select(WS, F.to_date(F.substring("assessment_date", 1, 10)).alias("as_of"), F.explode("best_practice_scores").alias("b"))
              .select(WS, "as_of", "b.*").join(F.broadcast(catalog.select("name", "pillar", "rule_id", "ord")), ["name", "pillar"]))
    return Cache(inventory, _deep_row(once), scores, calls, rejected)


def _deep_row(c: DataFrame) -> DataFrame:
    """The deep columns and availability flags of every workspace with a deep section."""
    at = "SystemTablesCollector"
    rows = lambda path: F.coalesce(F.col(f"{at}.{path}"), F.array().cast(_ROWS))
    most = lambda path, key: F.array_max(F.transform(rows(path), lambda r: _number(r[key])))
    some = lambda path: F.nullif(F.size(rows(path)), F.lit(0))
    always = lambda r: F.coalesce(_number(r["running_hours"]) > ALWAYS_ON_HOURS, F.lit(False))

    def first(path: str, width: int, fine) -> Column:
        """The first three names, longest running first."""
        order = lambda r: F.struct((-_number(r["running_hours"])).alias("h"), r["cluster_id"].alias("i"), r["cluster_name"].alias("n"))
        ranked = F.slice(F.sort_array(F.transform(F.filter(rows(path), fine), order)), 1, 3)
        return F.array_join(F.transform(ranked, lambda x: F.substring(F.coalesce(x["n"], x["i"], F.lit("?")), 1, width)), ", ")

    have = {n: _number(F.col(f"{at}.{p}"), DEEP_TYPES[n]) for n, p in _NUMBERS} | {
        "top_cluster_dbus": most("billing.top_cost_clusters", "total_dbus"),
        "uptime_rows": some("compute_history.cluster_uptime"), "max_running_hours": most("compute_history.cluster_uptime", "running_hours"),
        "always_on_rows": F.size(F.filter(rows("compute_history.cluster_uptime"), always)),
        "always_on_names": first("compute_history.cluster_uptime", 25, always),
        "idle_names": first("compute_history.idle_clusters", 30, lambda r: F.lit(True)),
        "idle_rows": some("compute_history.idle_clusters"), "wh_rows": some("query_history.warehouse_utilization"),
        "wh_top_count": most("query_history.warehouse_utilization", "query_count"), "failing_jobs": some("job_runs.top_failing_jobs"),
        "chronic_jobs": F.when(some("job_runs.top_failing_jobs").isNotNull(), F.size(F.filter(
            rows("job_runs.top_failing_jobs"), lambda r: F.coalesce(_number(r["failures"]) >= 5, F.lit(False)))))}
    whole = F.coalesce(F.col(f"{at}.available"), F.lit(False))
    flags = {f"{name}_available": whole & F.coalesce(F.col(f"{at}.{section}.available"), F.lit(False)) for name, section in (
        ("billing", "billing"), ("compute", "compute_history"), ("query", "query_history"), ("jobs", "job_runs"), ("audit", "audit_events"))}
    return c.select(WS, *[have.get(n, F.lit(None)).cast(DEEP_TYPES[n]).alias(n) for n in DEEP_COLUMNS], *[flags[f].alias(f) for f in FLAGS])


def documents(inventory: dict[str, DataFrame], inputs: DataFrame, lists: dict[str, DataFrame], scores: DataFrame,
              calls: DataFrame | None = None, members: int = MEMBERS, entries: int = CALLS) -> DataFrame:
    """Cached documents of a fleet, in parts: ``inputs`` as scored, ``lists`` the deep result rows (some per workspace) by the name of their field."""
    t = inventory
    cl, wh, cat = t["clusters"], t["warehouses"], t["catalogs"]
    tags = (F.when(F.col("custom_tag_count") > 0, F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), F.col("custom_tag_count")), lambda i: F.concat(F.lit("tag"), i.cast("string"))),
        F.array_repeat(F.lit("x"), F.col("custom_tag_count")))) if "custom_tag_count" in cl.columns else F.col("custom_tags"))
    auto = (F.when(F.col("autoscale_max_workers").isNotNull(), F.struct(F.lit(1).alias("min_workers"), F.col("autoscale_max_workers").alias("max_workers")))
            if "autoscale_max_workers" in cl.columns else F.col("autoscale"))
    field = lambda collector, name: COLLECTED[collector].dataType[name].dataType
    item = lambda df, kind: F.struct(*[F.col(f.name) for f in kind.elementType.fields if f.name in df.columns])
    cl = cl.withColumn("custom_tags", tags).withColumn("autoscale", auto)
    wh = wh.withColumnRenamed("warehouse_id", "id")
    rows = {
        "clusters": (cl, item(cl, field("ComputeCollector", "clusters"))),
        "warehouses": (wh, item(wh, field("ComputeCollector", "warehouses"))),
        "jobs": (t["jobs"], item(t["jobs"], field("OperationsCollector", "jobs"))),
        "pipelines": (t["pipelines"], item(t["pipelines"], field("OperationsCollector", "pipelines"))),
        "catalogs": (cat, F.col("catalog_name")),
        "scim_groups": (t["scim_groups"], F.struct(F.col("display_name").alias("displayName"), F.col("external_id").alias("externalId"))),
        "service_principals": (t["service_principals"], F.struct(F.col("display_name").alias("displayName"), F.col("application_id").alias("applicationId")))}
    # Lists are written one by one: in one plan with all that they come from, the driver holds hundreds of
    # stages and plans the whole anew after each.
    sizes = cut_lineage(fold_by_key([df.groupBy(WS).agg(F.ceil(F.count(F.lit(1)) / members).alias(f"_{name}")) for name, (df, _m) in rows.items()], WS), "document-sizes")

    def gathered(name: str) -> DataFrame:
        """The members of a list by part: spread by what they hold, about ``members`` to a part."""
        table, member = rows[name]
        held = F.xxhash64(*[c for c, kind in table.dtypes if "map<" not in kind])
        # Dealt out by part, as the join's partitions by workspace would do for a group by (workspace, part), too.
        return cut_lineage(table.join(shuffled(sizes.select(WS, F.col(f"_{name}").alias("_parts"))), WS)
                           .withColumn("part", F.pmod(held, F.col("_parts"))).repartition(WS, "part")
                           .groupBy(WS, "part").agg(F.collect_list(member).alias(name)), "document-lists", wide=True)

    once = [
        t["settings"].groupBy(WS).agg(F.map_from_entries(F.collect_list(F.struct("setting", "value"))).alias("security_settings")),
        *[cut_lineage(df.groupBy(WS).agg(F.collect_list(F.struct(*[c for c in df.columns if c != WS])).alias(name)), "document-rows")
          for name, df in lists.items()]]
    facts = cat.groupBy(WS).agg(F.collect_set("isolation_mode").alias("isolation_modes"), F.collect_set("owner").alias("owners"))
    wide = inputs
    for p in once:
        wide = wide.join(shuffled(p), WS, "left")
    said = [c for c in wide.columns if c != WS]
    parts = F.greatest(F.lit(1), *[F.col(f"_{name}") for name in rows])
    wide = wide.join(shuffled(facts), WS, "left").join(shuffled(sizes), WS, "left").select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    first = lambda c: F.when(F.col("part") == 0, c)
    wide = wide.select(WS, "part", "isolation_modes", "owners", *[first(F.col(c)).alias(c) for c in said])
    for name in rows:
        wide = wide.join(shuffled(gathered(name)), [WS, "part"], "left")
    n = lambda feature: F.col(f"{feature}_count")
    group = lambda name, *cols: F.struct(*cols).alias(name)
    text = lambda c: F.col(c).cast("string")
    counts = lambda at: [(F.struct(n(k).alias("count")).alias("token_info") if k == "token" else n(k).alias(f)) for k, a, f in _COUNTS if a == at]
    listed = lambda at: [c for k, a, f, lst in _LISTED if a == at for c in (n(k).alias(f), F.col(lst))]
    deep = {s: [F.col(flag).alias("available")] + [text(col).alias(p.split(".")[1]) for col, p in _NUMBERS if p.startswith(s + ".")]
            + [F.col(x) for x in lists if x in SECTION_LISTS[s]]
            for s, flag in zip(SECTION_LISTS, ("billing_available", "compute_available", "query_available", "jobs_available", "audit_available"))}
    # The inputs hold how many scripts there are and how many are off, so the list is numbered.
    scripts = F.when(n("init_script") > 0, F.transform(F.sequence(F.lit(1), n("init_script").cast("int")), lambda i: F.struct(
        F.concat(F.lit("script-"), i.cast("string")).alias("name"), (i > n("disabled_init_script")).alias("enabled"))))
    store = F.struct(F.col("metastore_name").alias("name"), F.col("metastore_owner").alias("owner"), "delta_sharing_scope")
    collected = F.to_json(F.struct(
        group("GovernanceCollector", *listed("GovernanceCollector"), "isolation_modes", "owners", "metastore_name",
              F.when(F.col("has_metastore"), store).alias("metastore_summary"), *counts("GovernanceCollector")),
        group("ComputeCollector", *listed("ComputeCollector"), *counts("ComputeCollector")),
        group("SecurityCollector", "security_settings", *listed("SecurityCollector"), *counts("SecurityCollector")),
        group("OperationsCollector", *listed("OperationsCollector"), *counts("OperationsCollector"), scripts.alias("init_scripts")),
        group("WorkspaceCollector", *counts("WorkspaceCollector")),
        group("SystemTablesCollector", first(F.lit(True)).alias("available"), *[group(s, *cols) for s, cols in deep.items()]),
        F.col("cloud").alias("_cloud_provider")))
    out = wide.select(WS, F.lit("collected").alias("kind"), "part", collected.alias("body"))
    of_rules = scores.groupBy(WS).agg(F.max("as_of").alias("as_of"), F.collect_list(
        F.struct("name", "pillar", "principle", "score", "finding_notes", "verified")).alias("best_practice_scores"))
    scored = F.to_json(F.struct(F.col("host").alias("workspace_host"), text("as_of").alias("assessment_date"),
                                F.col("cloud").alias("cloud_provider"), "best_practice_scores"))
    whole = F.lit(0).cast("long").alias("part")
    out = out.unionByName(inputs.select(WS, "host", "cloud").join(shuffled(of_rules), WS, "left").select(WS, F.lit("scored").alias("kind"), whole, scored.alias("body")))
    if calls is not None:
        entry = F.struct("seq", "command", "output", F.lit("").alias("timestamp"), F.col("duration_seconds").alias("duration"))
        start = F.col("_at") - F.col("_at") % entries
        log = numbered_within(calls, WS, ["seq", "command"], "_at").groupBy(WS, start.alias("part")).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("body"))
        out = out.unionByName(log.select(WS, F.lit("audit").alias("kind"), "part", "body"))
    return out


# Sections of the deep scan and the result rows each holds.
SECTION_LISTS = {"billing": ("top_cost_clusters",), "compute_history": ("cluster_uptime", "idle_clusters"),
                 "query_history": ("warehouse_utilization",), "job_runs": ("top_failing_jobs",), "audit_events": ()}
