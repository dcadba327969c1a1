"""Per-workspace features from the configuration inventory.

Each inventory table is reduced by one ``groupBy(workspace_id)`` of conditional
aggregates (partial aggregation map-side, so a workspace that owns most objects
still ships one partial row per input partition). The per-table results are
merged by a union and a second tiny aggregate instead of a chain of joins.
Aggregates of text make Spark sort their input, so ``workspace_features`` keeps
text out of the aggregates that read objects: it is a grouping key there, and
only the few rows left per workspace are aggregated by text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions.columns import pick
from fleetgrade.functions.substring_join import count_containing

WS = "workspace_id"

# Node-type substrings counted as cost-efficient, per cloud.
EFFICIENT_NODE_PATTERNS = {
    "aws": ("6g.", "7g.", "6gd.", "7gd.", "6gn.", "7gn."),
    "azure": ("dpsv5", "dpdsv5", "epsv5", "epdsv5", "dpsv6", "standard_d"),
    "gcp": ("t2d-", "n2d-", "t2a-"),
}
# Cloud detection, first match wins, on the lower-cased host.
CLOUD_PATTERNS = (
    (r"\.azuredatabricks\.net", "azure"),
    (r"\.gcp\.databricks\.com", "gcp"),
    (r"\.cloud\.databricks\.com", "aws"),
    (r"\.databricks\.com", "aws"),
)
SPOT_AVAILABILITY = ("SPOT", "SPOT_WITH_FALLBACK", "PREEMPTIBLE")
STANDARD_MODES = ("USER_ISOLATION", "STANDARD")
DEDICATED_MODES = ("SINGLE_USER", "DEDICATED")
OBJECT_KINDS = ("policy", "pool", "endpoint", "repo", "init_script", "group", "scope",
                "ip_access_list", "token", "external_location", "storage_credential",
                "workspace_object", "untitled_notebook", "disabled_init_script")


def cloud_of_host(host: Column) -> Column:
    """Cloud of a workspace host; empty or unmatched -> ``unknown``."""
    h = F.regexp_replace(F.lower(host), "/+$", "")
    out = F.lit("unknown")
    for pattern, cloud in reversed(CLOUD_PATTERNS):
        out = F.when(h.rlike(pattern), F.lit(cloud)).otherwise(out)
    return F.when(host.isNull() | (host == ""), F.lit("unknown")).otherwise(out)


def _contains_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def workspace_base(workspaces: DataFrame) -> DataFrame:
    """One row per known workspace with host, cloud and metastore facts."""
    return workspaces.select(
        WS, "host", cloud_of_host(F.col("host")).alias("cloud"),
        "metastore_name", "metastore_owner", "delta_sharing_scope",
        # The summary counts as present when the call returned any field (name,
        # owner or sharing scope), even without a name.
        (_nonempty(F.col("metastore_name")) | F.col("metastore_owner").isNotNull()
         | F.col("delta_sharing_scope").isNotNull()).alias("has_metastore"),
    )


# Every feature is declared once as (name, per-row expression, aggregate). The
# per-table queries aggregate one table; ``workspace_features`` reduces each table
# to a few rows per workspace, stacks these and aggregates them in one groupBy.
Spec = list[tuple[str, Column, str]]

_AGG = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint"),
    "any": lambda c: F.coalesce(F.bool_or(c), F.lit(False)),
    "distinct": lambda c: F.count_distinct(c),
    "max": F.max,
    "min": F.min,
}


def _flag(cond: Column) -> Column:
    """Per-row 0/1 for a conditional count (NULL condition counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def _aggregate(table: DataFrame, spec: Spec) -> DataFrame:
    rows = table.select(WS, *[e.alias(n) for n, e, _a in spec])
    return rows.groupBy(WS).agg(*[_AGG[a](F.col(n)).alias(n) for n, _e, a in spec])


_PARTIAL = {"sum": F.sum, "any": F.bool_or, "max": F.max, "min": F.min}


def reduced(table: DataFrame, spec: Spec) -> DataFrame:
    """The per-row columns of ``spec``, added up per workspace and distinct text.

    The aggregates of ``spec`` give the same over these rows as over the table's.
    """
    rows = table.select(WS, *[e.alias(n) for n, e, _a in spec])
    texts = [n for n, t in rows.dtypes if t == "string" and n != WS]
    summed = [(n, a) for n, _e, a in spec if n not in texts and a != "distinct"]
    keys = [WS] + [n for n, _e, a in spec if n in texts or a == "distinct"]
    return rows.groupBy(*keys).agg(*[_PARTIAL[a](n).alias(n) for n, a in summed]) if summed else rows.distinct()


def clusters_spec(clusters: DataFrame, recent_regex: str = r"^1[4-9]\.") -> Spec:
    """F1-F14."""
    state = F.col("state")
    auto_max = pick(clusters, "autoscale_max_workers", "autoscale.max_workers")
    # An empty autoscale object does not autoscale.
    parts = clusters.schema["autoscale"].dataType.names if "autoscale" in clusters.columns else []
    has_autoscale = (F.coalesce(*(F.col(f"autoscale.{x}").cast("string") for x in parts)) if parts else auto_max).isNotNull()
    nw = F.col("num_workers")
    autoterm = F.col("auto_termination_minutes")
    tags = (F.col("custom_tag_count") if "custom_tag_count" in clusters.columns
            else F.size(F.coalesce(F.col("custom_tags"), F.create_map())))
    node = F.lower(F.coalesce(F.col("node_type_id"), F.lit("")))
    has_node = _nonempty(F.col("node_type_id"))
    version = F.col("spark_version")
    mode = F.upper(F.coalesce(F.col("data_security_mode"), F.lit("")))
    avail = F.upper(F.coalesce(F.col("availability"), F.lit("")))
    first_od = F.col("first_on_demand")
    return [
        ("cluster_count", F.lit(1), "sum"),
        ("running_clusters", _flag(state == "RUNNING"), "sum"),
        ("photon_clusters", _flag(F.col("runtime_engine") == "PHOTON"), "sum"),
        ("autoscale_clusters", _flag(has_autoscale), "sum"),
        ("total_workers", F.coalesce(nw, F.lit(0)), "sum"),
        ("max_workers", F.coalesce(F.nullif(auto_max, F.lit(0)), F.nullif(nw, F.lit(0)), F.lit(0)).cast("bigint"),
         "max"),
        ("node_type_count", F.when(has_node, F.col("node_type_id")), "distinct"),
        ("node_type_sample", F.when(has_node, F.col("node_type_id")), "min"),
        ("running_no_autoterm", _flag((state == "RUNNING") & (autoterm.isNull() | (autoterm == 0))), "sum"),
        ("autoterm_clusters", _flag(autoterm > 0), "sum"),
        ("tagged_clusters", _flag(tags > 0), "sum"),
        ("versioned_clusters", _flag(_nonempty(version)), "sum"),
        ("recent_runtime_clusters", _flag(_nonempty(version) & version.rlike(recent_regex)), "sum"),
        ("gpu_clusters", _flag(node.contains("gpu")), "sum"),
        ("spot_clusters", _flag(avail.isin(*SPOT_AVAILABILITY) | (first_od.isNotNull() & (first_od == 0))), "sum"),
        ("standard_mode_clusters", _flag(mode.isin(*STANDARD_MODES)), "sum"),
        ("dedicated_mode_clusters", _flag(mode.isin(*DEDICATED_MODES)), "sum"),
        ("none_mode_clusters", _flag(~mode.isin(*STANDARD_MODES, *DEDICATED_MODES)), "sum"),
        *[(f"efficient_{cloud}", _flag(has_node & _contains_any(node, pats)), "sum")
          for cloud, pats in EFFICIENT_NODE_PATTERNS.items()],
    ]


def features_clusters(clusters: DataFrame, recent_regex: str = r"^1[4-9]\.") -> DataFrame:
    return _aggregate(clusters, clusters_spec(clusters, recent_regex))


def warehouses_spec(warehouses: DataFrame) -> Spec:
    """F15-F17."""
    serverless = F.col("enable_serverless_compute") == F.lit(True)
    multi = F.coalesce(F.col("max_num_clusters"), F.lit(0)) > 1
    return [
        ("warehouse_count", F.lit(1), "sum"),
        ("pro_or_serverless_wh", _flag((F.col("warehouse_type") == "PRO") | serverless), "sum"),
        ("multi_or_serverless_wh", _flag(multi | serverless), "sum"),
        ("multi_cluster_wh", _flag(multi), "sum"),
        ("photon_wh", _flag(F.col("enable_photon") == F.lit(True)), "sum"),
        ("autostop_wh", _flag(F.coalesce(F.col("auto_stop_mins"), F.lit(0)) > 0), "sum"),
        ("running_wh", _flag(F.col("state") == "RUNNING"), "sum"),
    ]


def features_warehouses(warehouses: DataFrame) -> DataFrame:
    return _aggregate(warehouses, warehouses_spec(warehouses))


def sp_owned_jobs(jobs: DataFrame, service_principals: DataFrame) -> DataFrame:
    """jobs whose creator contains a principal's display name (case-insensitive)."""
    return count_containing(jobs, [WS], "creator_user_name", service_principals, "display_name", "sp_owned_jobs")


def jobs_spec(jobs: DataFrame) -> Spec:
    """F18-F20."""
    name = F.coalesce(F.col("name"), F.lit(""))
    # Quirk Q8: the rule reads ``existing_cluster_id``, which the inventory never
    # carries, so only ``has_job_clusters`` decides unless the column is present.
    job_cluster = F.col("has_job_clusters") == F.lit(True)
    if "existing_cluster_id" in jobs.columns:
        job_cluster = job_cluster & ~_nonempty(F.col("existing_cluster_id"))
    return [
        ("job_count", F.lit(1), "sum"),
        ("git_jobs", _flag(F.col("has_git_source") == F.lit(True)), "sum"),
        ("retry_jobs", _flag(F.coalesce(F.col("max_retries"), F.lit(0)) > 0), "sum"),
        ("job_cluster_jobs", _flag(job_cluster), "sum"),
        ("dab_jobs", _flag(name.contains("[DAB]") | name.contains("[dev ")), "sum"),
        ("iac_jobs", _flag(name.contains("[DAB]") | F.lower(name).contains("dabs")), "sum"),
    ]


def features_jobs(jobs: DataFrame, service_principals: DataFrame | None = None) -> DataFrame:
    """F18-F21."""
    agg = _aggregate(jobs, jobs_spec(jobs))
    if service_principals is None:
        return agg.withColumn("sp_owned_jobs", F.lit(0).cast("bigint"))
    return (agg.join(sp_owned_jobs(jobs, service_principals), on=WS, how="left")
            .withColumn("sp_owned_jobs", F.coalesce(F.col("sp_owned_jobs"), F.lit(0)).cast("bigint")))


def pipelines_spec(pipelines: DataFrame) -> Spec:
    """F22 (``autoscale_pipelines`` stays 0 unless the column exists: quirk Q8)."""
    lname = F.lower(F.coalesce(F.col("name"), F.lit("")))
    auto = _flag(F.col("autoscale").isNotNull()) if "autoscale" in pipelines.columns else F.lit(0)
    return [
        ("pipeline_count", F.lit(1), "sum"),
        ("failed_pipelines", _flag(F.col("state") == "FAILED"), "sum"),
        ("connect_pipelines", _flag(lname.contains("connect") | lname.contains("gateway")), "sum"),
        ("autoscale_pipelines", auto, "sum"),
    ]


def features_pipelines(pipelines: DataFrame) -> DataFrame:
    return _aggregate(pipelines, pipelines_spec(pipelines))


def catalogs_spec(catalogs: DataFrame) -> Spec:
    """F23."""
    return [("catalog_count", F.lit(1), "sum"),
            ("has_open_catalog", F.col("isolation_mode") == "OPEN", "any")]


def features_catalogs(catalogs: DataFrame) -> DataFrame:
    return _aggregate(catalogs, catalogs_spec(catalogs))


def scim_spec(scim_groups: DataFrame) -> Spec:
    """F24."""
    return [("scim_count", F.lit(1), "sum"),
            ("idp_synced", _flag(_nonempty(F.col("external_id"))), "sum")]


def features_scim(scim_groups: DataFrame) -> DataFrame:
    return _aggregate(scim_groups, scim_spec(scim_groups))


def sp_spec(service_principals: DataFrame) -> Spec:
    return [("sp_count", F.lit(1), "sum")]


def features_service_principals(service_principals: DataFrame) -> DataFrame:
    return _aggregate(service_principals, sp_spec(service_principals))


def settings_spec(settings: DataFrame) -> Spec:
    """settings pivoted to flags (string compare on the lower-cased value)."""
    key, val = F.col("setting"), F.lower(F.col("value").cast("string"))
    return [
        ("has_settings", F.lit(True), "any"),
        ("dbfs_off", (key == "enableDbfsFileBrowser") & (val == "false"), "any"),
        ("ipl_on", (key == "enableIpAccessLists") & (val == "true"), "any"),
        ("setting_dbfs_browser", F.when(key == "enableDbfsFileBrowser", F.col("value")), "max"),
        ("setting_ip_access_lists", F.when(key == "enableIpAccessLists", F.col("value")), "max"),
        ("setting_results_download", F.when(key == "enableResultsDownloading", F.col("value")), "max"),
        ("setting_export_notebook", F.when(key == "enableExportNotebook", F.col("value")), "max"),
        ("setting_token_lifetime_days", F.when(key == "maxTokenLifetimeDays", F.col("value")), "max"),
    ]


def features_settings(settings: DataFrame) -> DataFrame:
    return _aggregate(settings, settings_spec(settings))


def counts_spec(object_counts: DataFrame) -> Spec:
    """small object lists kept as counts, one column per fixed kind."""
    return [(f"{k}_count", F.when(F.col("kind") == k, F.col("n")), "sum") for k in OBJECT_KINDS]


def features_counts(object_counts: DataFrame) -> DataFrame:
    return _aggregate(object_counts, counts_spec(object_counts))


# Feature counts that also hold list members which are no objects (``unlisted`` rows).
LISTED_KINDS = ("cluster", "warehouse", "job", "pipeline", "catalog", "scim", "sp")


def unlisted_spec(unlisted: DataFrame) -> Spec:
    """Members counted beyond the rows of a list, added to that list's count."""
    return [(f"{k}_count", F.when(F.col("kind") == k, F.col("n")), "sum") for k in LISTED_KINDS]


def workspace_features(tables: dict[str, DataFrame], recent_regex: str = r"^1[4-9]\.") -> DataFrame:
    """One wide row per workspace of ``tables['workspaces']``.

    Each table is projected to its per-row feature columns and reduced to a few rows
    per workspace (``reduced``: narrow hash aggregates, whose memory grows with the
    workspaces and not with the objects); these are stacked with ``unionByName`` and
    one ``groupBy(workspace_id)`` computes every feature. Absent counts become 0 and
    absent flags false.
    """
    base = workspace_base(tables["workspaces"])
    specs: list[tuple[DataFrame, Spec]] = [
        (base, [(c, F.col(c), "max") for c in base.columns if c != WS] + [("_known", F.lit(True), "any")]),
        (tables["clusters"], clusters_spec(tables["clusters"], recent_regex)),
        (tables["warehouses"], warehouses_spec(tables["warehouses"])),
        (tables["jobs"], jobs_spec(tables["jobs"])),
        (tables["pipelines"], pipelines_spec(tables["pipelines"])),
        (tables["catalogs"], catalogs_spec(tables["catalogs"])),
        (tables["scim_groups"], scim_spec(tables["scim_groups"])),
        (tables["service_principals"], sp_spec(tables["service_principals"])),
        (tables["settings"], settings_spec(tables["settings"])),
        (tables["object_counts"], counts_spec(tables["object_counts"])),
    ]
    if "unlisted" in tables:
        specs.append((tables["unlisted"], unlisted_spec(tables["unlisted"])))
    owned = sp_owned_jobs(tables["jobs"], tables["service_principals"])
    specs.append((owned, [("sp_owned_jobs", F.col("sp_owned_jobs"), "max")]))
    rows = [reduced(t, sp) for t, sp in specs]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    # A count may come from two tables (rows of a list, members beyond them): one sum.
    aggs = {n: _AGG[a](F.col(n)).alias(n) for _t, sp in specs for n, _e, a in sp}
    folded = stacked.groupBy(WS).agg(*aggs.values()).where(F.col("_known"))
    dtypes = dict(folded.dtypes)
    out = []
    for n in aggs:
        if n == "_known":
            continue
        if dtypes[n] in ("bigint", "int"):
            out.append(F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n))
        else:
            out.append(F.col(n))
    return folded.select(WS, *out)


def best_warehouse(warehouses: DataFrame) -> DataFrame:
    """Per workspace the warehouse with the greatest (serverless, running, id)."""
    rank = F.struct(
        F.coalesce(F.col("enable_serverless_compute"), F.lit(False)).alias("s"),
        (F.col("state") == "RUNNING").alias("r"),
        F.col("warehouse_id").alias("i"),
    )
    return warehouses.groupBy(WS).agg(F.max_by("warehouse_id", rank).alias("warehouse_id"))
