"""Land the fixture inventory as paged API payloads ``(workspace_id, endpoint, page, body)``.

This stands in for the collection step (which calls the workspace APIs) so the
normalizers can be exercised end to end on data Spark derives from the test
tables. Items are spread over pages of about ``page_size`` by hashing their id
within the workspace, so a page is built from a bounded group and no
workspace's list is gathered whole. Alternate API keys are used on purpose for
part of the workspaces (``statuses``/``pipelines``, ``token_infos``/``tokens``,
``group_names``/``groups``, top-level vs ``properties.isolation_mode``) to
exercise every normalization branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.sources.fixtures import Fixtures
from fleetgrade.sources.inventory import ENDPOINTS

WS = "workspace_id"


def paged(items: DataFrame, id_col: str, item: Column, list_key: str, endpoint: str,
          page_size: int = 100, extra: dict[str, Column] | None = None) -> DataFrame:
    """Group ``item`` structs into JSON pages of about ``page_size`` per workspace."""
    counts = items.groupBy(WS).agg(F.count(F.lit(1)).alias("_n"))
    with_pages = items.join(counts, on=WS).withColumn(
        "page", F.pmod(F.xxhash64(F.col(id_col)), F.ceil(F.col("_n") / page_size)).cast("int"))
    grouped = with_pages.groupBy(WS, "page").agg(
        F.collect_list(item).alias("_items"), *[F.first(v).alias(k) for k, v in (extra or {}).items()])
    body = F.struct(*[F.col(k).alias(k) for k in (extra or {})], F.col("_items").alias(list_key))
    return grouped.select(WS, F.lit(endpoint).alias("endpoint"), "page", F.to_json(body).alias("body"))


def _clusters(fx: Fixtures) -> DataFrame:
    c = fx.clusters
    tags = F.when(F.col("custom_tag_count") > 0, F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), F.col("custom_tag_count")), lambda i: F.concat(F.lit("tag"), i.cast("string"))),
        F.array_repeat(F.lit("x"), F.col("custom_tag_count"))))
    item = F.struct(
        "cluster_id", "cluster_name", "state",
        F.when(F.col("autoscale_max_workers").isNotNull(),
               F.struct(F.lit(1).alias("min_workers"), F.col("autoscale_max_workers").alias("max_workers")))
        .alias("autoscale"),
        "num_workers", "node_type_id", "runtime_engine", "spark_version", "auto_termination_minutes",
        tags.alias("custom_tags"), "data_security_mode",
        F.struct("first_on_demand", "availability").alias("aws_attributes"))
    return paged(c, "cluster_id", item, "clusters", ENDPOINTS["clusters"])


def _warehouses(fx: Fixtures) -> DataFrame:
    w = fx.warehouses
    item = F.struct(F.col("warehouse_id").alias("id"), "name", "state", "warehouse_type",
                    "enable_serverless_compute", "max_num_clusters", "auto_stop_mins", "enable_photon")
    return paged(w, "warehouse_id", item, "warehouses", ENDPOINTS["warehouses"])


def _jobs(fx: Fixtures) -> DataFrame:
    j = fx.jobs
    settings = F.struct(
        F.col("name").alias("name"),
        F.when(F.col("has_git_source"), F.create_map(F.lit("git_url"), F.lit("https://git.example/repo")))
        .alias("git_source"),
        F.col("max_retries").alias("max_retries"),
        F.when(F.col("has_job_clusters"), F.array(F.create_map(F.lit("job_cluster_key"), F.lit("main"))))
        .alias("job_clusters"))
    item = F.struct("job_id", "creator_user_name", settings.alias("settings"))
    return paged(j, "job_id", item, "jobs", ENDPOINTS["jobs"])


def _pipelines(fx: Fixtures) -> DataFrame:
    p = fx.pipelines
    item = F.struct("pipeline_id", "name", "state")
    even = paged(p.where(F.col(WS) % 2 == 0), "pipeline_id", item, "statuses", ENDPOINTS["pipelines"])
    odd = paged(p.where(F.col(WS) % 2 == 1), "pipeline_id", item, "pipelines", ENDPOINTS["pipelines"])
    return even.unionByName(odd)


def _catalogs(fx: Fixtures) -> DataFrame:
    c = fx.catalogs
    odd = F.col(WS) % 2 == 1
    item = F.struct(
        F.col("catalog_name").alias("name"),
        F.when(~odd, F.col("isolation_mode")).alias("isolation_mode"),
        F.when(odd, F.create_map(F.lit("isolation_mode"), F.col("isolation_mode"))).alias("properties"),
        F.when(~odd, F.col("owner")).alias("owner"),
        F.when(odd, F.col("owner")).alias("owner_id"))
    return paged(c, "catalog_name", item, "catalogs", ENDPOINTS["catalogs"])


def _scim(fx: Fixtures) -> DataFrame:
    g = fx.scim_groups
    gi = F.struct(F.col("display_name").alias("displayName"), F.col("external_id").alias("externalId"))
    gn = g.groupBy(WS).agg(F.count(F.lit(1)).alias("_total"))
    groups = paged(g.join(gn, on=WS), "display_name", gi, "Resources", ENDPOINTS["scim_groups"],
                   extra={"totalResults": F.col("_total")})
    s = fx.service_principals
    si = F.struct(F.col("display_name").alias("displayName"), F.col("application_id").alias("applicationId"))
    sn = s.groupBy(WS).agg(F.count(F.lit(1)).alias("_total"))
    sps = paged(s.join(sn, on=WS), "application_id", si, "Resources", ENDPOINTS["service_principals"],
                extra={"totalResults": F.col("_total")})
    return groups.unionByName(sps)


def _settings(fx: Fixtures) -> DataFrame:
    s = fx.settings
    return (s.groupBy(WS).agg(F.map_from_entries(F.collect_list(F.struct("setting", "value"))).alias("m"))
            .select(WS, F.lit(ENDPOINTS["settings"]).alias("endpoint"), F.lit(0).alias("page"),
                    F.to_json("m").alias("body")))


def _metastore(fx: Fixtures) -> DataFrame:
    w = fx.workspaces  # null fields are left out of the JSON, as the API does
    body = F.to_json(F.struct(F.col("metastore_name").alias("name"), F.col("metastore_owner").alias("owner"),
                              "delta_sharing_scope"))
    return w.select(WS, F.lit(ENDPOINTS["metastore"]).alias("endpoint"), F.lit(0).alias("page"), body.alias("body"))


def _object_kind_items(kind: str, i: Column) -> Column:
    name = F.concat(F.lit(kind + "-"), i.cast("string"))
    if kind == "token":
        return F.struct(name.alias("token_id"))
    if kind == "workspace_object":
        return F.struct(
            F.concat(F.lit("/Users/u/"), F.when(i % 5 == 0, F.lit("Untitled Notebook ")).otherwise(F.lit("nb_")),
                     i.cast("string")).alias("path"),
            F.when(i % 7 == 0, F.lit(None)).when(i % 3 == 0, F.lit("NOTEBOOK")).when(i % 3 == 1, F.lit("DIRECTORY"))
            .otherwise(F.lit("FILE")).alias("object_type"),
            F.lit("PYTHON").alias("language"))
    if kind == "group":
        return name
    if kind == "init_script":
        return F.struct(name.alias("name"), (i % 2 == 0).alias("enabled"))
    return F.struct(name.alias("name"))


def _object_lists(fx: Fixtures, page_size: int = 100) -> DataFrame:
    """All count-only lists in one pass: items of every kind are rendered to JSON,
    paged by hash within (workspace, kind), and each page's body is assembled as
    text, so the twelve endpoints share one shuffle."""
    from fleetgrade.sources.inventory import COUNT_LISTS
    kinds = [k for k, _p, _l in COUNT_LISTS]
    oc = fx.object_counts.where((F.col("n") > 0) & F.col("kind").isin(*kinds))
    kind_col = F.col("kind")
    endpoint = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    item = F.lit(None).cast("string")
    i = F.col("i")
    for kind, pk, keys in COUNT_LISTS:
        k = F.lit(keys) if isinstance(keys, str) else F.when(F.col(WS) % 2 == 0, F.lit(keys[0])).otherwise(F.lit(keys[1]))
        it = _object_kind_items(kind, i)
        js = F.to_json(it) if kind != "group" else F.to_json(F.array(it)).substr(F.lit(2), F.length(F.to_json(F.array(it))) - 2)
        endpoint = F.when(kind_col == kind, F.lit(ENDPOINTS[pk])).otherwise(endpoint)
        key = F.when(kind_col == kind, k).otherwise(key)
        item = F.when(kind_col == kind, js).otherwise(item)
    rows = oc.select(WS, "kind", "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    rows = rows.select(WS, endpoint.alias("endpoint"), key.alias("list_key"), item.alias("item"),
                       F.pmod(F.xxhash64(F.col("i")), F.ceil(F.col("n") / page_size)).cast("int").alias("page"))
    pages_ = rows.groupBy(WS, "endpoint", "list_key", "page").agg(F.collect_list("item").alias("items"))
    body = F.concat(F.lit('{"'), F.col("list_key"), F.lit('":['), F.array_join("items", ","), F.lit("]}"))
    return pages_.select(WS, "endpoint", "page", body.alias("body"))


LANDERS = {
    "clusters": _clusters, "warehouses": _warehouses, "jobs": _jobs, "pipelines": _pipelines,
    "catalogs": _catalogs, "scim": _scim, "settings": _settings, "metastore": _metastore,
    "object_lists": _object_lists,
}


_LANDED: dict[tuple[str, str], DataFrame] = {}


def landed(spark, sf_dir: str) -> DataFrame:
    """All payload pages of ``sf_dir`` as a written table (what the collector
    leaves behind), landed once per application in the checkpoint folder."""
    from fleetgrade.session import app_id, cut_lineage
    key = (app_id(spark), sf_dir)
    if key not in _LANDED:
        # Partitioned by endpoint: each normalizer reads only its own pages.
        _LANDED[key] = cut_lineage(land(spark, sf_dir), "payloads", partition_by=["endpoint"])
    return _LANDED[key]


def land(spark, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    parts = [LANDERS[k](fx) for k in (kinds or list(LANDERS))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
