"""S2 + N1-N23: configuration payloads -> inventory tables.

Collected API responses are landed as a table ``(workspace_id, endpoint, page,
body)`` with one row per response page. Each normalizer parses its endpoint's
pages with an explicit schema (never inference), explodes the item list, and
resolves the alternate keys the API uses. Malformed bodies are kept as "not ok"
rows instead of failing the job, and list members that are not objects count
toward totals but yield no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = "workspace_id"

# API paths of the inventory calls.
ENDPOINTS = {
    "current_user": "/api/2.0/preview/scim/v2/Me",
    "metastore": "/api/2.1/unity-catalog/metastore_summary",
    "catalogs": "/api/2.1/unity-catalog/catalogs",
    "external_locations": "/api/2.1/unity-catalog/external-locations",
    "storage_credentials": "/api/2.1/unity-catalog/storage-credentials",
    "clusters": "/api/2.1/clusters/list",
    "warehouses": "/api/2.0/sql/warehouses",
    "policies": "/api/2.0/cluster-policies/list",
    "pools": "/api/2.0/instance-pools/list",
    "settings": "/api/2.0/workspace-conf",
    "ip_access_lists": "/api/2.0/ip-access-lists",
    "tokens": "/api/2.0/token/list",
    "service_principals": "/api/2.0/preview/scim/v2/ServicePrincipals",
    "scim_groups": "/api/2.0/preview/scim/v2/Groups",
    "jobs": "/api/2.1/jobs/list",
    "pipelines": "/api/2.0/pipelines",
    "endpoints": "/api/2.0/serving-endpoints",
    "repos": "/api/2.0/repos",
    "init_scripts": "/api/2.0/global-init-scripts",
    "groups": "/api/2.0/groups/list",
    "scopes": "/api/2.0/secrets/list-scopes",
    "workspace_objects": "/api/2.0/workspace/list",
}

PAYLOAD_SCHEMA = T.StructType([
    T.StructField(WS, T.LongType()), T.StructField("endpoint", T.StringType()),
    T.StructField("page", T.IntegerType()), T.StructField("body", T.StringType()),
])

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _arr(*fields) -> T.ArrayType:
    return T.ArrayType(_st(*fields))


NAMED = _arr(("name", S))

SCHEMAS = {
    "current_user": _st(("userName", S), ("display_name", S), ("user_name", S),
                        # Lists or single values: kept as JSON text and read by ``identity``.
                        ("groups", S), ("group_names", S), ("roles", S), ("role_names", S)),
    "metastore": _st(("name", S), ("owner", S), ("delta_sharing_scope", S)),
    "catalogs": _st(("catalogs", _arr(("name", S), ("isolation_mode", S), ("owner", S), ("owner_id", S),
                                      ("properties", T.MapType(S, S))))),
    "external_locations": _st(("external_locations", NAMED)),
    "storage_credentials": _st(("storage_credentials", NAMED)),
    "clusters": _st(("clusters", _arr(
        ("cluster_id", S), ("cluster_name", S), ("state", S),
        ("autoscale", _st(("min_workers", I), ("max_workers", I))), ("num_workers", I),
        ("node_type_id", S), ("driver_node_type_id", S), ("runtime_engine", S), ("spark_version", S),
        ("auto_termination_minutes", I), ("policy_id", S), ("custom_tags", T.MapType(S, S)),
        ("cluster_source", S), ("data_security_mode", S),
        ("aws_attributes", _st(("first_on_demand", I), ("availability", S), ("spot_bid_price_percent", I)))))),
    "warehouses": _st(("warehouses", _arr(
        ("id", S), ("name", S), ("size", S), ("state", S), ("warehouse_type", S),
        ("enable_serverless_compute", B), ("auto_stop_mins", I), ("max_num_clusters", I),
        ("min_num_clusters", I), ("cluster_size", S), ("enable_photon", B), ("channel", T.MapType(S, S))))),
    "policies": _st(("policies", NAMED)),
    "pools": _st(("instance_pools", _arr(("instance_pool_name", S), ("name", S), ("node_type_id", S)))),
    "settings": T.MapType(S, S),
    "ip_access_lists": _st(("ip_access_lists", _arr(("label", S), ("list_type", S), ("enabled", B)))),
    "tokens": _st(("token_infos", _arr(("token_id", S), ("id", S))), ("tokens", _arr(("token_id", S), ("id", S)))),
    "service_principals": _st(("totalResults", L), ("Resources", _arr(
        ("displayName", S), ("applicationId", S), ("active", B)))),
    "scim_groups": _st(("totalResults", L), ("Resources", _arr(("displayName", S), ("externalId", S), ("id", S)))),
    "jobs": _st(("jobs", _arr(
        ("job_id", L), ("creator_user_name", S), ("job_name", S), ("name", S), ("job_type", S), ("git_source", T.MapType(S, S)),
        ("max_retries", I), ("existing_cluster_id", S),
        ("settings", _st(("name", S), ("job_type", S), ("git_source", T.MapType(S, S)), ("max_retries", I),
                         ("existing_cluster_id", S), ("job_clusters", T.ArrayType(T.MapType(S, S)))))))),
    "pipelines": _st(("statuses", _arr(("pipeline_id", S), ("name", S), ("state", S), ("creator_user_name", S))),
                     ("pipelines", _arr(("pipeline_id", S), ("name", S), ("state", S), ("creator_user_name", S)))),
    "endpoints": _st(("endpoints", _arr(("name", S), ("state", T.MapType(S, S))))),
    "repos": _st(("repos", _arr(("id", L), ("path", S)))),
    "init_scripts": _st(("scripts", _arr(("name", S), ("enabled", B), ("script_id", S)))),
    "groups": _st(("group_names", T.ArrayType(S)), ("groups", T.ArrayType(S))),
    "scopes": _st(("scopes", NAMED)),
    "workspace_objects": _st(("objects", _arr(("path", S), ("object_type", S), ("language", S)))),
}


def _raw(schema: T.DataType) -> T.DataType:
    """The page schema with every list of objects read as raw JSON strings.

    A list that mixes objects with other members would make the whole page a
    bad record under a typed schema; read raw, the members survive, non-objects
    still count toward totals, and only objects are parsed as items.
    """
    if not isinstance(schema, T.StructType):
        return schema
    return T.StructType([
        T.StructField(f.name, T.ArrayType(T.StringType())
                      if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
                      else f.dataType) for f in schema.fields])


def _element(kind: str, key: str) -> T.StructType:
    return SCHEMAS[kind][key].dataType.elementType


def pages(payloads: DataFrame, kind: str) -> DataFrame:
    """Parsed pages of one endpoint: ``workspace_id, page, ok, doc``.

    ``ok`` is false for a body that is not a JSON object of the expected shape
    (the collector's "call failed"), true otherwise. Lists of objects in ``doc``
    hold raw JSON members (see ``_raw``).
    """
    path = ENDPOINTS[kind]
    # Calls are logged with their query string (``?count=100``); the path alone names the kind.
    p = payloads.where(F.col("endpoint").startswith(path) & (F.substring_index("endpoint", "?", 1) == path))
    parsed = F.from_json(F.col("body"), _raw(SCHEMAS[kind]), {"mode": "PERMISSIVE"})
    looks_like_object = F.col("body").rlike(r"^\s*\{") & F.col("body").rlike(r"\}\s*$")
    return p.select(WS, "page", parsed.alias("doc"), looks_like_object.alias("_obj")).select(
        WS, "page", (F.col("doc").isNotNull() & F.col("_obj")).alias("ok"), "doc")


def unknown_endpoints(payloads: DataFrame) -> DataFrame:
    """Landed endpoints that no table reads, with their pages, so that nothing vanishes in silence."""
    path = F.substring_index("endpoint", "?", 1)
    return (payloads.where(~path.isin(sorted(set(ENDPOINTS.values())))).groupBy(path.alias("endpoint"))
            .agg(F.count("*").alias("pages"), F.count_distinct(WS).alias("workspaces")))


def _nonempty(arr: Column) -> Column:
    return F.when(F.size(F.coalesce(arr, F.array())) > 0, arr)


def _list(keys: list[str]) -> Column:
    """First non-empty list among ``keys`` (raw members), else empty."""
    return F.coalesce(*[_nonempty(F.col(f"doc.{k}")) for k in keys], F.array())


def _objects(lst: Column) -> Column:
    return F.filter(lst, lambda x: F.ltrim(x).startswith("{"))


def _typed(member: Column, kind: T.DataType, path: str = "$") -> Column:
    """A field of a parsed member in its type, wherever its value can be read as one.

    A number or flag sent as text, or a whole number sent with a fraction of 0, is read; a
    value that is none of the type is NULL, and only that field.
    """
    if isinstance(kind, T.StructType):
        whole = F.try_variant_get(member, path, "variant")
        parts = F.struct(*[_typed(member, f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind.fields])
        return F.when(whole.isNotNull() & ~F.is_variant_null(whole), parts)
    return F.try_variant_get(member, path, kind.simpleString())


def _members(kind: str, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Object members of a list as VARIANT, dropping members that are not objects."""
    pg = pages(payloads, kind).where("ok")
    raw = pg.select(WS, "page", F.explode(_objects(_list(keys))).alias("_raw"))
    return raw.select(WS, "page", F.try_parse_json("_raw").alias("_v")).where("_v is not null")


def _items(kind: str, payloads: DataFrame, keys: str | list[str]) -> DataFrame:
    """The item list as objects of the endpoint's fields, read field by field."""
    keys = [keys] if isinstance(keys, str) else keys
    return _members(kind, payloads, keys).select(WS, "page", _typed(F.col("_v"), _element(kind, keys[0])).alias("it"))


def rejected_fields(payloads: DataFrame, kind: str, keys: str | list[str]) -> DataFrame:
    """Values that are there but cannot be read in their field's type: ``workspace_id, kind, page, field, value``."""
    keys = [keys] if isinstance(keys, str) else keys

    def leaves(t: T.StructType, path: str):
        for f in t.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{path}.{f.name}")
            else:
                yield f"{path}.{f.name}", f.dataType

    v = F.col("_v")
    checks = []
    for path, t in leaves(_element(kind, keys[0]), "$"):
        there = F.try_variant_get(v, path, "variant")
        bad = there.isNotNull() & ~F.is_variant_null(there) & F.try_variant_get(v, path, t.simpleString()).isNull()
        checks.append(F.when(bad, F.struct(F.lit(path[2:]).alias("field"), F.to_json(there).alias("value"))))
    return _members(kind, payloads, keys).select(WS, F.lit(kind).alias("kind"), "page", F.explode(F.array(*checks)).alias("r")).where(
        "r is not null").select(WS, "kind", "page", "r.*")


# --- N1 / N2 -------------------------------------------------------------------------------------------

def identity(payloads: DataFrame) -> DataFrame:
    """User name and groups/roles with alternate keys; scalars become one-element lists."""
    d = pages(payloads, "current_user").where("ok")
    named = [F.when(F.col(f"doc.{k}") != "", F.col(f"doc.{k}")) for k in ("userName", "display_name", "user_name")]

    def listed(key: str) -> Column:
        text = F.ltrim(F.col(f"doc.{key}"))
        return F.when(text.startswith("["), _nonempty(F.from_json(text, T.ArrayType(S)))).when(text != "", F.array(text))

    none = F.array().cast("array<string>")
    return d.select(WS, F.coalesce(*named).alias("user"), F.coalesce(listed("groups"), listed("group_names"), none).alias("groups"),
                    F.coalesce(listed("roles"), listed("role_names"), none).alias("roles"))


def auth_user(cli_output: DataFrame, text_col: str = "output") -> DataFrame:
    """The user named on the first ``User:`` line of the auth command's text output."""
    user = F.regexp_extract(F.col(text_col), r"(?m)^\s*User:(.*)$", 1)
    return cli_output.select(WS, F.when(user != "", F.trim(user)).alias("user"))


# --- N3-N6 --------------------------------------------------------------------------------------------

def metastore(payloads: DataFrame) -> DataFrame:
    """N3."""
    d = pages(payloads, "metastore").where("ok")
    return d.select(WS, F.col("doc.name").alias("metastore_name"), F.col("doc.owner").alias("metastore_owner"),
                    F.col("doc.delta_sharing_scope").alias("delta_sharing_scope"))


def catalogs(payloads: DataFrame) -> DataFrame:
    """Isolation mode top-level or in properties; owner or owner_id."""
    it = _items("catalogs", payloads, "catalogs")
    return it.select(
        WS, F.col("it.name").alias("catalog_name"),
        F.coalesce(F.col("it.isolation_mode"), F.col("it.properties")["isolation_mode"]).alias("isolation_mode"),
        F.coalesce(F.col("it.owner"), F.col("it.owner_id")).alias("owner"))


def catalog_facts(payloads: DataFrame) -> DataFrame:
    """N4 lists: distinct isolation modes and owners of a workspace's catalogs (small vocabularies), sorted."""
    return catalogs(payloads).groupBy(WS).agg(
        F.count(F.lit(1)).alias("catalogs"), F.sort_array(F.collect_set(F.nullif("isolation_mode", F.lit("")))).alias("isolation_modes"),
        F.sort_array(F.collect_set(F.nullif("owner", F.lit("")))).alias("owners"))


def list_names(payloads: DataFrame, kind: str, list_path: str, name_key: str = "name") -> DataFrame:
    """N9 and its like: ``workspace_id, name`` of a named list's objects."""
    return _members(kind, payloads, [list_path]).select(WS, F.try_variant_get("_v", f"$.{name_key}", "string").alias("name"))


def list_count(payloads: DataFrame, kind: str, list_path: str | list[str], name: str) -> DataFrame:
    """N5, N6, N9, N19, N21, N22 and other count-only lists: members summed over pages.

    With several candidate keys the first non-empty list of a page counts.
    """
    paths = [list_path] if isinstance(list_path, str) else list_path
    pg = pages(payloads, kind).where("ok")
    return pg.groupBy(WS).agg(F.sum(F.size(_list(paths))).cast("bigint").alias(name))


# --- N7-N10 --------------------------------------------------------------------------------------------

def clusters(payloads: DataFrame) -> DataFrame:
    """Product (nested) cluster rows; availability fields pulled up from ``aws_attributes``."""
    it = _items("clusters", payloads, "clusters")
    return it.select(
        WS, *[F.col(f"it.{c}").alias(c) for c in (
            "cluster_id", "cluster_name", "state", "autoscale", "num_workers", "node_type_id",
            "driver_node_type_id", "runtime_engine", "spark_version", "auto_termination_minutes", "policy_id",
            "custom_tags", "cluster_source", "data_security_mode")],
        F.col("it.aws_attributes.first_on_demand").alias("first_on_demand"),
        F.col("it.aws_attributes.availability").alias("availability"),
        F.col("it.aws_attributes.spot_bid_price_percent").alias("spot_bid_price_percent"))


def warehouses(payloads: DataFrame) -> DataFrame:
    """N8."""
    it = _items("warehouses", payloads, "warehouses")
    return it.select(WS, F.col("it.id").alias("warehouse_id"), *[F.col(f"it.{c}").alias(c) for c in (
        "name", "size", "state", "warehouse_type", "enable_serverless_compute", "auto_stop_mins",
        "max_num_clusters", "min_num_clusters", "cluster_size", "enable_photon", "channel")])


def instance_pools(payloads: DataFrame) -> DataFrame:
    """N10."""
    it = _items("pools", payloads, "instance_pools")
    return it.select(WS, F.coalesce(F.col("it.instance_pool_name"), F.col("it.name")).alias("name"),
                     F.col("it.node_type_id").alias("node_type_id"))


# --- N11-N15 --------------------------------------------------------------------------------------------

def settings(payloads: DataFrame) -> DataFrame:
    """The settings map in long form."""
    d = pages(payloads, "settings").where("ok")
    return d.select(WS, F.explode("doc").alias("setting", "value"))


def ip_access_lists(payloads: DataFrame) -> DataFrame:
    """N12."""
    it = _items("ip_access_lists", payloads, "ip_access_lists")
    return it.select(WS, "it.label", "it.list_type", "it.enabled")


def tokens(payloads: DataFrame, first: int = 10) -> DataFrame:
    """Token count and the first ``first`` ids (``token_infos`` else ``tokens``)."""
    d = pages(payloads, "tokens").where("ok")
    per_page = d.select(WS, "page", _list(["token_infos", "tokens"]).alias("l"))
    ids = F.transform(_objects(F.col("l")), lambda t: F.coalesce(F.get_json_object(t, "$.token_id"),
                                                               F.get_json_object(t, "$.id")))
    # Pages may hold few tokens: the first ids are taken over all pages, in page order.
    rows = per_page.select(WS, "page", F.posexplode(F.slice(ids, 1, first)).alias("pos", "id"))
    rank = F.row_number().over(Window.partitionBy(WS).orderBy("page", "pos"))
    firsts = (rows.withColumn("rank", rank).where(F.col("rank") <= first).groupBy(WS)
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("token_ids")))
    counts = per_page.groupBy(WS).agg(F.sum(F.size("l")).cast("bigint").alias("token_count"))
    return counts.join(firsts, WS, "left").select(
        WS, "token_count", F.coalesce("token_ids", F.array().cast("array<string>")).alias("token_ids"))


def _scim(payloads: DataFrame, kind: str) -> DataFrame:
    d = pages(payloads, kind).where("ok")
    res = F.coalesce(F.col("doc.Resources"), F.array())
    return d.select(WS, "page", F.col("doc.totalResults").alias("total"), res.alias("res"))


def _scim_rows(payloads: DataFrame, kind: str, cap: int | None) -> DataFrame:
    """Listed objects; with ``cap`` the first ones of each workspace, in page order."""
    rows = _scim(payloads, kind).select(WS, "page", F.posexplode(_objects(F.col("res"))).alias("pos", "_raw"))
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy(WS).orderBy("page", "pos"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= cap)
    return rows.select(WS, _typed(F.try_parse_json("_raw"), _element(kind, "Resources")).alias("r"))


def service_principals(payloads: DataFrame, list_cap: bool = False) -> DataFrame:
    """N14 rows: display name, application id, active (default true); optional cap of 50 (Q10)."""
    return _scim_rows(payloads, "service_principals", 50 if list_cap else None).select(
        WS, F.coalesce(F.col("r.displayName"), F.lit("")).alias("display_name"),
        F.col("r.applicationId").alias("application_id"),
        F.coalesce(F.col("r.active"), F.lit(True)).alias("active"))


def scim_groups(payloads: DataFrame, list_cap: bool = False) -> DataFrame:
    """N15 rows: display name and external id; optional cap of 100 (Q10)."""
    return _scim_rows(payloads, "scim_groups", 100 if list_cap else None).select(
        WS, F.col("r.displayName").alias("display_name"), F.col("r.externalId").alias("external_id"), F.col("r.id").alias("id"))


def scim_counts(payloads: DataFrame, kind: str, name: str) -> DataFrame:
    """N14/N15 counts: ``totalResults`` when present, else the listed members."""
    d = _scim(payloads, kind)
    return d.groupBy(WS).agg(
        F.coalesce(F.max("total"), F.sum(F.size("res"))).cast("bigint").alias(name))


# --- N16-N23 --------------------------------------------------------------------------------------------

def jobs(payloads: DataFrame) -> DataFrame:
    """Name from settings, then job_name, then name; fields from settings else top level."""
    it = _items("jobs", payloads, "jobs")
    s = "it.settings"
    git = F.coalesce(F.col(f"{s}.git_source"), F.col("it.git_source"))
    existing = F.coalesce(F.col(f"{s}.existing_cluster_id"), F.col("it.existing_cluster_id"))
    return it.select(
        WS, F.col("it.job_id").alias("job_id"),
        F.coalesce(F.col(f"{s}.name"), F.col("it.job_name"), F.col("it.name"), F.lit("")).alias("name"),
        (git.isNotNull() & (F.size(F.coalesce(git, F.create_map())) > 0)).alias("has_git_source"),
        F.coalesce(F.nullif(F.col(f"{s}.max_retries"), F.lit(0)), F.col("it.max_retries")).alias("max_retries"),
        (F.size(F.coalesce(F.col(f"{s}.job_clusters"), F.array())) > 0).alias("has_job_clusters"),
        (F.coalesce(existing, F.lit("")) != "").alias("has_existing_cluster_id"),
        F.coalesce(F.col("it.creator_user_name"), F.lit("")).alias("creator_user_name"),
        F.coalesce(F.nullif(F.col(f"{s}.job_type"), F.lit("")), F.col("it.job_type")).alias("job_type"))


def pipelines(payloads: DataFrame) -> DataFrame:
    """``statuses`` else ``pipelines`` (an empty list counts as missing)."""
    it = _items("pipelines", payloads, ["statuses", "pipelines"])
    return it.select(WS, "it.pipeline_id", "it.name", "it.state", "it.creator_user_name")


def serving_endpoints(payloads: DataFrame) -> DataFrame:
    """N18."""
    it = _items("endpoints", payloads, "endpoints")
    return it.select(WS, F.col("it.name").alias("name"), F.col("it.state")["ready"].alias("state"))


def init_scripts(payloads: DataFrame) -> DataFrame:
    """N20."""
    it = _items("init_scripts", payloads, "scripts")
    return it.select(WS, "it.name", "it.enabled", "it.script_id")


def workspace_objects(payloads: DataFrame) -> DataFrame:
    """N23 rows: path, type (default UNKNOWN), language."""
    it = _items("workspace_objects", payloads, "objects")
    return it.select(WS, F.coalesce(F.col("it.path"), F.lit("")).alias("path"),
                     F.coalesce(F.col("it.object_type"), F.lit("UNKNOWN")).alias("object_type"),
                     F.col("it.language").alias("language"))


def workspace_object_summary(objects: DataFrame) -> DataFrame:
    """N23 counts: objects by type and untitled notebooks, one row per (workspace, type)."""
    by_type = objects.groupBy(WS, "object_type").agg(F.count(F.lit(1)).alias("objects"))
    untitled = objects.groupBy(WS).agg(F.count_if(F.col("path").contains("Untitled")).alias("untitled"),
                                       F.count(F.lit(1)).alias("object_count"))
    return by_type.join(untitled, on=WS)


# Count-only endpoints in object_counts order (kind, payload kind, list keys).
COUNT_LISTS = (
    ("policy", "policies", "policies"), ("pool", "pools", "instance_pools"),
    ("endpoint", "endpoints", "endpoints"), ("repo", "repos", "repos"),
    ("init_script", "init_scripts", "scripts"), ("group", "groups", ["group_names", "groups"]),
    ("scope", "scopes", "scopes"), ("ip_access_list", "ip_access_lists", "ip_access_lists"),
    ("token", "tokens", ["token_infos", "tokens"]), ("external_location", "external_locations", "external_locations"),
    ("storage_credential", "storage_credentials", "storage_credentials"),
    ("workspace_object", "workspace_objects", "objects"),
)


def object_counts(payloads: DataFrame) -> DataFrame:
    """Long ``(workspace_id, kind, n)`` counts of the small lists (feeds F26), in one pass over their pages.

    Two further kinds count members by what they hold: untitled notebooks and init scripts that
    are off; they have a row where there is one.
    """
    path = F.substring_index("endpoint", "?", 1)
    kinds = {ENDPOINTS[pk]: (kind, [keys] if isinstance(keys, str) else keys) for kind, pk, keys in COUNT_LISTS}
    body, doc = F.trim("body"), F.col("_doc")
    rows = (payloads.where(path.isin(sorted(kinds))).select(WS, path.alias("_path"), F.try_parse_json("body").alias("_doc"),
                                                            (body.startswith("{") & body.endswith("}")).alias("_obj"))
            .where(doc.isNotNull() & F.col("_obj")))
    of, kind = F.lit(None).cast("array<variant>"), F.lit(None).cast("string")
    for at, (name, keys) in kinds.items():
        lists = [_nonempty(F.try_variant_get(doc, f"$.{k}", "array<variant>")) for k in keys]
        of = F.when(F.col("_path") == at, F.coalesce(*lists)).otherwise(of)
        kind = F.when(F.col("_path") == at, F.lit(name)).otherwise(kind)
    lists = rows.select(WS, kind.alias("kind"), of.alias("l"))
    members = lambda cond: F.size(F.coalesce(F.filter("l", cond), F.array().cast("array<variant>")))
    untitled = members(lambda v: F.coalesce(F.try_variant_get(v, "$.path", "string").contains("Untitled"), F.lit(False)))
    off = members(lambda v: F.coalesce(~F.try_variant_get(v, "$.enabled", "boolean"), F.lit(False)))
    some = lambda when, name, n: F.when((F.col("kind") == when) & (n > 0), F.struct(F.lit(name).alias("kind"), n.alias("n")))
    counts = F.array(F.struct(F.col("kind"), F.size(F.coalesce("l", F.array().cast("array<variant>"))).alias("n")),
                     some("workspace_object", "untitled_notebook", untitled), some("init_script", "disabled_init_script", off))
    return (lists.select(WS, F.explode(F.array_compact(counts)).alias("c")).groupBy(WS, F.col("c.kind").alias("kind"))
            .agg(F.sum("c.n").cast("bigint").alias("n")))


# Lists whose count takes every member: (feature count, payload kind, list keys).
MEMBER_LISTS = (("cluster", "clusters", ["clusters"]), ("warehouse", "warehouses", ["warehouses"]), ("job", "jobs", ["jobs"]),
                ("pipeline", "pipelines", ["statuses", "pipelines"]), ("catalog", "catalogs", ["catalogs"]),
                ("scim", "scim_groups", ["Resources"]), ("sp", "service_principals", ["Resources"]))


def unlisted_members(payloads: DataFrame) -> DataFrame:
    """Long ``(workspace_id, kind, n)``: members counted beyond the objects that become rows.

    Members that are no objects count (F1), and a SCIM answer's ``totalResults`` counts in
    place of the members listed (F24), so ``n`` is what a list's count adds to its rows.
    """
    parts = []
    for kind, pk, keys in MEMBER_LISTS:
        pg = pages(payloads, pk).where("ok").select(
            WS, F.size(_list(keys)).alias("all"), F.size(_objects(_list(keys))).alias("rows"),
            (F.col("doc.totalResults") if keys == ["Resources"] else F.lit(None).cast("long")).alias("total"))
        n = F.coalesce(F.max("total"), F.sum("all")) - F.sum("rows")
        parts.append(pg.groupBy(WS).agg(n.cast("bigint").alias("n")).select(WS, F.lit(kind).alias("kind"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n <> 0")


def inventory_tables(payloads: DataFrame, workspaces: DataFrame) -> dict[str, DataFrame]:
    """All normalized inventory tables, keyed like the feature operators expect."""
    ms = metastore(payloads)
    ws = workspaces.select(WS, "host").join(ms, on=WS, how="left")
    return {
        "workspaces": ws, "clusters": clusters(payloads), "warehouses": warehouses(payloads),
        "jobs": jobs(payloads), "pipelines": pipelines(payloads), "catalogs": catalogs(payloads),
        "scim_groups": scim_groups(payloads), "service_principals": service_principals(payloads),
        "settings": settings(payloads), "object_counts": object_counts(payloads),
        "unlisted": unlisted_members(payloads),
    }
