"""Operational and inventory tables as projection views over the test tables.

The view texts are the input mapping documented in FIXTURES.md; they are plain
SQL that runs unchanged in Spark and in DuckDB, so the Spark queries and the SQL
oracle read identical inputs. Production runs read the real tables instead (same
column names; nested ``usage_metadata``, ``response`` and ``autoscale`` structs
are accepted by the operators as well as the flat fixture columns).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetgrade.session import app_id
from fleetgrade.sources.testdata import register_raw

FIXTURE_SQL: dict[str, str] = {
    "usage": """
select case when l_orderkey % 3 = 1 then 3 else l_partkey % (select count(*) from supplier) end as workspace_id,
       cast(l_shipdate as date) as usage_date,
       concat(l_returnflag, '_', l_linestatus, '_', cast(l_orderkey % 11 as string)) as sku_name,
       l_quantity as usage_quantity,
       case when l_linenumber = 7 then null
            else concat('c', cast(l_orderkey % 53 as string)) end as usage_cluster_id
from lineitem""",
    "cluster_timeline": """
select case when l_orderkey % 3 = 1 then 3 else l_partkey % (select count(*) from supplier) end as workspace_id,
       concat('c', cast(l_orderkey % 53 as string)) as cluster_id,
       concat('cluster_', cast(l_orderkey % 53 as string)) as cluster_name,
       case l_returnflag when 'A' then 'RUNNING' when 'N' then 'TERMINATED' else 'PENDING' end as state,
       cast(floor(l_extendedprice * 100) as bigint) as duration_ms,
       l_shipdate as change_time
from lineitem""",
    "job_runs": """
select case when o_orderkey % 2 = 1 then 3 else o_custkey % (select count(*) from supplier) end as workspace_id,
       case when o_orderkey % 3 = 0 then 5 else o_orderkey % 61 end as job_id,
       concat('c', cast(o_orderkey % 31 as string)) as cluster_id,
       o_orderdate as period_start_time,
       case when o_orderstatus = 'F' and o_orderpriority like '1%' then 'FAILED'
            when o_orderstatus = 'F' and o_orderpriority like '2%' then 'TIMEDOUT'
            when o_orderstatus = 'F' and o_orderpriority like '3%' then 'INTERNAL_ERROR'
            when o_orderstatus = 'P' and o_orderpriority like '5%' then 'CANCELED'
            else 'SUCCESS' end as result_state
from orders""",
    "query_history": """
select case when event_id % 3 = 1 then 3 else user_id % (select count(*) from supplier) end as workspace_id,
       event_id as statement_id,
       ts as start_time,
       case event_type when 'error' then 'FAILED' when 'signup' then 'CANCELED' else 'FINISHED' end as status,
       cast(floor(value * 3000) as bigint) as duration,
       case when event_id % 10 = 9 then null
            else concat('wh', cast(event_id % 17 as string), '_', cast((event_id % 7) % 3 as string)) end as warehouse_id
from events""",
    "audit": """
select case when event_id % 3 = 1 then 3 else user_id % (select count(*) from supplier) end as workspace_id,
       cast(ts as date) as event_date,
       ts as event_time,
       case event_type when 'click' then 'login' when 'view' then 'changePermissions'
                       when 'purchase' then 'tokenLogin' when 'signup' then 'grantPermission'
                       else concat('commandSubmit', cast(event_id % 41 as string)) end as action_name,
       case when cast(regexp_extract(props, '[0-9]+', 0) as int) < 80 then 200
            when cast(regexp_extract(props, '[0-9]+', 0) as int) < 90 then 401
            else 403 end as response_status_code
from events""",
    "workspaces": """
select s_suppkey as workspace_id,
       concat('https://ws', cast(s_suppkey as string),
              case s_suppkey % 5 when 0 then '.cloud.databricks.com' when 1 then '.azuredatabricks.net'
                                 when 2 then '.gcp.databricks.com' when 3 then '.databricks.com'
                                 else '.example.com' end) as host,
       case when s_suppkey = 9 then null else concat('ms_', cast(s_nationkey as string)) end as metastore_name,
       case s_suppkey % 3 when 0 then 'account users' when 1 then 'platform-admins' else null end as metastore_owner,
       case s_suppkey % 3 when 0 then 'INTERNAL_AND_EXTERNAL' when 1 then 'INTERNAL' else null end as delta_sharing_scope
from supplier""",
    "catalogs": """
select n_nationkey % (select count(*) - 1 from supplier) as workspace_id,
       n_name as catalog_name,
       case when n_nationkey % 2 = 0 then 'OPEN' else 'ISOLATED' end as isolation_mode,
       concat('owner_', cast(n_regionkey as string)) as owner
from nation""",
    "clusters": """
select p_partkey % (select count(*) - 1 from supplier) as workspace_id,
       concat('k', cast(p_partkey as string)) as cluster_id,
       p_name as cluster_name,
       case when p_partkey % 9 <> 4 and p_size % 10 = 0 then 'RUNNING' else 'TERMINATED' end as state,
       case when p_partkey % 9 in (0, 3, 6) and p_size % 4 = 0 then p_size % 16 + 1 end as autoscale_max_workers,
       case when p_partkey % 9 = 8 then 0 else p_size % 8 end as num_workers,
       case p_type when 'ECONOMY' then 'm6g.xlarge' when 'SMALL' then 'm5.large' when 'MEDIUM' then 'Standard_D4s'
                   when 'PROMO' then 't2d-standard-4'
                   else case when p_partkey % 9 < 3 then 'Standard_NC6_gpu' else 'i3.2xlarge' end end as node_type_id,
       case when p_partkey % 9 in (1, 2) and p_size > 25 then 'PHOTON' else 'STANDARD' end as runtime_engine,
       concat(cast(case when p_partkey % 9 < 6 then 10 + p_size % 8 else 10 + p_size % 3 end as string), '.3.x-scala2.12') as spark_version,
       case when p_partkey % 9 = 5 then null when p_size % 5 = 0 then 0 else p_size * 2 end as auto_termination_minutes,
       case when p_partkey % 9 in (2, 4) then p_size % 3 else 0 end as custom_tag_count,
       case when p_partkey % 9 = 0 then 'USER_ISOLATION' when p_partkey % 9 = 1 then 'SINGLE_USER'
            when p_partkey % 9 = 2 and p_size > 10 then 'STANDARD' else null end as data_security_mode,
       case when p_partkey % 9 in (0, 5) and p_size > 40 then 'SPOT_WITH_FALLBACK' else 'ON_DEMAND' end as availability,
       case when p_partkey % 9 = 6 and p_size = 1 then 0 else 1 end as first_on_demand
from part""",
    "warehouses": """
select c_custkey % (select count(*) - 1 from supplier) as workspace_id,
       concat('wh', cast(c_custkey as string)) as warehouse_id,
       c_name as name,
       case when c_nationkey % 3 = 0 then 'RUNNING' else 'STOPPED' end as state,
       case when c_custkey % 9 in (0, 1) and c_mktsegment = 'BUILDING' then 'PRO' else 'CLASSIC' end as warehouse_type,
       case when c_custkey % 9 in (2, 3) and c_acctbal < 0 then true else false end as enable_serverless_compute,
       case when c_custkey % 9 in (4, 5) then c_nationkey % 4 else 1 end as max_num_clusters,
       case when c_custkey % 9 = 7 then 0 else c_nationkey end as auto_stop_mins,
       case when c_custkey % 9 in (0, 6) and c_nationkey > 12 then true else false end as enable_photon
from customer""",
    "jobs": """
select o_orderkey % (select count(*) - 1 from supplier) as workspace_id,
       o_orderkey as job_id,
       concat(case when o_orderkey % 9 in (0, 1) and o_orderpriority like '1%' then '[DAB] '
                   when o_orderkey % 9 = 2 and o_orderpriority like '2%' then '[dev x] '
                   when o_orderkey % 9 = 3 and o_orderpriority like '3%' then 'dabs-' else '' end,
              'job-', cast(o_orderkey as string)) as name,
       case when o_orderkey % 9 in (0, 1, 4) and o_orderstatus = 'F' then true else false end as has_git_source,
       case when o_orderkey % 9 in (2, 5) then o_custkey % 3 else null end as max_retries,
       case when o_orderkey % 9 in (0, 6) and o_orderstatus = 'O' then true else false end as has_job_clusters,
       case when o_orderkey % 9 = 1 then concat('SP-', cast(o_custkey % 4 as string), '-runner')
            else concat('user', cast(o_custkey as string), '@example.com') end as creator_user_name
from orders""",
    "pipelines": """
select p_partkey % (select count(*) - 1 from supplier) as workspace_id,
       concat('p', cast(p_partkey as string)) as pipeline_id,
       case when p_partkey % 7 = 2 and p_size = 50 then concat('lakeflow-connect-', p_name) else p_name end as name,
       case when p_partkey % 7 in (0, 1) and p_size = 49 then 'FAILED' else 'IDLE' end as state
from part""",
    "service_principals": """
select c_custkey % (select count(*) - 1 from supplier) as workspace_id,
       concat('sp-', cast(c_custkey % 4 as string)) as display_name,
       concat('app', cast(c_custkey as string)) as application_id
from customer""",
    "scim_groups": """
select c_custkey % (select count(*) - 1 from supplier) as workspace_id,
       concat('grp', cast(c_custkey as string)) as display_name,
       case when c_custkey % 6 in (0, 1) or c_custkey = 2 then concat('ext', cast(c_custkey as string)) end as external_id
from customer""",
    "settings": """
select s_suppkey as workspace_id, k.setting as setting,
       case k.setting when 'enableDbfsFileBrowser' then case when s_suppkey % 2 = 0 then 'false' else 'true' end
                      when 'enableIpAccessLists' then case when s_suppkey % 3 = 0 then 'true' else 'false' end
                      when 'maxTokenLifetimeDays' then cast((s_suppkey % 4 + 1) * 30 as string)
                      else 'true' end as value
from supplier
cross join (select 'enableDbfsFileBrowser' as setting union all select 'enableResultsDownloading'
            union all select 'enableExportNotebook' union all select 'maxTokenLifetimeDays'
            union all select 'enableIpAccessLists') k""",
    "object_counts": """
select workspace_id, d.kind as kind,
       cast(case d.kind when 'untitled_notebook' then floor(n / 5) when 'disabled_init_script' then floor((n + 1) / 2) else n end as bigint) as n
from (
select s_suppkey as workspace_id, k.kind as base,
       (s_suppkey * k.mult) % k.modulus as n
from supplier
cross join (select 'policy' as kind, 5 as mult, 31 as modulus union all select 'pool', 3, 7
            union all select 'endpoint', 1, 4 union all select 'repo', 2, 5
            union all select 'init_script', 1, 3 union all select 'group', 7, 11
            union all select 'scope', 1, 2 union all select 'ip_access_list', 1, 3
            union all select 'token', 4, 9 union all select 'external_location', 11, 60
            union all select 'storage_credential', 13, 61 union all select 'workspace_object', 17, 97) k) b
cross join (select 'untitled_notebook' as kind, 'workspace_object' as base union all select 'disabled_init_script', 'init_script'
            union all select 'policy', 'policy' union all select 'pool', 'pool' union all select 'endpoint', 'endpoint'
            union all select 'repo', 'repo' union all select 'init_script', 'init_script' union all select 'group', 'group'
            union all select 'scope', 'scope' union all select 'ip_access_list', 'ip_access_list' union all select 'token', 'token'
            union all select 'external_location', 'external_location' union all select 'storage_credential', 'storage_credential'
            union all select 'workspace_object', 'workspace_object') d
where d.base = b.base""",
    # Call log of the collection step (FIXTURES section 3): one call per event.
    "call_log": """
select case when event_id % 3 = 1 then 3 else user_id % (select count(*) from supplier) end as workspace_id,
       event_id as seq,
       concat('collector_', event_type) as collector,
       case when event_id % 5 = 2 then 'api post /api/2.0/sql/statements --json {}'
            else concat('api get /api/2.0/', event_type) end as command_text,
       case when event_id % 7 = 3 then repeat(props, 300) else props end as output,
       value as duration_seconds,
       event_type <> 'error' as success,
       case when event_type = 'error' then 'call failed' end as error
from events""",
}

# Spark-side texts of the two views that FIXTURES.md writes as a cross join with
# a constant list: the same rows, generated per supplier row by ``inline`` over
# a literal array, so no plan contains a cartesian product.
SPARK_SQL: dict[str, str] = {
    "settings": """
select s_suppkey as workspace_id, k.setting as setting,
       case k.setting when 'enableDbfsFileBrowser' then case when s_suppkey % 2 = 0 then 'false' else 'true' end
                      when 'enableIpAccessLists' then case when s_suppkey % 3 = 0 then 'true' else 'false' end
                      when 'maxTokenLifetimeDays' then cast((s_suppkey % 4 + 1) * 30 as string)
                      else 'true' end as value
from supplier
lateral view inline(array(named_struct('setting', 'enableDbfsFileBrowser'),
                          named_struct('setting', 'enableResultsDownloading'),
                          named_struct('setting', 'enableExportNotebook'),
                          named_struct('setting', 'maxTokenLifetimeDays'),
                          named_struct('setting', 'enableIpAccessLists'))) k""",
    "object_counts": """
select workspace_id, d.kind as kind, d.n as n from (
select s_suppkey as workspace_id, k.kind as base,
       cast((s_suppkey * k.mult) % k.modulus as bigint) as n
from supplier
lateral view inline(array(named_struct('kind', 'policy', 'mult', 5, 'modulus', 31),
                          named_struct('kind', 'pool', 'mult', 3, 'modulus', 7),
                          named_struct('kind', 'endpoint', 'mult', 1, 'modulus', 4),
                          named_struct('kind', 'repo', 'mult', 2, 'modulus', 5),
                          named_struct('kind', 'init_script', 'mult', 1, 'modulus', 3),
                          named_struct('kind', 'group', 'mult', 7, 'modulus', 11),
                          named_struct('kind', 'scope', 'mult', 1, 'modulus', 2),
                          named_struct('kind', 'ip_access_list', 'mult', 1, 'modulus', 3),
                          named_struct('kind', 'token', 'mult', 4, 'modulus', 9),
                          named_struct('kind', 'external_location', 'mult', 11, 'modulus', 60),
                          named_struct('kind', 'storage_credential', 'mult', 13, 'modulus', 61),
                          named_struct('kind', 'workspace_object', 'mult', 17, 'modulus', 97))) k) b
lateral view inline(filter(array(named_struct('kind', base, 'n', n),
                                 named_struct('kind', case base when 'workspace_object' then 'untitled_notebook'
                                                                when 'init_script' then 'disabled_init_script' end,
                                              'n', cast(case base when 'workspace_object' then floor(n / 5) else floor((n + 1) / 2) end as bigint))),
                           x -> x.kind is not null)) d""",
}

_RAW_REF = re.compile(r"\bfrom\s+(\w+)", re.IGNORECASE)


def _raw_tables(sql: str) -> list[str]:
    return sorted({t for t in _RAW_REF.findall(sql) if t != "select"})


# Analysed fixture plans per (application, directory, view): building a view
# reads parquet footers and analyses SQL, which is worth doing once. Only the
# lazy plan is kept; no data is cached.
_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Return fixture ``name`` read from the parquet tables under ``sf_dir``."""
    key = (app_id(spark), sf_dir, name)
    if key not in _PLANS:
        sql = SPARK_SQL.get(name, FIXTURE_SQL[name])
        register_raw(spark, sf_dir, _raw_tables(sql))
        _PLANS[key] = spark.sql(sql)
    return _PLANS[key]


class Fixtures:
    """Lazy accessor: ``Fixtures(spark, sf_dir).usage`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURE_SQL:
            raise AttributeError(name)
        return fixture(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


def with_views(names, body: str) -> str:
    """SQL text that defines the named fixture views as CTEs ahead of ``body``."""
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]}\n)" for n in names)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
