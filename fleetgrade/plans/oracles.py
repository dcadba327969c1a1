"""DuckDB SQL oracles for the registered queries.

Each text defines the fixture views it needs as CTEs over the raw test tables
(the same view texts the Spark side reads) and then states the metric in plain
SQL, written from the metric definitions rather than from the Spark code.
Window bounds are the fixture calendar: ``[as_of - days, as_of + 1 day)``.
"""

from __future__ import annotations

from fleetgrade.config import FIXTURE_CONFIG as CFG
from fleetgrade.sources.fixtures import with_views
from fleetgrade.sources.window import window_bounds

ORACLES: dict[str, str] = {}


def _bounds(src: str, days: int = CFG.lookback_days, ts: bool = False) -> tuple[str, str]:
    lo, hi = window_bounds(CFG.as_of_for(src), days)
    kw = "timestamp" if ts else "date"
    return f"{kw} '{lo.isoformat()}'", f"{kw} '{hi.isoformat()}'"


def _win(col: str, src: str, days: int = CFG.lookback_days, ts: bool = False) -> str:
    lo, hi = _bounds(src, days, ts)
    return f"{col} >= {lo} and {col} < {hi}"


def oracle(name: str, views: list[str], body: str) -> None:
    ORACLES[name] = with_views(views, body)


U = _win("usage_date", "usage")
CT = _win("change_time", "cluster_timeline", ts=True)
JR = _win("period_start_time", "job_runs", ts=True)
QH = _win("start_time", "query_history", ts=True)
AU = _win("event_date", "audit")

# ---- billing ---------------------------------------------------------------------------

oracle("spend_by_sku", ["usage"], f"""
select sku_name, cast(sum(usage_quantity) as double) as total_dbus,
       count(distinct workspace_id) as workspace_count
from usage where {U}
group by sku_name
order by total_dbus desc, sku_name
limit 20""")

_SKU_WS = f"""
skus as (
  select workspace_id, sku_name, cast(sum(usage_quantity) as double) as total_dbus,
         count(distinct workspace_id) as workspace_count
  from usage where {U} group by workspace_id, sku_name),
ranked as (
  select *, row_number() over (partition by workspace_id order by total_dbus desc, sku_name) as rank
  from skus)"""

oracle("spend_by_sku_ws", ["usage"], f"""
with {_SKU_WS}
select workspace_id, sku_name, total_dbus, workspace_count, rank from ranked where rank <= 20""")

oracle("total_dbus", ["usage"], f"""
with {_SKU_WS}
select workspace_id,
       sum(case when rank <= 20 then total_dbus end) as total_dbus_30d,
       sum(total_dbus) as total_dbus_all
from ranked group by workspace_id""")

oracle("daily_spend", ["usage"], f"""
select workspace_id, usage_date, cast(sum(usage_quantity) as double) as daily_dbus
from usage where {U} group by workspace_id, usage_date""")

oracle("spend_trend", ["usage"], f"""
with d as (
  select workspace_id, usage_date, cast(sum(usage_quantity) as double) as daily_dbus
  from usage where {U} group by workspace_id, usage_date),
r as (
  select *, row_number() over (partition by workspace_id order by usage_date) as ra,
            row_number() over (partition by workspace_id order by usage_date desc) as rd
  from d),
a as (
  select workspace_id, count(*) as n_days,
         sum(case when ra <= 7 then daily_dbus end) / 7.0 as first_week_avg,
         sum(case when rd <= 7 then daily_dbus end) / 7.0 as last_week_avg
  from r group by workspace_id)
select workspace_id, n_days, first_week_avg, last_week_avg,
       case when n_days >= 7 and first_week_avg > 0
            then (last_week_avg - first_week_avg) / first_week_avg * 100.0 end as trend_pct_raw,
       round_even(case when n_days >= 7 and first_week_avg > 0
            then (last_week_avg - first_week_avg) / first_week_avg * 100.0 end, 1) as trend_pct_change
from a""")

oracle("top_cost_clusters", ["usage"], f"""
with c as (
  select workspace_id, usage_cluster_id as cluster_id, cast(sum(usage_quantity) as double) as total_dbus
  from usage where {U} and usage_cluster_id is not null
  group by workspace_id, usage_cluster_id),
r as (select *, row_number() over (partition by workspace_id order by total_dbus desc, cluster_id) as rank from c)
select * from r where rank <= 10""")

# ---- compute ---------------------------------------------------------------------------

_UPTIME = f"""
up as (
  select workspace_id, cluster_id, cluster_name,
         cast(sum(case when state = 'RUNNING' then duration_ms else 0 end) as bigint) as running_ms,
         cast(sum(case when state = 'RUNNING' then duration_ms else 0 end) as double) / 3600000.0 as running_hours,
         cast(sum(duration_ms) as double) / 3600000.0 as total_hours,
         count(distinct cast(change_time as date)) as active_days
  from cluster_timeline where {CT}
  group by workspace_id, cluster_id, cluster_name),
top as (
  select *, row_number() over (partition by workspace_id
                               order by running_hours desc, cluster_id, cluster_name) as rank
  from up where running_hours > 0)"""

oracle("cluster_uptime", ["cluster_timeline"], f"""
with {_UPTIME}
select * from top where rank <= 20""")

oracle("running_hours_total", ["cluster_timeline"], f"""
with {_UPTIME}
select workspace_id,
       cast(sum(running_ms) as double) / 3600000.0 as running_hours_raw,
       round_even(cast(sum(running_ms) as double) / 3600000.0, 1) as total_running_hours_30d,
       count(*) as uptime_rows,
       max(running_hours) as max_running_hours,
       count(*) filter (running_hours > 500) as always_on_rows,
       coalesce(array_to_string((list(left(coalesce(cluster_name, cluster_id, '?'), 25) order by rank) filter (running_hours > 500))[1:3], ', '), '')
         as always_on_names,
       any_value(running_hours_all) as running_hours_all
from top join (select workspace_id, round_even(cast(sum(running_ms) as double) / 3600000.0, 1) as running_hours_all from top group by workspace_id)
     using (workspace_id)
where rank <= 20 group by workspace_id""")

_IDLE = f"""
idle as (
  select c.workspace_id, c.cluster_id, c.cluster_name,
         cast(sum(case when c.state = 'RUNNING' then c.duration_ms else 0 end) as bigint) as running_ms,
         cast(sum(case when c.state = 'RUNNING' then c.duration_ms else 0 end) as double) / 3600000.0 as running_hours
  from cluster_timeline c
  left join job_runs j
    on c.cluster_id = j.cluster_id and c.workspace_id = j.workspace_id
   and {JR.replace('period_start_time', 'j.period_start_time')}
  where {CT.replace('change_time', 'c.change_time')} and j.cluster_id is null
  group by c.workspace_id, c.cluster_id, c.cluster_name
  having cast(sum(case when c.state = 'RUNNING' then c.duration_ms else 0 end) as double) / 3600000.0 > 1),
top as (
  select *, row_number() over (partition by workspace_id
                               order by running_hours desc, cluster_id, cluster_name) as rank
  from idle)"""

oracle("idle_clusters", ["cluster_timeline", "job_runs"], f"""
with {_IDLE}
select * from top where rank <= 10""")

oracle("idle_hours_total", ["cluster_timeline", "job_runs"], f"""
with {_IDLE}
select workspace_id,
       cast(sum(running_ms) as double) / 3600000.0 as idle_hours_raw,
       round_even(cast(sum(running_ms) as double) / 3600000.0, 1) as idle_hours_30d,
       count(*) as idle_rows, array_to_string(list(left(coalesce(cluster_name, cluster_id, '?'), 30) order by rank)[1:3], ', ') as idle_names,
       any_value(idle_hours_all) as idle_hours_all
from top join (select workspace_id, round_even(cast(sum(running_ms) as double) / 3600000.0, 1) as idle_hours_all from top group by workspace_id)
     using (workspace_id)
where rank <= 10 group by workspace_id""")

# ---- query history -------------------------------------------------------------------------

_QSTATS = f"""
qs as (
  select workspace_id,
         count(*) as total_queries,
         count(*) filter (where status = 'FINISHED') as succeeded,
         count(*) filter (where status = 'FAILED') as failed,
         count(*) filter (where status = 'CANCELED') as canceled,
         avg(duration) as avg_duration_ms,
         round(quantile_cont(duration, 0.95), 2) as p95_duration_ms,
         round(quantile_cont(duration, 0.99), 2) as p99_duration_ms,
         count(*) filter (where status = 'FINISHED' and duration > 300000) as slow_query_count
  from query_history where {QH}
  group by workspace_id)"""

oracle("query_stats", ["query_history"], f"with {_QSTATS} select * from qs")

oracle("query_failure_rate", ["query_history"], f"""
with {_QSTATS}
select workspace_id, total_queries, failed,
       coalesce(cast(failed as double) / cast(total_queries as double) * 100.0, 0.0) as failure_rate_raw,
       coalesce(round_even(cast(failed as double) / cast(total_queries as double) * 100.0, 2), 0.0)
         as failure_rate_pct
from qs""")

oracle("slow_queries", ["query_history"], f"with {_QSTATS} select workspace_id, slow_query_count from qs")

oracle("warehouse_utilization", ["query_history"], f"""
with w as (
  select workspace_id, warehouse_id, count(*) as query_count, avg(duration) as avg_duration_ms,
         count(*) filter (where status = 'FAILED') as failures
  from query_history where {QH} and warehouse_id is not null
  group by workspace_id, warehouse_id),
r as (select *, row_number() over (partition by workspace_id order by query_count desc, warehouse_id) as rank from w)
select * from r where rank <= 10""")

# ---- job runs ---------------------------------------------------------------------------------

_JSTATS = f"""
js as (
  select workspace_id, count(*) as total_runs,
         count(*) filter (where result_state = 'SUCCESS') as succeeded,
         count(*) filter (where result_state in ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')) as failed,
         count(*) filter (where result_state = 'CANCELED') as canceled
  from job_runs where {JR} group by workspace_id)"""

oracle("job_run_stats", ["job_runs"], f"with {_JSTATS} select * from js")

oracle("job_success_rate", ["job_runs"], f"""
with {_JSTATS}
select workspace_id, total_runs, failed,
       coalesce(cast(total_runs - failed as double) / cast(total_runs as double) * 100.0, 0.0) as success_rate_raw,
       coalesce(round_even(cast(total_runs - failed as double) / cast(total_runs as double) * 100.0, 2), 0.0)
         as success_rate_pct
from js""")


def _failing(days: int) -> str:
    w = _win("period_start_time", "job_runs", days, ts=True)
    return f"""
with f as (
  select workspace_id, job_id, count(*) as total_runs,
         count(*) filter (where result_state in ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')) as failures
  from job_runs where {w} group by workspace_id, job_id),
r as (select *, row_number() over (partition by workspace_id order by failures desc, job_id) as rank
      from f where failures > 0)
select * from r where rank <= 10"""


oracle("top_failing_jobs", ["job_runs"], _failing(CFG.lookback_days))
oracle("top_failing_jobs_365d", ["job_runs"], _failing(365))

# ---- audit ----------------------------------------------------------------------------------------

_ACTIONS = f"""
a as (select workspace_id, action_name, count(*) as event_count
      from audit where {AU} group by workspace_id, action_name),
r as (select *, row_number() over (partition by workspace_id order by event_count desc, action_name) as rank from a)"""

oracle("audit_by_action", ["audit"], f"with {_ACTIONS} select * from r where rank <= 30")
oracle("audit_total", ["audit"], f"""
with {_ACTIONS}
select workspace_id, cast(sum(event_count) filter (rank <= 30) as bigint) as total_events_30d,
       cast(sum(event_count) as bigint) as total_events_all
from r group by workspace_id""")

oracle("failed_logins", ["audit"], f"""
select workspace_id,
       count(*) filter (where action_name in ('login', 'tokenLogin', 'aadTokenLogin')
                        and response_status_code >= 400) as failed_logins
from audit where {AU} group by workspace_id""")

oracle("permission_changes", ["audit"], f"""
select workspace_id,
       count(*) filter (where action_name in ('changePermissions', 'updatePermissions', 'changeClusterAcl',
                                              'changeDbTokenAcl', 'grantPermission', 'revokePermission'))
         as permission_changes
from audit where {AU} group by workspace_id""")

oracle("audit_summary_14d", ["audit"], f"""
select workspace_id, count(*) as events_all,
       count(*) filter (where action_name in ('login', 'tokenLogin', 'aadTokenLogin')
                        and response_status_code >= 400) as failed_logins,
       count(*) filter (where action_name in ('changePermissions', 'updatePermissions', 'changeClusterAcl',
                                              'changeDbTokenAcl', 'grantPermission', 'revokePermission'))
         as permission_changes
from audit where {_win("event_date", "audit", 14)} group by workspace_id""")

# ---- inventory features ------------------------------------------------------------------------

oracle("cloud_of_host", ["workspaces"], """
select workspace_id, host,
       case when host is null or host = '' then 'unknown'
            when regexp_matches(lower(host), '\\.azuredatabricks\\.net') then 'azure'
            when regexp_matches(lower(host), '\\.gcp\\.databricks\\.com') then 'gcp'
            when regexp_matches(lower(host), '\\.cloud\\.databricks\\.com') then 'aws'
            when regexp_matches(lower(host), '\\.databricks\\.com') then 'aws'
            else 'unknown' end as cloud
from workspaces""")

oracle("best_warehouse", ["warehouses"], """
select workspace_id, warehouse_id from (
  select workspace_id, warehouse_id,
         row_number() over (partition by workspace_id
                            order by coalesce(enable_serverless_compute, false) desc,
                                     (state = 'RUNNING') desc, warehouse_id desc) as rn
  from warehouses) where rn = 1""")

_F_CLUSTERS = """
fc as (
  select workspace_id,
         count(*) as cluster_count,
         count(*) filter (where state = 'RUNNING') as running_clusters,
         count(*) filter (where runtime_engine = 'PHOTON') as photon_clusters,
         count(*) filter (where autoscale_max_workers is not null) as autoscale_clusters,
         cast(coalesce(sum(coalesce(num_workers, 0)), 0) as bigint) as total_workers,
         cast(coalesce(max(case when coalesce(autoscale_max_workers, 0) <> 0 then autoscale_max_workers
                                when coalesce(num_workers, 0) <> 0 then num_workers else 0 end), 0) as bigint)
           as max_workers,
         count(distinct case when node_type_id <> '' then node_type_id end) as node_type_count,
         min(case when node_type_id <> '' then node_type_id end) as node_type_sample,
         count(*) filter (where state = 'RUNNING' and coalesce(auto_termination_minutes, 0) = 0)
           as running_no_autoterm,
         count(*) filter (where auto_termination_minutes > 0) as autoterm_clusters,
         count(*) filter (where custom_tag_count > 0) as tagged_clusters,
         count(*) filter (where spark_version <> '') as versioned_clusters,
         count(*) filter (where spark_version <> '' and regexp_matches(spark_version, '^1[4-9]\\.'))
           as recent_runtime_clusters,
         count(*) filter (where lower(node_type_id) like '%gpu%') as gpu_clusters,
         count(*) filter (where upper(coalesce(availability, '')) in ('SPOT', 'SPOT_WITH_FALLBACK', 'PREEMPTIBLE')
                            or first_on_demand = 0) as spot_clusters,
         count(*) filter (where upper(coalesce(data_security_mode, '')) in ('USER_ISOLATION', 'STANDARD'))
           as standard_mode_clusters,
         count(*) filter (where upper(coalesce(data_security_mode, '')) in ('SINGLE_USER', 'DEDICATED'))
           as dedicated_mode_clusters,
         count(*) filter (where upper(coalesce(data_security_mode, '')) not in
                            ('USER_ISOLATION', 'STANDARD', 'SINGLE_USER', 'DEDICATED')) as none_mode_clusters,
         count(*) filter (where node_type_id <> '' and (
             lower(node_type_id) like '%6g.%' or lower(node_type_id) like '%7g.%'
          or lower(node_type_id) like '%6gd.%' or lower(node_type_id) like '%7gd.%'
          or lower(node_type_id) like '%6gn.%' or lower(node_type_id) like '%7gn.%')) as efficient_aws,
         count(*) filter (where node_type_id <> '' and (
             lower(node_type_id) like '%dpsv5%' or lower(node_type_id) like '%dpdsv5%'
          or lower(node_type_id) like '%epsv5%' or lower(node_type_id) like '%epdsv5%'
          or lower(node_type_id) like '%dpsv6%' or lower(node_type_id) like '%standard\\_d%' escape '\\'))
           as efficient_azure,
         count(*) filter (where node_type_id <> '' and (
             lower(node_type_id) like '%t2d-%' or lower(node_type_id) like '%n2d-%'
          or lower(node_type_id) like '%t2a-%')) as efficient_gcp
  from clusters group by workspace_id)"""

_F_WAREHOUSES = """
fw as (
  select workspace_id, count(*) as warehouse_count,
         count(*) filter (where warehouse_type = 'PRO' or enable_serverless_compute) as pro_or_serverless_wh,
         count(*) filter (where coalesce(max_num_clusters, 0) > 1 or enable_serverless_compute)
           as multi_or_serverless_wh,
         count(*) filter (where coalesce(max_num_clusters, 0) > 1) as multi_cluster_wh,
         count(*) filter (where enable_photon) as photon_wh,
         count(*) filter (where coalesce(auto_stop_mins, 0) > 0) as autostop_wh,
         count(*) filter (where state = 'RUNNING') as running_wh
  from warehouses group by workspace_id)"""

_F_JOBS = """
owned as (
  select j.workspace_id, count(distinct j.job_id) as sp_owned_jobs
  from jobs j join service_principals s
    on j.workspace_id = s.workspace_id and s.display_name <> ''
   and contains(lower(j.creator_user_name), lower(s.display_name))
  group by j.workspace_id),
fj0 as (
  select workspace_id, count(*) as job_count,
         count(*) filter (where has_git_source) as git_jobs,
         count(*) filter (where coalesce(max_retries, 0) > 0) as retry_jobs,
         count(*) filter (where has_job_clusters) as job_cluster_jobs,
         count(*) filter (where contains(coalesce(name, ''), '[DAB]') or contains(coalesce(name, ''), '[dev '))
           as dab_jobs,
         count(*) filter (where contains(coalesce(name, ''), '[DAB]') or contains(lower(coalesce(name, '')), 'dabs'))
           as iac_jobs
  from jobs group by workspace_id),
fj as (
  select fj0.*, cast(coalesce(owned.sp_owned_jobs, 0) as bigint) as sp_owned_jobs
  from fj0 left join owned using (workspace_id))"""

_F_PIPELINES = """
fp as (
  select workspace_id, count(*) as pipeline_count,
         count(*) filter (where state = 'FAILED') as failed_pipelines,
         count(*) filter (where contains(lower(coalesce(name, '')), 'connect')
                            or contains(lower(coalesce(name, '')), 'gateway')) as connect_pipelines,
         cast(0 as bigint) as autoscale_pipelines
  from pipelines group by workspace_id)"""

_F_CATALOGS = """
fcat as (
  select workspace_id, count(*) as catalog_count,
         coalesce(bool_or(isolation_mode = 'OPEN'), false) as has_open_catalog
  from catalogs group by workspace_id)"""

_F_SCIM = """
fs as (
  select workspace_id, count(*) as scim_count,
         count(*) filter (where external_id <> '') as idp_synced
  from scim_groups group by workspace_id),
fsp as (select workspace_id, count(*) as sp_count from service_principals group by workspace_id)"""

_F_SETTINGS = """
fset as (
  select workspace_id, count(*) > 0 as has_settings,
         coalesce(bool_or(setting = 'enableDbfsFileBrowser' and lower(value) = 'false'), false) as dbfs_off,
         coalesce(bool_or(setting = 'enableIpAccessLists' and lower(value) = 'true'), false) as ipl_on,
         max(case when setting = 'enableDbfsFileBrowser' then value end) as setting_dbfs_browser,
         max(case when setting = 'enableIpAccessLists' then value end) as setting_ip_access_lists,
         max(case when setting = 'enableResultsDownloading' then value end) as setting_results_download,
         max(case when setting = 'enableExportNotebook' then value end) as setting_export_notebook,
         max(case when setting = 'maxTokenLifetimeDays' then value end) as setting_token_lifetime_days
  from settings group by workspace_id)"""

_KINDS = ("policy", "pool", "endpoint", "repo", "init_script", "group", "scope", "ip_access_list",
          "token", "external_location", "storage_credential", "workspace_object", "untitled_notebook", "disabled_init_script")
_F_COUNTS = "fcnt as (select workspace_id, " + ", ".join(
    f"cast(coalesce(sum(case when kind = '{k}' then n end), 0) as bigint) as {k}_count" for k in _KINDS
) + " from object_counts group by workspace_id)"

oracle("features_clusters", ["clusters"], f"with {_F_CLUSTERS} select * from fc")
oracle("features_warehouses", ["warehouses"], f"with {_F_WAREHOUSES} select * from fw")
oracle("features_jobs", ["jobs", "service_principals"], f"with {_F_JOBS} select * from fj")
oracle("features_pipelines", ["pipelines"], f"with {_F_PIPELINES} select * from fp")
oracle("features_catalogs", ["catalogs"], f"with {_F_CATALOGS} select * from fcat")
oracle("features_scim", ["scim_groups", "service_principals"], f"""
with {_F_SCIM}
select coalesce(fs.workspace_id, fsp.workspace_id) as workspace_id, fs.scim_count, fs.idp_synced, fsp.sp_count
from fs full join fsp on fs.workspace_id = fsp.workspace_id""")
oracle("features_settings", ["settings"], f"with {_F_SETTINGS} select * from fset")
oracle("features_counts", ["object_counts"], f"with {_F_COUNTS} select * from fcnt")

_INV_VIEWS = ["workspaces", "clusters", "warehouses", "jobs", "pipelines", "catalogs",
              "scim_groups", "service_principals", "settings", "object_counts"]

_F_ALL = f"""
{_F_CLUSTERS}, {_F_WAREHOUSES}, {_F_JOBS}, {_F_PIPELINES}, {_F_CATALOGS}, {_F_SCIM}, {_F_SETTINGS}, {_F_COUNTS},
base as (
  select workspace_id, host,
         case when host is null or host = '' then 'unknown'
              when regexp_matches(lower(host), '\\.azuredatabricks\\.net') then 'azure'
              when regexp_matches(lower(host), '\\.gcp\\.databricks\\.com') then 'gcp'
              when regexp_matches(lower(host), '\\.databricks\\.com') then 'aws'
              else 'unknown' end as cloud,
         metastore_name, metastore_owner, delta_sharing_scope,
         (coalesce(metastore_name, '') <> '' or metastore_owner is not null or delta_sharing_scope is not null)
           as has_metastore
  from workspaces),
wf as (
  select base.*,
         {", ".join(f"coalesce(fc.{c}, 0) as {c}" for c in (
            "cluster_count running_clusters photon_clusters autoscale_clusters total_workers max_workers "
            "node_type_count running_no_autoterm autoterm_clusters tagged_clusters versioned_clusters "
            "recent_runtime_clusters gpu_clusters spot_clusters standard_mode_clusters dedicated_mode_clusters "
            "none_mode_clusters efficient_aws efficient_azure efficient_gcp").split())},
         fc.node_type_sample,
         {", ".join(f"coalesce(fw.{c}, 0) as {c}" for c in (
            "warehouse_count pro_or_serverless_wh multi_or_serverless_wh multi_cluster_wh photon_wh "
            "autostop_wh running_wh").split())},
         {", ".join(f"coalesce(fj.{c}, 0) as {c}" for c in (
            "job_count git_jobs retry_jobs job_cluster_jobs dab_jobs iac_jobs sp_owned_jobs").split())},
         {", ".join(f"coalesce(fp.{c}, 0) as {c}" for c in (
            "pipeline_count failed_pipelines connect_pipelines autoscale_pipelines").split())},
         coalesce(fcat.catalog_count, 0) as catalog_count,
         coalesce(fcat.has_open_catalog, false) as has_open_catalog,
         coalesce(fs.scim_count, 0) as scim_count, coalesce(fs.idp_synced, 0) as idp_synced,
         coalesce(fsp.sp_count, 0) as sp_count,
         coalesce(fset.has_settings, false) as has_settings, coalesce(fset.dbfs_off, false) as dbfs_off,
         coalesce(fset.ipl_on, false) as ipl_on,
         fset.setting_dbfs_browser, fset.setting_ip_access_lists, fset.setting_results_download,
         fset.setting_export_notebook, fset.setting_token_lifetime_days,
         {", ".join(f"coalesce(fcnt.{k}_count, 0) as {k}_count" for k in _KINDS)}
  from base
  left join fc using (workspace_id) left join fw using (workspace_id) left join fj using (workspace_id)
  left join fp using (workspace_id) left join fcat using (workspace_id) left join fs using (workspace_id)
  left join fsp using (workspace_id) left join fset using (workspace_id) left join fcnt using (workspace_id))"""

oracle("workspace_features", _INV_VIEWS, f"with {_F_ALL} select * from wf")

# Scoring oracles live in their own module; importing it registers them.
from fleetgrade.plans import oracles_scoring  # noqa: E402,F401,I001
from fleetgrade.plans import oracles_reports  # noqa: E402,F401

# Ingest round trips: the normalized payloads must give the features of the source views.
for _k, _views, _body in (
    ("ingest_clusters", ["clusters"], f"with {_F_CLUSTERS} select * from fc"),
    ("ingest_warehouses", ["warehouses"], f"with {_F_WAREHOUSES} select * from fw"),
    ("ingest_jobs", ["jobs", "service_principals"], f"with {_F_JOBS} select * from fj"),
    ("ingest_pipelines", ["pipelines"], f"with {_F_PIPELINES} select * from fp"),
    ("ingest_catalogs", ["catalogs"], f"with {_F_CATALOGS} select * from fcat"),
    ("ingest_settings", ["settings"], f"with {_F_SETTINGS} select * from fset"),
    ("ingest_counts", ["object_counts"], f"with {_F_COUNTS} select * from fcnt where workspace_id in "
                                         "(select workspace_id from object_counts where n > 0)"),
    ("ingest_workspace_features", _INV_VIEWS, f"with {_F_ALL} select * from wf"),
):
    # Landed payloads carry workspace_id as BIGINT.
    oracle(_k, _views, _body.replace(" select * from ", " select * replace (cast(workspace_id as bigint) as workspace_id) from "))

oracle("ingest_scim", ["scim_groups", "service_principals"], f"""
with {_F_SCIM}
select coalesce(fs.workspace_id, fsp.workspace_id) as workspace_id, fs.idp_synced, fs.scim_count, fsp.sp_count
from fs full join fsp on fs.workspace_id = fsp.workspace_id""")

oracle("ingest_workspace_objects", ["object_counts"], """
with obj as (
  select oc.workspace_id, r.i,
         '/Users/u/' || case when r.i % 5 = 0 then 'Untitled Notebook ' else 'nb_' end || cast(r.i as varchar) as path,
         case when r.i % 7 = 0 then 'UNKNOWN' when r.i % 3 = 0 then 'NOTEBOOK' when r.i % 3 = 1 then 'DIRECTORY'
              else 'FILE' end as object_type
  from object_counts oc, range(1, cast(oc.n as bigint) + 1) r(i)
  where oc.kind = 'workspace_object' and oc.n > 0),
t as (select workspace_id, object_type, count(*) as objects from obj group by workspace_id, object_type),
u as (select workspace_id, count(*) filter (where contains(path, 'Untitled')) as untitled, count(*) as object_count
      from obj group by workspace_id)
select t.workspace_id, t.object_type, t.objects, u.untitled, u.object_count from t join u using (workspace_id)""")
