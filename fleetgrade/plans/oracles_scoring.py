"""DuckDB oracles for per-workspace deep metrics, the 140 rules and the roll-ups.

Each rule is a hand-written SQL CASE returning a code: '0', '1', '2', or '1U'
for an unverified 1.
"""

from __future__ import annotations

from fleetgrade.plans import oracles as o
from fleetgrade.plans.catalog import PILLARS, rules as catalog_rules

_DEEP_VIEWS = ["usage", "cluster_timeline", "job_runs", "query_history", "audit"]

_DM = f"""
b_sku as (
  select workspace_id, sku_name, cast(sum(usage_quantity) as double) as dbus,
         row_number() over (partition by workspace_id order by sum(usage_quantity) desc, sku_name) as rn
  from usage where {o.U} group by workspace_id, sku_name),
b_tot as (
  select workspace_id, sum(case when rn <= 20 then dbus end) as total_dbus_30d, sum(dbus) as total_dbus_all
  from b_sku group by workspace_id),
b_day as (
  select workspace_id, usage_date, cast(sum(usage_quantity) as double) as d
  from usage where {o.U} group by workspace_id, usage_date),
b_day_r as (
  select *, row_number() over (partition by workspace_id order by usage_date) as ra,
            row_number() over (partition by workspace_id order by usage_date desc) as rd from b_day),
b_trend as (
  select workspace_id, count(*) as n,
         sum(case when ra <= 7 then d end) / 7.0 as fw, sum(case when rd <= 7 then d end) / 7.0 as lw
  from b_day_r group by workspace_id),
b_cl as (
  select workspace_id, max(dbus) as top_cluster_dbus from (
    select workspace_id, usage_cluster_id, cast(sum(usage_quantity) as double) as dbus
    from usage where {o.U} and usage_cluster_id is not null group by workspace_id, usage_cluster_id)
  group by workspace_id),
c_up as (
  select workspace_id, cluster_id, cluster_name,
         sum(case when state = 'RUNNING' then duration_ms else 0 end) as rms
  from cluster_timeline where {o.CT} group by workspace_id, cluster_id, cluster_name),
c_top as (
  select *, row_number() over (partition by workspace_id order by rms desc, cluster_id, cluster_name) as rn
  from c_up where rms > 0),
c_tot as (
  select workspace_id, round_even(cast(sum(rms) as double) / 3600000.0, 1) as total_running_hours_30d,
         count(*) as uptime_rows, max(cast(rms as double) / 3600000.0) as max_running_hours,
         count(*) filter (cast(rms as double) / 3600000.0 > 500) as always_on_rows,
         coalesce(array_to_string(list(left(coalesce(cluster_name, cluster_id, '?'), 25) order by rn)
                                  filter (cast(rms as double) / 3600000.0 > 500)[1:3], ', '), '') as always_on_names
  from c_top where rn <= 20 group by workspace_id),
c_all as (select workspace_id, round_even(cast(sum(rms) as double) / 3600000.0, 1) as running_hours_all from c_top group by workspace_id),
c_idle as (
  select workspace_id, cluster_id, cluster_name, rms,
         row_number() over (partition by workspace_id order by rms desc, cluster_id, cluster_name) as rn
  from c_up u
  where cast(rms as double) / 3600000.0 > 1
    and not exists (select 1 from job_runs j where j.workspace_id = u.workspace_id
                    and j.cluster_id = u.cluster_id and {o.JR})),
c_idle_tot as (
  select workspace_id, round_even(cast(sum(rms) filter (rn <= 10) as double) / 3600000.0, 1) as idle_hours_30d,
         count(*) filter (rn <= 10) as idle_rows, round_even(cast(sum(rms) as double) / 3600000.0, 1) as idle_hours_all,
         array_to_string(list(left(coalesce(cluster_name, cluster_id, '?'), 30) order by rn)[1:3], ', ') as idle_names
  from c_idle group by workspace_id),
q_st as (
  select workspace_id, count(*) as total_queries,
         count(*) filter (where status = 'FAILED') as failed_queries,
         count(*) filter (where status = 'FINISHED' and duration > 300000) as slow_query_count,
         round(quantile_cont(duration, 0.95), 2) as p95_duration_ms
  from query_history where {o.QH} group by workspace_id),
q_wh as (
  select workspace_id, count(*) as wh_rows, max(n) as wh_top_count from (
    select workspace_id, warehouse_id, count(*) as n,
           row_number() over (partition by workspace_id order by count(*) desc, warehouse_id) as rn
    from query_history where {o.QH} and warehouse_id is not null group by workspace_id, warehouse_id)
  where rn <= 10 group by workspace_id),
j_st as (
  select workspace_id, count(*) as total_runs,
         count(*) filter (where result_state in ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')) as failed_runs
  from job_runs where {o.JR} group by workspace_id),
j_fail as (
  select workspace_id, count(*) as failing_jobs, count(*) filter (where f >= 5) as chronic_jobs from (
    select workspace_id, job_id,
           count(*) filter (where result_state in ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')) as f,
           row_number() over (partition by workspace_id
             order by count(*) filter (where result_state in ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')) desc, job_id) as rn
    from job_runs where {o.JR} group by workspace_id, job_id
    having count(*) filter (where result_state in ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')) > 0)
  where rn <= 10 group by workspace_id),
a_act as (
  select workspace_id, sum(n) filter (rn <= 30) as total_events_30d, sum(n) as total_events_all from (
    select workspace_id, action_name, count(*) as n,
           row_number() over (partition by workspace_id order by count(*) desc, action_name) as rn
    from audit where {o.AU} group by workspace_id, action_name) group by workspace_id),
a_sum as (
  select workspace_id,
         count(*) filter (where action_name in ('login', 'tokenLogin', 'aadTokenLogin')
                          and response_status_code >= 400) as failed_logins,
         count(*) filter (where action_name in ('changePermissions', 'updatePermissions', 'changeClusterAcl',
                                                'changeDbTokenAcl', 'grantPermission', 'revokePermission'))
           as permission_changes
  from audit where {o.AU} group by workspace_id),
dm_keys as (
  select workspace_id from b_tot union select workspace_id from c_up union select workspace_id from q_st
  union select workspace_id from j_st union select workspace_id from a_sum),
dm as (
  select k.workspace_id,
         b_tot.total_dbus_30d, b_tot.total_dbus_all,
         round_even(case when b_trend.n >= 7 and b_trend.fw > 0 then (b_trend.lw - b_trend.fw) / b_trend.fw * 100.0 end, 1)
           as trend_pct_change,
         b_cl.top_cluster_dbus,
         c_tot.total_running_hours_30d, c_tot.uptime_rows, c_tot.max_running_hours,
         c_tot.always_on_rows, c_tot.always_on_names, c_all.running_hours_all,
         c_idle_tot.idle_hours_30d, c_idle_tot.idle_rows, c_idle_tot.idle_names, c_idle_tot.idle_hours_all,
         q_st.total_queries, q_st.failed_queries, q_st.slow_query_count, q_st.p95_duration_ms,
         coalesce(round_even(cast(q_st.failed_queries as double) / cast(q_st.total_queries as double) * 100.0, 2), 0.0)
           as failure_rate_pct,
         q_wh.wh_rows, q_wh.wh_top_count,
         j_st.total_runs, j_st.failed_runs,
         coalesce(round_even(cast(j_st.total_runs - j_st.failed_runs as double) / cast(j_st.total_runs as double) * 100.0, 2), 0.0)
           as success_rate_pct,
         j_fail.failing_jobs, j_fail.chronic_jobs,
         cast(a_act.total_events_30d as bigint) as total_events_30d,
         cast(a_act.total_events_all as bigint) as total_events_all, a_sum.failed_logins, a_sum.permission_changes,
         b_tot.total_dbus_30d is not null as billing_available,
         coalesce(c_tot.uptime_rows > 0, false) as compute_available,
         true as query_available,
         true as jobs_available,
         a_act.total_events_30d is not null as audit_available
  from dm_keys k
  left join b_tot using (workspace_id) left join b_trend using (workspace_id) left join b_cl using (workspace_id)
  left join c_tot using (workspace_id) left join c_all using (workspace_id) left join c_idle_tot using (workspace_id)
  left join q_st using (workspace_id) left join q_wh using (workspace_id)
  left join j_st using (workspace_id) left join j_fail using (workspace_id)
  left join a_act using (workspace_id) left join a_sum using (workspace_id))"""

o.oracle("deep_metrics", _DEEP_VIEWS, f"with {_DM} select * from dm")

_INP = f"""
{_DM},
inp as (
  select wf.*, dm.* exclude (workspace_id, billing_available, compute_available, query_available,
                             jobs_available, audit_available),
         coalesce(dm.billing_available, false) as billing_available,
         coalesce(dm.compute_available, false) as compute_available,
         coalesce(dm.query_available, true) as query_available,
         coalesce(dm.jobs_available, true) as jobs_available,
         coalesce(dm.audit_available, false) as audit_available
  from wf left join dm using (workspace_id))"""

_UC = "metastore_name <> '' and catalog_count > 0"
_CLOUD = "cloud in ('aws', 'azure', 'gcp')"

RULE_SQL: dict[str, str] = {
    "gov-001": "when has_metastore and catalog_count > 100 then '1' when has_metastore and catalog_count > 0 then '2' "
               "when has_metastore then '1' else '0'",
    "gov-002": "when has_metastore then '2' else '0'",
    "gov-003": "when metastore_name <> '' then '1' else '0'",
    "gov-004": "when catalog_count > 100 then '0' when catalog_count > 0 then '1' else '0'",
    "gov-005": "when catalog_count > 100 then '1' when catalog_count > 0 then '2' else '0'",
    "gov-006": "when endpoint_count > 0 then '1' else '0'",
    "gov-007": "when contains(lower(coalesce(metastore_owner, '')), 'account users') "
               "or contains(lower(coalesce(metastore_owner, '')), 'account_users') then '0' "
               "when coalesce(metastore_owner, '') <> '' then '2' when has_open_catalog then '1' "
               "when metastore_name <> '' then '1' else '0'",
    "gov-008": "when true then '1' else '0'",
    "gov-009": "when has_settings then '1' else '0'",
    "gov-010": "when pipeline_count > 0 then '1' else '0'",
    "gov-011": "when pipeline_count > 0 then '1' else '0'",
    "gov-012": f"when {_UC} then '1U' else '0'",
    "gov-013": "when idp_synced > 0 then '2' when scim_count > 0 then '1' else '0'",
    "gov-014": "when catalog_count > 0 and external_location_count = 0 then '2' "
               "when catalog_count > 0 and external_location_count > 0 "
               "and cast(external_location_count as double) / greatest(catalog_count, 1) > 0.5 then '0' "
               "when catalog_count > 0 and external_location_count > 0 then '1' else '0'",
    "gov-015": f"when {_UC} then '1' else '0'",
    "int-001": "when dab_jobs > 0 or job_count > 0 then '1' else '0'",
    "int-002": "when true then '1' else '1'",
    "int-003": "when true then '1' else '1'",
    "int-004": "when pipeline_count > 0 and failed_pipelines > 0 then '1' when pipeline_count > 0 then '2' else '0'",
    "int-005": "when true then '1' else '1'",
    "int-006": f"when {_UC} then '2' else '0'",
    "int-007": "when contains(coalesce(delta_sharing_scope, ''), 'EXTERNAL') then '2' else '1'",
    "int-008": "when endpoint_count > 0 then '2' else '0'",
    "int-009": "when warehouse_count > 0 then '2' else '1'",
    "int-010": "when pro_or_serverless_wh > 0 then '2' when warehouse_count > 0 then '1' else '0'",
    "int-011": "when policy_count > 20 then '1' when policy_count > 0 then '2' else '0'",
    "int-012": "when true then '1U' else '1U'",
    "int-013": "when true then '1' else '1'",
    "int-014": "when true then '1U' else '1U'",
    "int-015": "when metastore_name <> '' then '2' else '0'",
    "ops-001": "when true then '1U' else '1U'",
    "ops-002": "when repo_count > 0 then '2' else '1'",
    "ops-003": "when git_jobs > 0 then '2' when job_count > 0 then '1' else '0'",
    "ops-004": "when endpoint_count > 0 then '1U' else '0'",
    "ops-005": "when catalog_count >= 2 then '2' when catalog_count > 0 then '1' else '0'",
    "ops-006": "when catalog_count >= 2 then '2' when catalog_count > 0 then '1' else '0'",
    "ops-007": "int-005",
    "ops-008": "when policy_count > 0 then '2' when cluster_count > 0 then '1' else '0'",
    "ops-009": "when job_count >= 3 then '2' when job_count > 0 then '1' else '0'",
    "ops-010": "when true then '1U' else '1U'",
    "ops-011": "when pipeline_count > 0 then '2' else '0'",
    "ops-012": "when endpoint_count > 0 then '2' else '1'",
    "ops-013": "ops-004",
    "ops-014": "when true then '1U' else '1U'",
    "ops-015": "when true then '1U' else '1U'",
    "ops-016": "ops-011",
    "ops-017": "when true then '1U' else '1U'",
    "ops-018": "when true then '1U' else '1U'",
    "ops-019": "when true then '1U' else '1U'",
    "ops-020": "when warehouse_count > 0 then '2' else '1'",
    "ops-021": "when git_jobs > 0 then '1' else '0'",
    "ops-022": "when sp_count > 0 then '1' else '0'",
    "ops-023": "when running_no_autoterm > 0 then '0' when running_clusters > 0 then '1' else '2'",
    "ops-024": "when not compute_available then '1U' when coalesce(uptime_rows, 0) = 0 then '1' "
               "when max_running_hours > 500 then '0' "
               "when cast(total_running_hours_30d as double) / cast(uptime_rows as double) > 200 then '1' else '2'",
    "sec-001": "when metastore_name <> '' then '2' else '1U'",
    "sec-002": f"when {_CLOUD} then '1' else '1U'",
    "sec-003": "when ip_access_list_count > 0 and ipl_on then '2' else '1'",
    "sec-004": "when true then '1U' else '1U'",
    "sec-005": "when dbfs_off and ipl_on then '2' when has_settings then '1' else '1U'",
    "sec-006": "when true then '1U' else '1U'",
    "sec-007": "when dbfs_off then '2' when has_settings then '1' else '1U'",
    "sec-008": "when idp_synced > 0 then '2' when scim_count > 0 then '1' else '1U'",
    "sec-009": "when idp_synced >= 3 then '2' when idp_synced > 0 then '1' else '0'",
    "sec-010": "when sp_count >= 3 then '2' when sp_count > 0 then '1' else '0'",
    "sec-011": "when ipl_on then '1' else '0'",
    "sec-012": "when dbfs_off then '2' when has_settings then '0' else '1U'",
    "sec-013": "when not audit_available then '1U' when failed_logins > 50 then '0' "
               "when failed_logins > 10 then '1' else '2'",
    "sec-014": "when not audit_available then '1U' when permission_changes > 200 then '0' "
               "when permission_changes > 50 then '1' else '2'",
    "rel-001": "gov-012",
    "rel-002": "when photon_clusters > 0 then '2' else '1'",
    "rel-003": "when pipeline_count > 0 then '1U' else '0'",
    "rel-004": "when retry_jobs > 0 then '2' when job_count > 0 then '1' else '0'",
    "rel-005": "ops-012",
    "rel-006": "when job_count + pipeline_count + warehouse_count >= 3 then '2' "
               "when job_count + pipeline_count + warehouse_count > 0 then '1' else '0'",
    "rel-007": "when catalog_count >= 2 then '1U' when catalog_count > 0 then '1' else '0'",
    "rel-008": "when true then '1U' else '1U'",
    "rel-009": "when pipeline_count > 0 then '1U' else '1'",
    "rel-010": "rel-009",
    "rel-011": "when true then '1U' else '1U'",
    "rel-012": "when autoscale_pipelines > 0 then '2' when pipeline_count > 0 then '1' else '0'",
    "rel-013": "when multi_or_serverless_wh > 0 then '2' when warehouse_count > 0 then '1' else '0'",
    "rel-014": "when true then '1U' else '1U'",
    "rel-015": "when pipeline_count > 0 then '1U' else '0'",
    "rel-016": f"when {_UC} then '2' else '0'",
    "rel-017": "rel-004",
    "rel-018": "when true then '1U' else '1U'",
    "rel-019": "when sp_count > 0 and sp_owned_jobs > 0 then '2' when sp_count > 0 then '1' "
               "when job_count > 0 then '0' else '1'",
    "rel-020": "when not jobs_available then '1U' when coalesce(total_runs, 0) = 0 then '1' when success_rate_pct < 90 then '0' "
               "when success_rate_pct < 98 then '1' else '2'",
    "rel-021": "when not jobs_available then '1U' when coalesce(failing_jobs, 0) = 0 then '2' "
               "when chronic_jobs >= 3 then '0' else '1'",
    "perf-001": "when autoscale_clusters > 0 then '2' when cluster_count > 0 then '1' else '0'",
    "perf-002": "int-010",
    "perf-003": "when true then '1U' else '1U'",
    "perf-004": "when total_workers > 0 then '2' else '1'",
    "perf-005": "ops-011",
    "perf-006": "when max_workers > 0 then '2' when cluster_count > 0 then '1' else '0'",
    "perf-007": "rel-002",
    "perf-008": "rel-002",
    "perf-009": "when cluster_count > 0 and node_type_count > 1 then '2' else '1'",
    "perf-010": "when true then '1U' else '1U'",
    "perf-011": "perf-003",
    "perf-012": "perf-003",
    "perf-013": "when true then '1U' else '1U'",
    "perf-014": "when true then '1' else '1'",
    "perf-015": "when true then '1U' else '1U'",
    "perf-016": "when true then '1U' else '1U'",
    "perf-017": "when photon_wh > 0 then '2' else '1'",
    "perf-018": "when warehouse_count > 0 then '2' else '1'",
    "perf-019": "when warehouse_count > 0 then '2' else '1'",
    "perf-020": "when pipeline_count > 0 then '2' else '0'",
    "perf-021": "when job_count > 0 then '2' else '0'",
    "perf-022": f"when {_UC} then '1' else '0'",
    "perf-023": "when metastore_name <> '' then '1' else '0'",
    "perf-024": "when cluster_count = 0 then '1' "
                "when (case cloud when 'aws' then efficient_aws when 'azure' then efficient_azure "
                "when 'gcp' then efficient_gcp else 0 end) > 0 then '2' else '0'",
    "perf-025": "when cluster_count = 0 then '1' when standard_mode_clusters > 0 and none_mode_clusters = 0 then '2' "
                "when standard_mode_clusters > 0 then '1' when none_mode_clusters > 0 then '0' else '1'",
    "perf-026": "when not query_available then '1U' when coalesce(total_queries, 0) = 0 then '1' "
                "when failure_rate_pct > 10 then '0' when failure_rate_pct > 2 then '1' else '2'",
    "perf-027": "when not query_available then '1U' when coalesce(total_queries, 0) = 0 then '1' "
                "when cast(slow_query_count as double) / cast(total_queries as double) * 100 > 5 then '0' "
                "when cast(slow_query_count as double) / cast(total_queries as double) * 100 > 1 then '1' else '2'",
    "perf-028": "when not query_available then '1U' when coalesce(wh_rows, 0) = 0 or coalesce(total_queries, 0) = 0 then '1' "
                "when wh_rows = 1 and cast(wh_top_count as double) / cast(total_queries as double) * 100 > 90 then '1' "
                "when cast(wh_top_count as double) / cast(total_queries as double) * 100 > 80 then '1' else '2'",
    "cost-001": "gov-012",
    "cost-002": "when job_cluster_jobs > 0 then '2' when job_count > 0 then '1' else '0'",
    "cost-003": "when warehouse_count > 0 then '2' else '1'",
    "cost-004": "when cluster_count > 0 and recent_runtime_clusters > 0 then '2' else '1'",
    "cost-005": "when gpu_clusters > 0 then '1' when cluster_count > 0 then '2' else '1'",
    "cost-006": "int-010",
    "cost-007": "when policy_count > 0 then '2' else '1'",
    "cost-008": "when autoscale_clusters > 0 then '2' when cluster_count > 0 then '1' else '0'",
    "cost-009": "rel-002",
    "cost-010": "when autoscale_clusters + multi_cluster_wh > 0 then '2' "
                "when warehouse_count > 0 or cluster_count > 0 then '1' else '0'",
    "cost-011": "when autoterm_clusters + autostop_wh > 0 then '2' "
                "when warehouse_count > 0 or cluster_count > 0 then '1' else '0'",
    "cost-012": "ops-008",
    "cost-013": "when true then '1U' else '1U'",
    "cost-014": "when tagged_clusters > 0 then '2' when cluster_count > 0 then '1' else '0'",
    "cost-015": "cost-013",
    "cost-016": "cost-013",
    "cost-017": "when true then '1U' else '1U'",
    "cost-018": f"when {_CLOUD} then '1' else '1U'",
    "cost-019": "when cluster_count = 0 then '1' when spot_clusters > 0 then '2' else '1'",
    "cost-020": f"when {_CLOUD} then '1' else '1U'",
    "cost-021": "when not compute_available then '1U' when coalesce(idle_rows, 0) = 0 then '2' "
                "when idle_hours_30d > 100 then '0' else '1'",
    "cost-022": "when not billing_available then '1U' when trend_pct_change is null then '1' "
                "when trend_pct_change > 20 then '0' when trend_pct_change > 5 then '1' else '2'",
    "cost-023": "when not billing_available then '1U' when top_cluster_dbus is null or total_dbus_30d = 0 then '1' "
                "when top_cluster_dbus / total_dbus_30d * 100 > 50 then '0' "
                "when top_cluster_dbus / total_dbus_30d * 100 > 30 then '1' else '2'",
}


def _case(rid: str) -> str:
    body = RULE_SQL[rid]
    while body in RULE_SQL:  # alias to another rule
        body = RULE_SQL[body]
    return f"case {body} end"


def _codes(ids: list[str]) -> str:
    return "\nunion all\n".join(
        f"select workspace_id, {ord_} as ord, '{rid}' as rule_id, '{pillar}' as pillar, {_case(rid)} as code from inp"
        for ord_, rid, _n, pillar, _p, _d in catalog_rules() if rid in ids)


def _scored(ids: list[str]) -> str:
    return f"""
{_INP},
codes as ({_codes(ids)}),
sc as (select workspace_id, ord, rule_id, pillar, cast(left(code, 1) as integer) as score,
              code <> '1U' as verified from codes)"""


_VIEWS = _DEEP_VIEWS + o._INV_VIEWS


def rule_codes(ids: list[str], body: str) -> str:
    """SQL over the scores ``sc`` of some rules and the input rows ``inp``."""
    return o.with_views(_VIEWS, f"with {o._F_ALL}, {_scored(ids)} {body}")


_AS_OF = o.CFG.as_of.isoformat()

for _p in PILLARS:
    _ids = [r[1] for r in catalog_rules() if r[1].startswith(_p[0] + "-")]
    o.oracle(f"rules_{_p[0]}", _VIEWS,
             f"with {o._F_ALL}, {_scored(_ids)} select workspace_id, rule_id, score, verified from sc")

_ALL_IDS = [r[1] for r in catalog_rules()]
_SC_ALL = f"with {o._F_ALL}, {_scored(_ALL_IDS)}"

o.oracle("pillar_scores", _VIEWS, f"""{_SC_ALL}
select workspace_id, pillar, count(*) as rules, cast(sum(cast(verified as integer)) as bigint) as verified_rules,
       avg(cast(score as double)) as pillar_score,
       avg(case when verified then cast(score as double) end) as pillar_verified_score,
       cast(sum(cast(verified as integer)) as double) / cast(count(*) as double) * 100.0 as pillar_coverage
from sc group by workspace_id, pillar""")

o.oracle("assessment", _VIEWS, f"""{_SC_ALL},
agg as (
  select workspace_id, count(*) as rules, cast(sum(cast(verified as integer)) as bigint) as verified_rules,
         avg(cast(score as double)) as m, coalesce(avg(case when verified then cast(score as double) end), 0.0) as vm
  from sc group by workspace_id)
select agg.workspace_id, DATE '{_AS_OF}' as as_of, rules, verified_rules, round_even(m, 2) as overall_score, round_even(vm, 2) as verified_score,
       round_even(cast(verified_rules as double) / cast(rules as double) * 100.0, 1) as coverage_pct,
       case when vm >= 1.75 then 'Optimized' when vm >= 1.25 then 'Established' when vm >= 0.5 then 'Developing'
            else 'Beginning' end as maturity,
       wf.host, wf.cloud
from agg left join wf using (workspace_id)""")


# Notes of the deep rules with the evidence they name, in the order of the rule's branches.
_AVG_UP = "round_even(cast(total_running_hours_30d as double) / cast(uptime_rows as double), 0)"
_SLOW = ("printf('%d slow queries of %d, P95 %.1f s.', coalesce(slow_query_count, 0), total_queries, "
         "round_even(round_even(coalesce(p95_duration_ms, 0.0), 2) / 1000, 1))")
_TOP_WH = "round_even(cast(wh_top_count as double) / cast(total_queries as double) * 100, 1)"
_TOP_CL = "round_even(top_cluster_dbus / total_dbus_30d * 100, 1)"
_DBU = "round_even(coalesce(total_dbus_30d, 0.0), 0)"
_FAIL = "printf('Query failure rate %.2f%% of %d queries.', failure_rate_pct, total_queries)"
_RUNS = "printf('Job success rate %.2f%% over %d runs.', success_rate_pct, total_runs)"
_CHRONIC = "printf('%d jobs with 5 or more failures.', chronic_jobs)"
_no = lambda what: f"'Requires --deep scan: {what} not available.'"
DEEP_NOTES = {
    "ops-024": f"when not compute_available then {_no('cluster timeline')} when coalesce(uptime_rows, 0) = 0 then 'No cluster lifecycle rows.' "
               "when max_running_hours > 500 then printf('%d clusters run around the clock, first %s; move their work to jobs or serverless.', "
               "always_on_rows, always_on_names) "
               f"when cast(total_running_hours_30d as double) / cast(uptime_rows as double) > 200 then printf('Mean uptime %.0f h over %d clusters.', {_AVG_UP}, uptime_rows) "
               f"else printf('%d active clusters, mean uptime %.0f h.', uptime_rows, {_AVG_UP})",
    "sec-013": f"when not audit_available then {_no('audit events')} else printf('%d failed logins in the window.', failed_logins)",
    "sec-014": f"when not audit_available then {_no('audit events')} else printf('%d permission changes in the window.', permission_changes)",
    "rel-020": f"when not jobs_available then {_no('job runs')} when coalesce(total_runs, 0) = 0 then 'No job runs in the window.' else {_RUNS}",
    "rel-021": f"when not jobs_available then {_no('job runs')} when coalesce(failing_jobs, 0) = 0 then 'No recurring job failures.' "
               f"when chronic_jobs > 0 then {_CHRONIC} else printf('%d jobs failed, none chronically.', failing_jobs)",
    "perf-026": f"when not query_available then {_no('query history')} when coalesce(total_queries, 0) = 0 then 'No queries in the window.' else {_FAIL}",
    "perf-027": f"when not query_available then {_no('query history')} when coalesce(total_queries, 0) = 0 then 'No queries in the window.' else {_SLOW}",
    "perf-028": f"when not query_available then {_no('query history')} when coalesce(wh_rows, 0) = 0 or coalesce(total_queries, 0) = 0 then 'No warehouse utilization rows.' "
                f"when wh_rows = 1 and cast(wh_top_count as double) / total_queries * 100 > 90 then printf('One warehouse has %.1f%% of the queries and no other has any.', {_TOP_WH}) "
                f"when cast(wh_top_count as double) / total_queries * 100 > 80 then printf('One of %d warehouses has %.1f%% of the queries.', wh_rows, {_TOP_WH}) "
                "else printf('Queries spread over %d warehouses.', wh_rows)",
    "cost-021": f"when not compute_available then {_no('cluster timeline')} when coalesce(idle_rows, 0) = 0 then 'No idle clusters.' "
                "when idle_hours_30d > 100 then printf('%d idle clusters with %.1f h in the window, first %s.', idle_rows, idle_hours_30d, idle_names) "
                "else printf('%d clusters with some idle time, %.1f h together.', idle_rows, idle_hours_30d)",
    "cost-022": f"when not billing_available then {_no('billing')} when trend_pct_change is null then printf('%.0f DBU, too little billing history for a trend.', {_DBU}) "
                f"when trend_pct_change > 5 then printf('Spend up %.1f%% to %.0f DBU.', trend_pct_change, {_DBU}) "
                f"else printf('Spend change %.1f%%, %.0f DBU.', trend_pct_change, {_DBU})",
    "cost-023": f"when not billing_available then {_no('billing')} when top_cluster_dbus is null or total_dbus_30d = 0 then 'No per-cluster usage.' "
                f"when top_cluster_dbus / total_dbus_30d * 100 > 50 then printf('One cluster takes %.1f%% of the usage.', {_TOP_CL}) "
                f"when top_cluster_dbus / total_dbus_30d * 100 > 30 then printf('The top cluster takes %.1f%% of the usage.', {_TOP_CL}) "
                f"else printf('Usage is spread, the top cluster takes %.1f%%.', {_TOP_CL})",
}
_deep_sql = "\nunion all\n".join(
    f"select workspace_id, '{rid}' as rule_id, case {note} end as finding_notes from inp" for rid, note in DEEP_NOTES.items())
o.oracle("deep_findings", _VIEWS, f"""with {o._F_ALL}, {_scored(list(DEEP_NOTES))},
notes as ({_deep_sql})
select sc.workspace_id, sc.rule_id, sc.score, sc.verified, notes.finding_notes from sc join notes using (workspace_id, rule_id)""")
