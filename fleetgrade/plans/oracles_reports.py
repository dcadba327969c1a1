"""DuckDB oracles for the report tables.

Static dimensions (rule catalogue, pillars, remediation patterns and links) enter
the SQL as VALUES lists built from the same fixed-value tables; every computation
on them is written in SQL here.
"""

from __future__ import annotations

from fleetgrade.plans import oracles as o
from fleetgrade.plans import oracles_scoring as osc
from fleetgrade.plans.catalog import PILLARS, rules as catalog_rules
from fleetgrade.plans.remediation import DOCS_BASE, TOPICS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CAT = "cat(ord, rule_id, name, principle) as (values " + ", ".join(
    f"({r[0]}, {q(r[1])}, {q(r[2])}, {q(r[4])})" for r in catalog_rules()) + ")"
_PD = "pd(pillar_ord, pillar, display_name) as (values " + ", ".join(
    f"({i + 1}, {q(p[1])}, {q(p[2])})" for i, p in enumerate(PILLARS)) + ")"
_PATS = "pats(topic_ord, topic, pattern) as (values " + ", ".join(
    f"({i + 1}, {q(t)}, {q(p)})" for i, (t, ps, _d) in enumerate(TOPICS) for p in ps) + ")"
_LINKS = "links(topic, cloud_key, idx, label, path) as (values " + ", ".join(
    f"({q(t)}, {q(k)}, {j + 1}, {q(lab)}, {q(path)})"
    for t, _ps, docs in TOPICS for k, lst in docs.items() for j, (lab, path) in enumerate(lst)) + ")"

_ALL_IDS = [r[1] for r in catalog_rules()]

BASE = f"""with {o._F_ALL}, {osc._scored(_ALL_IDS)}, {_CAT}, {_PD},
scx as (select sc.*, cat.name, cat.principle from sc join cat using (rule_id, ord)),
ps as (
  select workspace_id, pillar, count(*) as rules, cast(sum(cast(verified as integer)) as bigint) as verified_rules,
         avg(cast(score as double)) as pillar_score,
         avg(case when verified then cast(score as double) end) as pillar_verified_score,
         cast(sum(cast(verified as integer)) as double) / cast(count(*) as double) * 100.0 as pillar_coverage
  from sc group by workspace_id, pillar),
agg as (
  select workspace_id, avg(cast(score as double)) as m,
         coalesce(avg(case when verified then cast(score as double) end), 0.0) as vm
  from sc group by workspace_id),
asmt as (
  select workspace_id, round_even(m, 2) as overall_score,
         case when vm >= 1.75 then 'Optimized' when vm >= 1.25 then 'Established' when vm >= 0.5 then 'Developing'
              else 'Beginning' end as maturity
  from agg),
psum as (
  select ps.workspace_id, pd.pillar_ord, ps.pillar, pd.display_name, coalesce(ps.pillar_score, 0.0) as score,
         coalesce(ps.pillar_score, 0.0) / 2.0 * 100.0 as pct,
         case when coalesce(ps.pillar_score, 0.0) >= 1.75 then 'Optimized'
              when coalesce(ps.pillar_score, 0.0) >= 1.25 then 'Established'
              when coalesce(ps.pillar_score, 0.0) >= 0.5 then 'Developing' else 'Beginning' end as maturity
  from ps join pd using (pillar)
  union all
  select workspace_id, {len(PILLARS) + 1}, 'Overall', 'Overall Average', overall_score,
         overall_score / 2.0 * 100.0, maturity
  from asmt)"""

VIEWS = osc._DEEP_VIEWS + o._INV_VIEWS


def rep(name: str, body: str) -> None:
    o.oracle(name, VIEWS, f"{BASE}\n{body}")


def _disp(col: str) -> str:
    return "case " + " ".join(f"when {col} = {q(p[1])} then {q(p[2])}" for p in PILLARS) + f" else {col} end"


rep("maturity", "select workspace_id, maturity from asmt")
rep("pillar_summary", "select * from psum")
rep("verified_summary", """
select ps.workspace_id, pd.pillar_ord, ps.pillar, pd.display_name,
       coalesce(pillar_verified_score, 0.0) / 2.0 * 100.0 as verified_pct,
       coalesce(pillar_coverage, 0.0) as coverage_pct,
       case when coalesce(pillar_coverage, 0.0) >= 60 then 'green'
            when coalesce(pillar_coverage, 0.0) >= 40 then 'yellow' else 'red' end as coverage_band
from ps join pd using (pillar)""")
rep("pillar_stats", f""",
per as (
  select sc.workspace_id, pd.pillar_ord, pd.display_name, count(*) as rules,
         count(*) filter (where score = 0) as score_0, count(*) filter (where score = 1) as score_1,
         count(*) filter (where score = 2) as score_2, avg(cast(score as double)) as avg_score
  from sc join pd using (pillar) group by sc.workspace_id, pd.pillar_ord, pd.display_name),
allp as (
  select * from per
  union all
  select workspace_id, {len(PILLARS) + 1}, 'TOTAL', cast(sum(rules) as bigint), cast(sum(score_0) as bigint),
         cast(sum(score_1) as bigint), cast(sum(score_2) as bigint), avg(avg_score)
  from per group by workspace_id)
select * replace (round(avg_score, 9) as avg_score), cast(score_0 as double) / rules * 100.0 as pct_not_implemented,
       cast(score_2 as double) / rules * 100.0 as pct_fully_implemented
from allp""".replace("\n,\n", ",\n", 1))
rep("recommendations", """
select workspace_id, pillar, ord, rule_id, name, score,
       row_number() over (partition by workspace_id, pillar order by score, ord) as seq,
       case when score = 0 then 'P0' else 'P1' end as priority,
       case when score = 0 then 'Critical' else 'High' end as impact
from scx where score < 1.5""")
rep("critical_findings", f"""
select * from (
  select workspace_id, pillar, ord, rule_id, name,
         row_number() over (partition by workspace_id order by pillar, ord) as rank, {_disp('pillar')} as display_name
  from scx where score = 0) where rank <= 15""")
rep("roadmap", f"""
select workspace_id, ord, rule_id, pillar, score,
       case when score = 0 and pos <= 6 then 1 when score = 0 then 2 when pos <= 8 then 3 else 4 end as phase,
       case when score = 0 and pos <= 6 then 'Low-Medium' when score = 0 then 'Medium'
            when pos <= 8 then 'Medium-High' else 'High' end as effort,
       case when score = 0 and pos <= 6 then 'Critical' when score = 0 then 'High'
            when pos <= 8 then 'High' else 'Medium' end as impact,
       case when score = 0 then null when pos <= 8 then 'Improve: ' || name else 'Optimize: ' || name end as action,
       {_disp('pillar')} as display_name
from (select *, row_number() over (partition by workspace_id, score order by ord) as pos
      from scx where score in (0, 1))
where (score = 0 and pos <= 12) or (score = 1 and pos <= 14)""")
rep("unverified_rules", """
select workspace_id, pillar, ord, rule_id, name,
       row_number() over (partition by workspace_id order by pillar, ord) as seq,
       count(*) over (partition by workspace_id) as unverified_count
from scx where not verified""")
# Rules whose zero a setting alone would mend; gov-007 counts only with an owner that is too broad.
_QUICK = ("gov-001", "gov-002", "gov-003", "gov-005", "gov-008", "gov-009", "gov-010", "gov-015", "int-004", "int-011",
          "sec-011", "sec-012", "sec-013", "rel-013", "rel-019", "perf-001", "perf-022", "cost-008", "cost-010", "cost-011")
rep("top_findings", f"""
select * from (
  select workspace_id, ord, rule_id, pillar, score,
         row_number() over (partition by workspace_id order by score, pillar, ord) as rank,
         case when score = 0 then 'CRITICAL' when score <= 1 then 'HIGH' else 'MEDIUM' end as risk,
         case when score = 0 and (rule_id in ({', '.join(map(q, _QUICK))})
                                  or rule_id = 'gov-007' and regexp_matches(lower(metastore_owner), 'account[ _]users'))
              then 'Yes' else 'No' end as quick_fix,
         {_disp('pillar')} as display_name
  from scx left join (select workspace_id, metastore_owner from wf) using (workspace_id)) where rank <= 10""")
rep("pillar_highlights", """,
r as (select *, row_number() over (partition by workspace_id, pillar, score order by ord) as pos from scx)
select workspace_id, pillar, 'strength' as kind, pos, ord from r where score = 2 and pos <= 5
union all
select workspace_id, pillar, 'gap', pos, ord from r where score = 0 and pos <= 6
union all
select workspace_id, pillar, 'recommendation', pos, ord from (
  select workspace_id, pillar, ord,
         row_number() over (partition by workspace_id, pillar order by (score = 0) desc, ord) as pos
  from r where score = 0 or (score = 1 and pos <= 5)) where pos <= 6""".replace("\n,\n", ",\n", 1))

_INV = [(1, "Catalogs", "catalog_count"), (2, "External Locations", "external_location_count"),
        (3, "Storage Credentials", "storage_credential_count"), (4, "Running Clusters", "running_clusters"),
        (5, "SQL Warehouses", "warehouse_count"), (6, "Cluster Policies", "policy_count"),
        (7, "Instance Pools", "pool_count"), (8, "Jobs", "job_count"), (9, "DLT Pipelines", "pipeline_count"),
        (10, "Serving Endpoints", "endpoint_count"), (11, "Git Repos", "repo_count"),
        (12, "Secret Scopes", "scope_count"), (13, "Groups", "group_count"),
        (14, "IP Access Lists", "ip_access_list_count"), (15, "Workspace Objects", "workspace_object_count")]
rep("inventory_summary", "\n union all ".join(
    f"select workspace_id, {i} as line, {q(lab)} as resource, cast(coalesce({c}, 0) as bigint) as count from wf"
    for i, lab, c in _INV))

_HEALTH = [
    (1, "Unity Catalog Catalogs", "catalog_count",
     "case when catalog_count > 100 then 'CRITICAL' when catalog_count > 20 then 'WARNING' else 'OK' end"),
    (2, "External Locations", "external_location_count",
     "case when external_location_count > 50 then 'WARNING' else 'OK' end"),
    (3, "Storage Credentials", "storage_credential_count",
     "case when storage_credential_count > 50 then 'WARNING' else 'OK' end"),
    (4, "Cluster Policies", "policy_count",
     "case when policy_count = 0 then 'CRITICAL' when policy_count > 50 then 'WARNING' else 'OK' end"),
    (5, "Running Clusters", "running_clusters", "case when running_clusters > 10 then 'CRITICAL' else 'OK' end"),
    (6, "SQL Warehouses", "warehouse_count", "case when warehouse_count > 20 then 'WARNING' else 'OK' end"),
    (7, "Instance Pools", "pool_count", "case when pool_count > 30 then 'WARNING' else 'OK' end"),
    (8, "DLT Pipelines", "pipeline_count", "case when pipeline_count > 0 then 'OK' else 'WARNING' end"),
    (9, "Serving Endpoints", "endpoint_count", "'OK'"),
    (10, "Secret Scopes", "scope_count", "case when scope_count > 0 then 'OK' else 'WARNING' end"),
    (11, "Git Repos", "repo_count", "case when repo_count > 0 then 'OK' else 'WARNING' end"),
]
rep("inventory_health", "\n union all ".join(
    f"select workspace_id, {i} as line, {q(lab)} as resource, cast({c} as bigint) as count, {h} as health from wf"
    for i, lab, c, h in _HEALTH))

_SET = [(1, "enableDbfsFileBrowser", "false", "setting_dbfs_browser"),
        (2, "enableResultsDownloading", "false", "setting_results_download"),
        (3, "enableExportNotebook", "false", "setting_export_notebook"),
        (4, "enableIpAccessLists", "true", "setting_ip_access_lists"),
        (5, "maxTokenLifetimeDays", "30", "setting_token_lifetime_days")]
_ADVICE = ("Set to false: the DBFS browser allows data exfiltration.", "Consider false for production workspaces.",
           "Consider false to protect code.", "Keep enabled.", "Lower to 30 days or less.")
rep("setting_advice", "\n union all ".join(
    f"select workspace_id, {i} as line, {q(k)} as setting, {c} as value, {q(e)} as expected, "
    f"lower(coalesce({c}, '')) = {q(e)} as is_recommended, case when lower(coalesce({c}, '')) = {q(e)} "
    f"then 'Good: current value is recommended.' else {q(adv)} end as advice from wf where has_settings"
    for (i, k, e, c), adv in zip(_SET, _ADVICE, strict=True)))

_G, _I, _O, _S, _R, _P, _C = (q(p[1]) for p in PILLARS)
_TD = "try_cast(setting_token_lifetime_days as integer)"
_CS = [
    (_G, 1, "metastore_name <> ''", "Unity Catalog", "'Implemented'"),
    (_G, 2, "catalog_count > 0", "Catalog Count",
     "case when catalog_count > 100 then 'Critical Gap' when catalog_count > 20 then 'Gap' else 'Implemented' end"),
    (_G, 3, "external_location_count > 0", "External Locations",
     "case when external_location_count > 50 then 'Gap' else 'Implemented' end"),
    (_G, 4, "storage_credential_count > 0", "Storage Credentials",
     "case when storage_credential_count > 50 then 'Gap' else 'Implemented' end"),
    (_G, 5, "has_open_catalog", "Catalog Isolation", "'Gap'"),
    (_I, 1, "warehouse_count > 0", "SQL Warehouses", "case when warehouse_count < 20 then 'Implemented' else 'Gap' end"),
    (_I, 2, "true", "Cluster Policies",
     "case when policy_count = 0 then 'Critical Gap' when policy_count > 20 then 'Gap' else 'Implemented' end"),
    (_I, 3, "repo_count > 0", "Git Integration", "'Implemented'"),
    (_O, 1, "job_count > 0", "Job Management", "'Implemented'"),
    (_O, 2, "pipeline_count > 0", "DLT Pipelines", "case when failed_pipelines > 0 then 'Gap' else 'Implemented' end"),
    (_O, 3, "disabled_init_script_count > 0", "Global Init Scripts", "'Gap'"),
    (_O, 4, "untitled_notebook_count > 0", "Workspace Hygiene", "'Gap'"),
    (_O, 5, "pool_count > 0", "Instance Pools", "'Implemented'"),
    (_S, 1, "coalesce(setting_dbfs_browser, '') <> ''", "DBFS File Browser",
     "case when lower(setting_dbfs_browser) = 'true' then 'Critical Gap' else 'Implemented' end"),
    (_S, 2, "coalesce(setting_results_download, '') <> ''", "Results Downloading",
     "case when lower(setting_results_download) = 'true' then 'Gap' else 'Implemented' end"),
    (_S, 3, "coalesce(setting_export_notebook, '') <> ''", "Notebook Export",
     "case when lower(setting_export_notebook) = 'true' then 'Gap' else 'Implemented' end"),
    (_S, 4, "coalesce(setting_token_lifetime_days, '') <> ''", "Token Lifetime",
     f"case when {_TD} is null then 'Gap' when {_TD} <= 30 then 'Implemented' when {_TD} <= 90 then 'Gap' "
     "else 'Critical Gap' end"),
    (_S, 5, "true", "IP Access Lists", "case when ip_access_list_count > 0 and ipl_on then 'Implemented' else 'Gap' end"),
    (_S, 6, "token_count > 0", "Active Tokens", "'Implemented'"),
    (_S, 7, "scope_count > 0", "Secret Scopes", "'Implemented'"),
    (_R, 1, "failed_pipelines > 0", "DLT Pipelines", "'Critical Gap'"),
    (_R, 2, "cluster_count > 0", "Compute", "case when photon_clusters > 0 then 'Implemented' else 'Gap' end"),
    (_R, 3, "job_count > 0", "Job Resilience", "case when retry_jobs > 0 then 'Implemented' else 'Gap' end"),
    (_R, 4, "endpoint_count > 0", "Model Serving", "'Implemented'"),
    (_P, 1, "warehouse_count > 0", "SQL Warehouses", "'Implemented'"),
    (_P, 2, "cluster_count > 0", "Clusters", "'Implemented'"),
    (_C, 1, "cluster_count > 0", "Clusters",
     "case when running_clusters > 10 then 'Critical Gap' when autoterm_clusters = 0 then 'Gap' else 'Implemented' end"),
    (_C, 2, "cluster_count > 0", "Cost Tags", "case when tagged_clusters = cluster_count then 'Implemented' else 'Gap' end"),
    (_C, 3, "warehouse_count > 0", "SQL Warehouses", "case when warehouse_count < 20 then 'Implemented' else 'Gap' end"),
    (_C, 4, "true", "Cluster Policies", "case when policy_count > 0 then 'Implemented' else 'Critical Gap' end"),
]
# The finding of each area, by pillar and place.
_FINDING = {
    (_G, 1): "'Metastore ' || metastore_name", (_G, 2): "catalog_count || ' catalogs'",
    (_G, 3): "external_location_count || ' external locations'", (_G, 4): "storage_credential_count || ' storage credentials'",
    (_G, 5): "'Catalogs in OPEN isolation'", (_I, 1): "warehouse_count || ' warehouses'", (_I, 2): "policy_count || ' policies'",
    (_I, 3): "repo_count || ' repositories'", (_O, 1): "job_count || ' jobs (' || git_jobs || ' from Git)'",
    (_O, 2): "pipeline_count || ' pipelines, ' || failed_pipelines || ' failed'",
    (_O, 3): "disabled_init_script_count || ' of ' || init_script_count || ' scripts disabled'",
    (_O, 4): "untitled_notebook_count || ' untitled notebooks'", (_O, 5): "pool_count || ' pools'",
    (_S, 1): "case when lower(setting_dbfs_browser) = 'true' then 'Enabled' else 'Disabled' end",
    (_S, 2): "case when lower(setting_results_download) = 'true' then 'Enabled' else 'Disabled' end",
    (_S, 3): "case when lower(setting_export_notebook) = 'true' then 'Enabled' else 'Disabled' end",
    (_S, 4): "'Max ' || setting_token_lifetime_days || ' days'", (_S, 5): "ip_access_list_count || ' lists'",
    (_S, 6): "token_count || ' tokens'", (_S, 7): "scope_count || ' scopes'", (_R, 1): "failed_pipelines || ' failed pipelines'",
    (_R, 2): "cluster_count || ' clusters (' || photon_clusters || ' vectorized)'",
    (_R, 3): "retry_jobs || ' of ' || job_count || ' jobs retry'", (_R, 4): "endpoint_count || ' endpoints'",
    (_P, 1): "warehouse_count || ' warehouses (' || photon_wh || ' vectorized, ' || pro_or_serverless_wh || ' serverless)'",
    (_P, 2): "cluster_count || ' clusters (' || autoscale_clusters || ' autoscaling, ' || photon_clusters || ' vectorized)'",
    (_C, 1): "cluster_count || ' clusters, ' || running_clusters || ' running, ' || autoterm_clusters || ' with auto-termination'",
    (_C, 2): "tagged_clusters || ' of ' || cluster_count || ' clusters tagged'",
    (_C, 3): "warehouse_count || ' warehouses (' || autostop_wh || ' auto-stop)'", (_C, 4): "policy_count || ' policies'",
}
rep("current_state", "\n union all ".join(
    f"select workspace_id, {p} as pillar, {s} as seq, {q(a)} as area, {_FINDING[p, s]} as finding, {st} as status from wf where {c}"
    for p, s, c, a, st in _CS))

rep("next_steps", f""",
acts as (
  select workspace_id, list_filter([
    case when lower(coalesce(setting_dbfs_browser, '')) = 'true' then 'Disable the DBFS file browser.' end,
    case when contains(lower(coalesce(metastore_owner, '')), 'account')
         then 'Give the metastore to a dedicated admin group.' end,
    case when {_TD} > 30 then 'Lower token lifetime from ' || setting_token_lifetime_days || ' to 30 days.' end,
    case when running_clusters > 10 then 'Stop idle running clusters.' end,
    case when warehouse_count > 20 then 'Audit ' || warehouse_count || ' SQL warehouses for use.' end
  ], lambda x: x is not null) as l from wf),
ch as (
  select workspace_id,
         case when len(l) > 0 then l[1:5]
              else ['Prioritize findings by business impact.', 'Assign owners to each roadmap phase.',
                    'Schedule a follow-up assessment in 90 days.'] end as l
  from acts)
select workspace_id, cast(generate_subscripts(l, 1) as bigint) as seq, unnest(l) as action from ch""".replace(
    "\n,\n", ",\n", 1))

_CLOUD_SHORT = "case cloud when 'aws' then 'AWS' when 'azure' then 'Azure' when 'gcp' then 'GCP' else 'Unknown' end"
rep("score_sheet", f""",
s2 as (select scx.*, pd.pillar_ord, pd.display_name,
              min(ord) over (partition by workspace_id, scx.pillar, principle) as prank
       from scx join pd using (pillar)),
rowsx as (
  select workspace_id, pillar_ord, prank, 1 as kind, ord, '' as "Pillar", '' as "Principle",
         name as "Best Practice", 'Y' as "Relevant (Y/N)", cast(score as varchar) as "Score (0-2)",
         case when verified then 'Y' else 'N' end as "Verified"
  from s2
  union all
  select workspace_id, pillar_ord, prank, 0, min(ord), display_name, principle, '', '', '', null
  from s2 group by workspace_id, pillar_ord, display_name, principle, prank
  union all
  select distinct workspace_id, pillar_ord, 1000000, 2, 0, '', '', '', '', '', null from s2)
select rowsx.workspace_id, "Pillar", "Principle", "Best Practice", "Relevant (Y/N)", "Score (0-2)", "Verified",
       row_number() over (partition by rowsx.workspace_id order by pillar_ord, prank, kind, ord) as row_seq,
       {_CLOUD_SHORT} as "Cloud"
from rowsx left join wf using (workspace_id)""".replace("\n,\n", ",\n", 1))

rep("issue_counts", """
select workspace_id, count(*) filter (where score = 0 and verified) as critical,
       count(*) filter (where score = 1 and verified) as partial, count(*) filter (where score = 2) as healthy
from sc group by workspace_id""")
rep("rule_status", """
select workspace_id, ord, rule_id, pillar, score, verified,
       case when score = 0 then 'Not Implemented' when score = 1 and verified then 'Partial'
            when score = 1 then 'Unverifiable' else 'Implemented' end as status
from sc""")
rep("evidence_map", "select workspace_id, ord, rule_id, pillar, name from scx")
rep("score_bands", """
select workspace_id, pillar_ord, pillar,
       case when pct >= 70 then 'green' when pct >= 40 then 'orange' else 'red' end as pct_band,
       case when score >= 1.5 then 'green' when score >= 0.5 then 'orange' else 'red' end as score_band,
       case when contains(lower(maturity), 'optimized') or contains(lower(maturity), 'established') then 'green'
            when contains(lower(maturity), 'developing') then 'orange' else 'red' end as maturity_colour
from psum""")

_MATCH = f"""{_PATS},
m as (
  select cat.rule_id, min(pats.topic_ord) as topic_ord
  from cat join pats on contains(lower(cat.name), lower(pats.pattern)) group by cat.rule_id),
rm as (select cat.rule_id, m.topic_ord, t.topic from cat left join m using (rule_id)
       left join (select distinct topic_ord, topic from pats) t using (topic_ord))"""

rep("remediation_match", f""", {_MATCH}
select sc.workspace_id, sc.rule_id, rm.topic_ord, rm.topic from sc join rm using (rule_id)""".replace(
    "\n, ", ", ", 1).replace(", ", ",\n", 1))

_PLAN = f"""{_MATCH},
iss as (select scx.*, rm.topic from scx left join rm using (rule_id) where score < 2 and verified),
plan as (
  select workspace_id, pillar, ord, rule_id, name, score,
         row_number() over (partition by workspace_id, pillar order by score, ord) as seq, topic,
         case when topic is null then 'generic'
              when row_number() over (partition by workspace_id, pillar, topic order by score, ord) = 1 then 'full'
              else 'see_above' end as guidance
  from iss)"""

rep("remediation_plan", f",\n{_PLAN}\nselect * from plan")

_BASE_URL = ("case cloud " + " ".join(f"when {q(k)} then {q(v)}" for k, v in DOCS_BASE.items())
             + f" else {q(DOCS_BASE['aws'])} end")
rep("remediation_docs", f""",
{_PLAN}, {_LINKS},
fulls as (select distinct plan.workspace_id, plan.topic, wf.cloud from plan join wf using (workspace_id)
          where guidance = 'full')
select f.workspace_id, f.topic,
       row_number() over (partition by f.workspace_id, f.topic order by (l.cloud_key = 'all') desc, l.idx) as link_ord,
       l.label, {_BASE_URL.replace('cloud', 'f.cloud')} || '/' || ltrim(l.path, '/') as url
from fulls f join links l on l.topic = f.topic and (l.cloud_key = 'all' or l.cloud_key = f.cloud)""")

o.oracle("call_summary", ["call_log"], """
select workspace_id, count(*) as calls, round(coalesce(sum(duration_seconds), 0.0), 6) as total_seconds
from call_log group by workspace_id""")
o.oracle("call_entries", ["call_log"], """
select workspace_id, row_number() over (partition by workspace_id order by seq) as entry,
       case when coalesce(command_text, '') = '' then '(unknown command)' else command_text end as command,
       case when length(coalesce(output, '')) > 2000 then substr(output, 1, 2000) || chr(10) || chr(10) || '... [truncated]'
            when coalesce(output, '') = '' then '(no output)' else output end as output,
       duration_seconds
from call_log""")

# Cache round trips give the assessment unchanged.
o.ORACLES["rescore_from_cache"] = o.ORACLES["assessment"]
o.ORACLES["rescore_from_notes"] = o.ORACLES["assessment"]
o.oracle("call_log_flat", ["call_log"], """
select workspace_id, seq, collector, command_text as command,
       case when contains(command_text, '/api/2.0/sql/statements') then substr(output, 1, 2000) else output end as output,
       duration_seconds as duration, success, error
from call_log""")
o.oracle("collector_runs", ["call_log"], """
select workspace_id, collector, count(*) as calls, round(coalesce(sum(duration_seconds), 0.0), 6) as seconds,
       count(*) filter (where not success) as failed_calls,
       arg_max(error, case when error is not null then seq end) as error
from call_log group by workspace_id, collector""")
