"""The tables behind the assessment documents.

All inputs are per-workspace tables of bounded width: ``scores`` has 140 rows per
workspace, ``inputs`` one row. Every window is partitioned by workspace (and
pillar), so a window partition never holds more than one workspace's 140 rules.
Orders mirror the reference's stable sorts by ending with the rule order ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgrade.functions.numbering import numbered_within
from fleetgrade.plans.catalog import PILLARS, pillar_dim
from fleetgrade.plans.scoring import maturity

WS = "workspace_id"


def _pillar_dim(spark: SparkSession) -> DataFrame:
    return F.broadcast(pillar_dim(spark).select("pillar_ord", "pillar", "display_name"))


def display_name(pillar: Column) -> Column:
    out = pillar
    for _, name, disp, _p in PILLARS:
        out = F.when(pillar == name, F.lit(disp)).otherwise(out)
    return out


def pillar_summary(spark: SparkSession, pillar_scores: DataFrame, assessment: DataFrame) -> DataFrame:
    """G1: score, percentage and maturity per pillar in report order, plus an overall row."""
    rows = pillar_scores.join(_pillar_dim(spark), on="pillar").select(
        WS, "pillar_ord", "pillar", "display_name",
        F.coalesce(F.col("pillar_score"), F.lit(0.0)).alias("score"))
    rows = rows.select("*", (F.col("score") / 2.0 * 100.0).alias("pct"), maturity(F.col("score")).alias("maturity"))
    overall = assessment.select(
        WS, F.lit(len(PILLARS) + 1).alias("pillar_ord"), F.lit("Overall").alias("pillar"),
        F.lit("Overall Average").alias("display_name"), F.col("overall_score").alias("score"),
        (F.col("overall_score") / 2.0 * 100.0).alias("pct"), F.col("maturity"))
    return rows.unionByName(overall)


def verified_summary(spark: SparkSession, pillar_scores: DataFrame) -> DataFrame:
    """Verified percentage and coverage per pillar with a coverage band."""
    v = F.coalesce(F.col("pillar_verified_score"), F.lit(0.0))
    cov = F.coalesce(F.col("pillar_coverage"), F.lit(0.0))
    return pillar_scores.join(_pillar_dim(spark), on="pillar").select(
        WS, "pillar_ord", "pillar", "display_name",
        (v / 2.0 * 100.0).alias("verified_pct"), cov.alias("coverage_pct"),
        F.when(cov >= 60, "green").when(cov >= 40, "yellow").otherwise("red").alias("coverage_band"))


def pillar_stats(spark: SparkSession, scores: DataFrame, pillar_scores: DataFrame) -> DataFrame:
    """Rules and score counts per pillar plus a TOTAL row (mean of pillar means)."""
    s = F.col("score")
    per = scores.groupBy(WS, "pillar").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(s == 0).alias("score_0"), F.count_if(s == 1).alias("score_1"), F.count_if(s == 2).alias("score_2"))
    per = (per.join(pillar_scores.select(WS, "pillar", "pillar_score"), on=[WS, "pillar"])
           .join(_pillar_dim(spark), on="pillar")
           .select(WS, "pillar_ord", "display_name", "rules", "score_0", "score_1", "score_2",
                   F.col("pillar_score").alias("avg_score")))
    total = per.groupBy(WS).agg(
        F.lit(len(PILLARS) + 1).alias("pillar_ord"), F.lit("TOTAL").alias("display_name"),
        F.sum("rules").alias("rules"), F.sum("score_0").alias("score_0"), F.sum("score_1").alias("score_1"),
        F.sum("score_2").alias("score_2"), F.avg("avg_score").alias("avg_score"))
    out = per.unionByName(total)
    return out.select("*",
                      (F.col("score_0").cast("double") / F.col("rules") * 100.0).alias("pct_not_implemented"),
                      (F.col("score_2").cast("double") / F.col("rules") * 100.0).alias("pct_fully_implemented"))


def recommendations(scores: DataFrame) -> DataFrame:
    """Per pillar, rules scoring below 1.5, lowest first; P0/Critical for 0, else P1/High."""
    w = Window.partitionBy(WS, "pillar").orderBy("score", "ord")
    return scores.where(F.col("score") < 1.5).select(
        WS, "pillar", "ord", "rule_id", "name", "score",
        F.row_number().over(w).cast("bigint").alias("seq"),
        F.when(F.col("score") == 0, "P0").otherwise("P1").alias("priority"),
        F.when(F.col("score") == 0, "Critical").otherwise("High").alias("impact"),
        "finding_notes")


def critical_findings(scores: DataFrame, k: int = 15) -> DataFrame:
    """Zero scores ordered by pillar name, first ``k``."""
    w = Window.partitionBy(WS).orderBy("pillar", "ord")
    z = scores.where(F.col("score") == 0).select(
        WS, "pillar", "ord", "rule_id", "name", "finding_notes",
        F.row_number().over(w).cast("bigint").alias("rank"))
    return z.where(F.col("rank") <= k).withColumn("display_name", display_name(F.col("pillar")))


# Roadmap phases as (score, first, last, phase, effort, impact, verb).
ROADMAP_PHASES = (
    (0, 1, 6, 1, "Low-Medium", "Critical", ""),
    (0, 7, 12, 2, "Medium", "High", ""),
    (1, 1, 8, 3, "Medium-High", "High", "Improve: "),
    (1, 9, 14, 4, "High", "Medium", "Optimize: "),
)


def roadmap(scores: DataFrame) -> DataFrame:
    """Zero scores fill phases 1-2, partial scores phases 3-4, in rule order."""
    w = Window.partitionBy(WS, "score").orderBy("ord")
    r = scores.where(F.col("score").isin(0, 1)).select(
        WS, "ord", "rule_id", "name", "pillar", "score", "finding_notes",
        F.row_number().over(w).alias("pos"))
    phase = effort = impact = verb = None
    for sc, lo, hi, ph, ef, im, vb in reversed(ROADMAP_PHASES):
        cond = (F.col("score") == sc) & F.col("pos").between(lo, hi)
        phase = F.when(cond, F.lit(ph)).otherwise(phase if phase is not None else F.lit(None))
        effort = F.when(cond, F.lit(ef)).otherwise(effort if effort is not None else F.lit(None))
        impact = F.when(cond, F.lit(im)).otherwise(impact if impact is not None else F.lit(None))
        verb = F.when(cond, F.lit(vb)).otherwise(verb if verb is not None else F.lit(None))
    out = r.select(WS, "ord", "rule_id", "pillar", "score", phase.alias("phase"), effort.alias("effort"),
                   impact.alias("impact"),
                   F.when(F.col("score") == 0, F.concat_ws(": ", "name", "finding_notes"))
                   .otherwise(F.concat(verb, F.col("name"))).alias("action"))
    return out.where(F.col("phase").isNotNull()).withColumn("display_name", display_name(F.col("pillar")))


def unverified_rules(scores: DataFrame) -> DataFrame:
    """Unverified rules ordered by pillar name, numbered, with the workspace count."""
    w = Window.partitionBy(WS).orderBy("pillar", "ord")
    u = scores.where(~F.col("verified"))
    return u.select(WS, "pillar", "ord", "rule_id", "name", "finding_notes",
                    F.row_number().over(w).cast("bigint").alias("seq"),
                    F.count(F.lit(1)).over(Window.partitionBy(WS)).alias("unverified_count"))


def top_findings(scores: DataFrame, k: int = 10) -> DataFrame:
    """Lowest ``k`` by (score, pillar name) with risk level and the quick-fix flag of the zero's branch."""
    w = Window.partitionBy(WS).orderBy("score", "pillar", "ord")
    r = scores.select(
        WS, "ord", "rule_id", "pillar", "score",
        F.row_number().over(w).cast("bigint").alias("rank"),
        F.substring(F.concat_ws(" - ", "name", "finding_notes"), 1, 75).alias("finding"),
        F.when(F.col("score") == 0, "CRITICAL").when(F.col("score") <= 1, "HIGH").otherwise("MEDIUM").alias("risk"),
        F.when((F.col("score") == 0) & F.col("quick_fix"), "Yes").otherwise("No").alias("quick_fix"))
    return r.where(F.col("rank") <= k).withColumn("display_name", display_name(F.col("pillar")))


def pillar_highlights(scores: DataFrame) -> DataFrame:
    """Per pillar up to 5 strengths, 6 gaps, and 6 recommendations (gaps, then partials)."""
    text = F.substring(F.coalesce(F.col("finding_notes"), F.col("name")), 1, 65)
    w = Window.partitionBy(WS, "pillar", "score").orderBy("ord")
    ranked = scores.where(F.col("score").isin(0, 1, 2)).select(
        WS, "pillar", "ord", "score", "finding_notes", text.alias("text"),
        F.row_number().over(w).alias("pos"))
    strengths = ranked.where((F.col("score") == 2) & (F.col("pos") <= 5)).select(
        WS, "pillar", F.lit("strength").alias("kind"), "pos", "ord", "text")
    gaps = ranked.where((F.col("score") == 0) & (F.col("pos") <= 6)).select(
        WS, "pillar", F.lit("gap").alias("kind"), "pos", "ord", "text")
    # Recommendations: every gap with a note, then the first five partials, at most six.
    rec_src = ranked.where(((F.col("score") == 0) | ((F.col("score") == 1) & (F.col("pos") <= 5)))
                           & (F.coalesce(F.col("finding_notes"), F.lit("")) != ""))
    wr = Window.partitionBy(WS, "pillar").orderBy(F.desc(F.col("score") == 0), "ord")
    recs = (rec_src.select(WS, "pillar", "ord", F.substring("finding_notes", 1, 65).alias("text"),
                           F.row_number().over(wr).alias("pos"))
            .where(F.col("pos") <= 6)
            .select(WS, "pillar", F.lit("recommendation").alias("kind"), "pos", "ord", "text"))
    return strengths.unionByName(gaps).unionByName(recs).withColumn("pos", F.col("pos").cast("bigint"))


# Inventory lines of the summary, as (order, label, feature column).
INVENTORY_LINES = (
    (1, "Catalogs", "catalog_count"), (2, "External Locations", "external_location_count"),
    (3, "Storage Credentials", "storage_credential_count"), (4, "Running Clusters", "running_clusters"),
    (5, "SQL Warehouses", "warehouse_count"), (6, "Cluster Policies", "policy_count"),
    (7, "Instance Pools", "pool_count"), (8, "Jobs", "job_count"), (9, "DLT Pipelines", "pipeline_count"),
    (10, "Serving Endpoints", "endpoint_count"), (11, "Git Repos", "repo_count"),
    (12, "Secret Scopes", "scope_count"), (13, "Groups", "group_count"),
    (14, "IP Access Lists", "ip_access_list_count"), (15, "Workspace Objects", "workspace_object_count"),
)


def inventory_summary(inputs: DataFrame) -> DataFrame:
    """15 resource counts in long form."""
    arr = F.array(*[F.struct(F.lit(o).alias("line"), F.lit(lab).alias("resource"),
                             F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("count"))
                    for o, lab, c in INVENTORY_LINES])
    return inputs.select(WS, F.inline(arr))


def inventory_health(inputs: DataFrame) -> DataFrame:
    """11 resources with OK / WARNING / CRITICAL cut-offs."""
    def n(c):
        return F.coalesce(F.col(c), F.lit(0))

    lines = [
        (1, "Unity Catalog Catalogs", n("catalog_count"),
         F.when(n("catalog_count") > 100, "CRITICAL").when(n("catalog_count") > 20, "WARNING").otherwise("OK")),
        (2, "External Locations", n("external_location_count"),
         F.when(n("external_location_count") > 50, "WARNING").otherwise("OK")),
        (3, "Storage Credentials", n("storage_credential_count"),
         F.when(n("storage_credential_count") > 50, "WARNING").otherwise("OK")),
        (4, "Cluster Policies", n("policy_count"),
         F.when(n("policy_count") == 0, "CRITICAL").when(n("policy_count") > 50, "WARNING").otherwise("OK")),
        (5, "Running Clusters", n("running_clusters"),
         F.when(n("running_clusters") > 10, "CRITICAL").otherwise("OK")),
        (6, "SQL Warehouses", n("warehouse_count"), F.when(n("warehouse_count") > 20, "WARNING").otherwise("OK")),
        (7, "Instance Pools", n("pool_count"), F.when(n("pool_count") > 30, "WARNING").otherwise("OK")),
        (8, "DLT Pipelines", n("pipeline_count"), F.when(n("pipeline_count") > 0, "OK").otherwise("WARNING")),
        (9, "Serving Endpoints", n("endpoint_count"), F.lit("OK")),
        (10, "Secret Scopes", n("scope_count"), F.when(n("scope_count") > 0, "OK").otherwise("WARNING")),
        (11, "Git Repos", n("repo_count"), F.when(n("repo_count") > 0, "OK").otherwise("WARNING")),
    ]
    arr = F.array(*[F.struct(F.lit(o).alias("line"), F.lit(lab).alias("resource"),
                             c.cast("bigint").alias("count"), h.alias("health")) for o, lab, c, h in lines])
    return inputs.select(WS, F.inline(arr))


# Recommended value per security setting.
SETTING_EXPECTED = (
    ("enableDbfsFileBrowser", "false", "setting_dbfs_browser"),
    ("enableResultsDownloading", "false", "setting_results_download"),
    ("enableExportNotebook", "false", "setting_export_notebook"),
    ("enableIpAccessLists", "true", "setting_ip_access_lists"),
    ("maxTokenLifetimeDays", "30", "setting_token_lifetime_days"),
)
SETTING_ADVICE = {
    "enableDbfsFileBrowser": "Set to false: the DBFS browser allows data exfiltration.",
    "enableResultsDownloading": "Consider false for production workspaces.",
    "enableExportNotebook": "Consider false to protect code.",
    "enableIpAccessLists": "Keep enabled.",
    "maxTokenLifetimeDays": "Lower to 30 days or less.",
}


def setting_advice(inputs: DataFrame) -> DataFrame:
    """Expected vs actual value of each security setting, with advice."""
    arr = F.array(*[F.struct(F.lit(i + 1).alias("line"), F.lit(k).alias("setting"), F.col(c).alias("value"),
                             F.lit(exp).alias("expected"), F.lit(SETTING_ADVICE[k]).alias("_rec"))
                    for i, (k, exp, c) in enumerate(SETTING_EXPECTED)])
    rows = inputs.where(F.col("has_settings")).select(WS, F.inline(arr))
    good = F.lower(F.coalesce(F.col("value"), F.lit(""))) == F.col("expected")
    return rows.select(WS, "line", "setting", "value", "expected", good.alias("is_recommended"),
                       F.when(good, F.lit("Good: current value is recommended.")).otherwise(F.col("_rec"))
                       .alias("advice"))


def _finding(pillar: str, seq: int, cond: Column, area: str, text: Column, status: Column) -> Column:
    return F.when(cond, F.struct(F.lit(pillar).alias("pillar"), F.lit(seq).alias("seq"), F.lit(area).alias("area"),
                                 text.alias("finding"), status.alias("status")))


def current_state(inputs: DataFrame) -> DataFrame:
    """Per pillar, conditional (area, finding, status) rows derived from the features."""
    def n(c):
        return F.coalesce(F.col(c), F.lit(0))

    def s(v):
        return F.lit(v)

    def fmt(f, *cols):
        return F.format_string(f, *cols)

    setting = {k: F.lower(F.coalesce(F.col(c), F.lit(""))) for k, _e, c in SETTING_EXPECTED}
    token_days = F.col("setting_token_lifetime_days").try_cast("int")
    gov, intr, ops, sec, rel, perf, cost = (p[1] for p in PILLARS)
    cats = n("catalog_count")
    wh = n("warehouse_count")
    cl = n("cluster_count")
    items = [
        _finding(gov, 1, F.col("metastore_name") != "", "Unity Catalog", fmt("Metastore %s", F.col("metastore_name")),
                 s("Implemented")),
        _finding(gov, 2, cats > 0, "Catalog Count", fmt("%d catalogs", cats),
                 F.when(cats > 100, "Critical Gap").when(cats > 20, "Gap").otherwise("Implemented")),
        _finding(gov, 3, n("external_location_count") > 0, "External Locations",
                 fmt("%d external locations", n("external_location_count")),
                 F.when(n("external_location_count") > 50, "Gap").otherwise("Implemented")),
        _finding(gov, 4, n("storage_credential_count") > 0, "Storage Credentials",
                 fmt("%d storage credentials", n("storage_credential_count")),
                 F.when(n("storage_credential_count") > 50, "Gap").otherwise("Implemented")),
        _finding(gov, 5, F.col("has_open_catalog"), "Catalog Isolation", s("Catalogs in OPEN isolation"), s("Gap")),
        _finding(intr, 1, wh > 0, "SQL Warehouses", fmt("%d warehouses", wh),
                 F.when(wh < 20, "Implemented").otherwise("Gap")),
        _finding(intr, 2, F.lit(True), "Cluster Policies", fmt("%d policies", n("policy_count")),
                 F.when(n("policy_count") == 0, "Critical Gap").when(n("policy_count") > 20, "Gap")
                 .otherwise("Implemented")),
        _finding(intr, 3, n("repo_count") > 0, "Git Integration", fmt("%d repositories", n("repo_count")),
                 s("Implemented")),
        _finding(ops, 1, n("job_count") > 0, "Job Management",
                 fmt("%d jobs (%d from Git)", n("job_count"), n("git_jobs")), s("Implemented")),
        _finding(ops, 2, n("pipeline_count") > 0, "DLT Pipelines",
                 fmt("%d pipelines, %d failed", n("pipeline_count"), n("failed_pipelines")),
                 F.when(n("failed_pipelines") > 0, "Gap").otherwise("Implemented")),
        _finding(ops, 3, n("disabled_init_script_count") > 0, "Global Init Scripts",
                 fmt("%d of %d scripts disabled", n("disabled_init_script_count"), n("init_script_count")), s("Gap")),
        _finding(ops, 4, n("untitled_notebook_count") > 0, "Workspace Hygiene",
                 fmt("%d untitled notebooks", n("untitled_notebook_count")), s("Gap")),
        _finding(ops, 5, n("pool_count") > 0, "Instance Pools", fmt("%d pools", n("pool_count")), s("Implemented")),
        _finding(sec, 1, setting["enableDbfsFileBrowser"] != "", "DBFS File Browser",
                 F.when(setting["enableDbfsFileBrowser"] == "true", "Enabled").otherwise("Disabled"),
                 F.when(setting["enableDbfsFileBrowser"] == "true", "Critical Gap").otherwise("Implemented")),
        _finding(sec, 2, setting["enableResultsDownloading"] != "", "Results Downloading",
                 F.when(setting["enableResultsDownloading"] == "true", "Enabled").otherwise("Disabled"),
                 F.when(setting["enableResultsDownloading"] == "true", "Gap").otherwise("Implemented")),
        _finding(sec, 3, setting["enableExportNotebook"] != "", "Notebook Export",
                 F.when(setting["enableExportNotebook"] == "true", "Enabled").otherwise("Disabled"),
                 F.when(setting["enableExportNotebook"] == "true", "Gap").otherwise("Implemented")),
        _finding(sec, 4, setting["maxTokenLifetimeDays"] != "", "Token Lifetime",
                 fmt("Max %s days", F.col("setting_token_lifetime_days")),
                 F.when(token_days.isNull(), "Gap").when(token_days <= 30, "Implemented")
                 .when(token_days <= 90, "Gap").otherwise("Critical Gap")),
        _finding(sec, 5, F.lit(True), "IP Access Lists", fmt("%d lists", n("ip_access_list_count")),
                 F.when((n("ip_access_list_count") > 0) & F.col("ipl_on"), "Implemented").otherwise("Gap")),
        _finding(sec, 6, n("token_count") > 0, "Active Tokens", fmt("%d tokens", n("token_count")), s("Implemented")),
        _finding(sec, 7, n("scope_count") > 0, "Secret Scopes", fmt("%d scopes", n("scope_count")), s("Implemented")),
        _finding(rel, 1, n("failed_pipelines") > 0, "DLT Pipelines", fmt("%d failed pipelines", n("failed_pipelines")),
                 s("Critical Gap")),
        _finding(rel, 2, cl > 0, "Compute", fmt("%d clusters (%d vectorized)", cl, n("photon_clusters")),
                 F.when(n("photon_clusters") > 0, "Implemented").otherwise("Gap")),
        _finding(rel, 3, n("job_count") > 0, "Job Resilience",
                 fmt("%d of %d jobs retry", n("retry_jobs"), n("job_count")),
                 F.when(n("retry_jobs") > 0, "Implemented").otherwise("Gap")),
        _finding(rel, 4, n("endpoint_count") > 0, "Model Serving", fmt("%d endpoints", n("endpoint_count")),
                 s("Implemented")),
        _finding(perf, 1, wh > 0, "SQL Warehouses",
                 fmt("%d warehouses (%d vectorized, %d serverless)", wh, n("photon_wh"), n("pro_or_serverless_wh")),
                 s("Implemented")),
        _finding(perf, 2, cl > 0, "Clusters",
                 fmt("%d clusters (%d autoscaling, %d vectorized)", cl, n("autoscale_clusters"), n("photon_clusters")),
                 s("Implemented")),
        _finding(cost, 1, cl > 0, "Clusters",
                 fmt("%d clusters, %d running, %d with auto-termination", cl, n("running_clusters"),
                     n("autoterm_clusters")),
                 F.when(n("running_clusters") > 10, "Critical Gap").when(n("autoterm_clusters") == 0, "Gap")
                 .otherwise("Implemented")),
        _finding(cost, 2, cl > 0, "Cost Tags", fmt("%d of %d clusters tagged", n("tagged_clusters"), cl),
                 F.when(n("tagged_clusters") == cl, "Implemented").otherwise("Gap")),
        _finding(cost, 3, wh > 0, "SQL Warehouses", fmt("%d warehouses (%d auto-stop)", wh, n("autostop_wh")),
                 F.when(wh < 20, "Implemented").otherwise("Gap")),
        _finding(cost, 4, F.lit(True), "Cluster Policies", fmt("%d policies", n("policy_count")),
                 F.when(n("policy_count") > 0, "Implemented").otherwise("Critical Gap")),
    ]
    return (inputs.select(WS, F.explode(F.array(*items)).alias("f"))
            .where(F.col("f").isNotNull()).select(WS, "f.*"))


def next_steps(inputs: DataFrame, k: int = 5) -> DataFrame:
    """Conditional immediate actions, first ``k``; three defaults when none applies."""
    token_days = F.col("setting_token_lifetime_days").try_cast("int")
    actions = [
        (F.lower(F.coalesce(F.col("setting_dbfs_browser"), F.lit(""))) == "true", F.lit("Disable the DBFS file browser.")),
        (F.lower(F.coalesce(F.col("metastore_owner"), F.lit(""))).contains("account"),
         F.lit("Give the metastore to a dedicated admin group.")),
        (token_days > 30, F.format_string("Lower token lifetime from %s to 30 days.", F.col("setting_token_lifetime_days"))),
        (F.coalesce(F.col("running_clusters"), F.lit(0)) > 10, F.lit("Stop idle running clusters.")),
        (F.coalesce(F.col("warehouse_count"), F.lit(0)) > 20,
         F.format_string("Audit %d SQL warehouses for use.", F.col("warehouse_count"))),
    ]
    defaults = ["Prioritize findings by business impact.", "Assign owners to each roadmap phase.",
                "Schedule a follow-up assessment in 90 days."]
    arr = F.filter(F.array(*[F.when(c, a) for c, a in actions]), lambda x: x.isNotNull())
    chosen = F.when(F.size(arr) > 0, F.slice(arr, 1, k)).otherwise(F.array(*[F.lit(d) for d in defaults]))
    return inputs.select(WS, F.posexplode(chosen).alias("pos", "action")).select(
        WS, (F.col("pos") + 1).cast("bigint").alias("seq"), "action")


def cloud_short(cloud: Column) -> Column:
    return (F.when(cloud == "aws", "AWS").when(cloud == "azure", "Azure").when(cloud == "gcp", "GCP")
            .otherwise("Unknown"))


def score_sheet(spark: SparkSession, scores: DataFrame, inputs: DataFrame) -> DataFrame:
    """The score sheet rows: per pillar, a header per principle (first-appearance
    order) followed by its rules, then a blank separator row; cloud on every row."""
    pd_ = _pillar_dim(spark)
    sc = scores.join(pd_, on="pillar")
    prin_rank = F.min("ord").over(Window.partitionBy(WS, "pillar", "principle"))
    sc = sc.withColumn("_prank", prin_rank)
    rule_rows = sc.select(
        WS, "pillar_ord", "_prank", F.lit(1).alias("_kind"), "ord",
        F.lit("").alias("Pillar"), F.lit("").alias("Principle"), F.col("name").alias("Best Practice"),
        F.lit("Y").alias("Relevant (Y/N)"), F.col("score").cast("string").alias("Score (0-2)"),
        F.coalesce(F.col("finding_notes"), F.lit("")).alias("Finding/Notes"),
        F.when(F.col("verified"), "Y").otherwise("N").alias("Verified"))
    headers = sc.groupBy(WS, "pillar_ord", "display_name", "principle", "_prank").agg(F.min("ord").alias("ord")).select(
        WS, "pillar_ord", "_prank", F.lit(0).alias("_kind"), "ord",
        F.col("display_name").alias("Pillar"), F.col("principle").alias("Principle"), F.lit("").alias("Best Practice"),
        F.lit("").alias("Relevant (Y/N)"), F.lit("").alias("Score (0-2)"), F.lit("").alias("Finding/Notes"),
        F.lit(None).cast("string").alias("Verified"))
    blanks = sc.select(WS, "pillar_ord").distinct().select(
        WS, "pillar_ord", F.lit(10**6).alias("_prank"), F.lit(2).alias("_kind"), F.lit(0).alias("ord"),
        F.lit("").alias("Pillar"), F.lit("").alias("Principle"), F.lit("").alias("Best Practice"),
        F.lit("").alias("Relevant (Y/N)"), F.lit("").alias("Score (0-2)"), F.lit("").alias("Finding/Notes"),
        F.lit(None).cast("string").alias("Verified"))
    rows = rule_rows.unionByName(headers).unionByName(blanks)
    w = Window.partitionBy(WS).orderBy("pillar_ord", "_prank", "_kind", "ord")
    rows = rows.withColumn("row_seq", F.row_number().over(w).cast("bigint"))
    rows = rows.join(inputs.select(WS, cloud_short(F.col("cloud")).alias("Cloud")), on=WS, how="left")
    return rows.drop("pillar_ord", "_prank", "_kind", "ord")


def issue_counts(scores: DataFrame) -> DataFrame:
    """Verified zeros, verified ones, and all twos."""
    s, v = F.col("score"), F.col("verified")
    return scores.groupBy(WS).agg(
        F.count_if((s == 0) & v).alias("critical"), F.count_if((s == 1) & v).alias("partial"),
        F.count_if(s == 2).alias("healthy"))


def rule_status(scores: DataFrame) -> DataFrame:
    """Status label per rule."""
    s = F.col("score")
    return scores.select(
        WS, "ord", "rule_id", "pillar", "score", "verified",
        F.when(s == 0, "Not Implemented").when((s == 1) & F.col("verified"), "Partial")
        .when(s == 1, "Unverifiable").otherwise("Implemented").alias("status"))


def evidence_map(scores: DataFrame) -> DataFrame:
    """One row per rule with its note."""
    return scores.select(WS, "ord", "rule_id", "pillar", "name", "finding_notes")


def score_band(pct: Column) -> Column:
    """Colour of a 0-100 percentage."""
    return F.when(pct >= 70, "green").when(pct >= 40, "orange").otherwise("red")


def score_band_2(score: Column) -> Column:
    """Colour of a 0-2 score."""
    return F.when(score >= 1.5, "green").when(score >= 0.5, "orange").otherwise("red")


def maturity_colour(level: Column) -> Column:
    m = F.lower(F.coalesce(level, F.lit("")))
    return (F.when(m.contains("optimized") | m.contains("established"), "green")
            .when(m.contains("developing"), "orange").otherwise("red"))


def score_bands(pillar_summary_df: DataFrame) -> DataFrame:
    """G24 over the pillar summary."""
    return pillar_summary_df.select(
        WS, "pillar_ord", "pillar", score_band(F.col("pct")).alias("pct_band"),
        score_band_2(F.col("score")).alias("score_band"), maturity_colour(F.col("maturity")).alias("maturity_colour"))


def call_summary(call_log: DataFrame) -> DataFrame:
    """Number of calls and total seconds (numeric durations only)."""
    return call_log.groupBy(WS).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(F.col("duration_seconds").try_cast("double")), F.lit(0.0))
        .alias("total_seconds"))


OUTPUT_CUT = 2000


def call_entries(call_log: DataFrame, order_col: str = "seq") -> DataFrame:
    """Numbered entries with the command text and the output cut at 2000 chars.

    Entries are numbered by range partitions of (workspace, order) and offsets, so a
    workspace with most of the calls stays spread over tasks.
    """
    cmd = F.concat_ws(" ", F.col("command"))
    out = F.coalesce(F.col("output"), F.lit(""))
    return numbered_within(call_log, WS, [order_col], "entry").select(
        WS, (F.col("entry") + 1).alias("entry"),
        F.when((cmd == "") | F.col("command").isNull(), "(unknown command)").otherwise(cmd).alias("command"),
        F.when(F.length(out) > OUTPUT_CUT, F.concat(F.substring(out, 1, OUTPUT_CUT), F.lit("\n\n... [truncated]")))
        .when(out == "", "(no output)").otherwise(out).alias("output"),
        "duration_seconds")


def collector_runs(call_log: DataFrame) -> DataFrame:
    """Run summary per (workspace, collector): calls, seconds, failed calls, last error text."""
    return call_log.groupBy(WS, "collector").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("seconds"),
        F.count_if(~F.col("success")).alias("failed_calls"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))
