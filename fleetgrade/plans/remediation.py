"""Remediation knowledge base (25 topics, static and broadcast-sized) and G17-G19.

Topic names, the rule-name substrings each topic applies to, and documentation
paths are fixed values; the "why" and "steps" texts are our own summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrade.plans.catalog import rules

# Documentation base URL per cloud (unknown clouds use the aws one).
DOCS_BASE = {
    "aws": "https://docs.databricks.com/aws/en",
    "azure": "https://docs.databricks.com/azure/en",
    "gcp": "https://docs.databricks.com/gcp/en",
}

# Topics in match order, the name substrings they apply to, and
# their documentation links per cloud ("all" first, then the cloud's own).
TOPICS = [
    ("Unity Catalog Adoption", ["governance process", "metadata in one place", "centralize access"],
     {"all": [("Unity Catalog Setup", "/data-governance/unity-catalog/get-started"),
              ("Migration Guide (UCX)", "/data-governance/unity-catalog/migrate"),
              ("Best Practices", "/data-governance/unity-catalog/best-practices")]}),
    ("Data Quality with DLT Expectations", ["dq standards", "dq tools", "data quality"],
     {"all": [("DLT Expectations", "/delta-live-tables/expectations"),
              ("Monitor Data Quality", "/delta-live-tables/observability")]}),
    ("Audit Logging", ["audit logging", "audit events", "configure audit"],
     {"aws": [("Audit Logging (AWS)", "/administration-guide/account-settings/audit-logs"),
              ("System Tables", "/administration-guide/system-tables")],
      "azure": [("Audit Logging (Azure)", "/administration-guide/account-settings/azure-diagnostic-logs"),
                ("System Tables", "/administration-guide/system-tables")],
      "gcp": [("Audit Logging (GCP)", "/administration-guide/account-settings/audit-logs"),
              ("System Tables", "/administration-guide/system-tables")]}),
    ("Group Management and BROWSE Privilege", ["group management", "browse privilege", "account-level group"],
     {"all": [("SCIM Provisioning", "/administration-guide/users-groups/scim"),
              ("Account Groups", "/administration-guide/users-groups/groups"),
              ("BROWSE Privilege", "/data-governance/unity-catalog/manage-privileges/privileges#browse")]}),
    ("Managed Tables and External Locations", ["managed tables", "external location"],
     {"all": [("Managed vs External Tables", "/data-governance/unity-catalog/create-tables"),
              ("External Locations", "/data-governance/unity-catalog/manage-external-locations")]}),
    ("SSO and SCIM Configuration", ["sso config", "scim provisioning", "sso"],
     {"aws": [("SSO Setup (AWS)", "/administration-guide/users-groups/single-sign-on"),
              ("SCIM (AWS)", "/administration-guide/users-groups/scim/aad")],
      "azure": [("SSO Setup (Azure)", "/administration-guide/users-groups/single-sign-on"),
                ("SCIM (Azure)", "/administration-guide/users-groups/scim/aad")],
      "gcp": [("SSO Setup (GCP)", "/administration-guide/users-groups/single-sign-on"),
              ("SCIM (GCP)", "/administration-guide/users-groups/scim")]}),
    ("Network Security and VPC/VNET", ["network security", "customer-managed vpc", "ip access", "vpc"],
     {"aws": [("Customer-Managed VPC", "/administration-guide/cloud-configurations/aws/customer-managed-vpc"),
              ("Private Link", "/administration-guide/cloud-configurations/aws/privatelink"),
              ("IP Access Lists", "/security/network/front-end/ip-access-list")],
      "azure": [("VNET Injection", "/administration-guide/cloud-configurations/azure/vnet-inject"),
                ("Private Link", "/administration-guide/cloud-configurations/azure/private-link"),
                ("IP Access Lists", "/security/network/front-end/ip-access-list")],
      "gcp": [("PSC", "/administration-guide/cloud-configurations/gcp/private-service-connect"),
              ("IP Access Lists", "/security/network/front-end/ip-access-list")]}),
    ("Service Principals for Automation", ["service principal", "service principals for automation"],
     {"all": [("Service Principals", "/administration-guide/users-groups/service-principals"),
              ("OAuth M2M", "/dev-tools/auth/oauth-m2m")],
      "azure": [("Managed Identity", "/administration-guide/users-groups/service-principals#managed-identity")]}),
    ("DBFS Root Restriction", ["dbfs root", "restrict dbfs"],
     {"all": [("DBFS Best Practices", "/dbfs/best-practices"),
              ("Unity Catalog Volumes", "/data-governance/unity-catalog/create-volumes")]}),
    ("Failed Login and Permission Change Monitoring", ["failed login", "permission change audit"],
     {"all": [("Audit Log System Table", "/administration-guide/system-tables/audit-logs"),
              ("SQL Alerts", "/sql/user/alerts")]}),
    ("Cluster Policies", ["predefined compute", "standardize compute", "cluster policies cost", "compute templates"],
     {"all": [("Cluster Policies", "/administration-guide/clusters/policies"),
              ("Policy Best Practices", "/administration-guide/clusters/policy-best-practices")]}),
    ("Auto-Termination and Idle Cluster Waste", ["auto-termination", "idle cluster", "restart long-running", "always-on"],
     {"all": [("Auto-Termination", "/compute/configure#auto-termination"), ("Job Clusters", "/jobs/use-compute")]}),
    ("Serverless Compute and SQL Warehouses", ["serverless", "sql for sql", "serverless compute"],
     {"all": [("Serverless SQL Warehouses", "/compute/sql-warehouse/serverless"),
              ("Serverless Compute", "/compute/serverless")]}),
    ("Instance Type Optimization", ["graviton", "right instance", "instance type", "standard access mode"],
     {"aws": [("Graviton Support", "/compute/graviton"), ("Instance Types", "/compute/supported-instance-types")],
      "azure": [("VM Types", "/compute/supported-instance-types")],
      "gcp": [("Machine Types", "/compute/supported-instance-types")]}),
    ("Query Performance and Slow Queries", ["query failure", "slow query", "warehouse utilization"],
     {"all": [("Query Profile", "/sql/user/queries/query-profile"),
              ("Predictive Optimization", "/delta/predictive-optimization"),
              ("Query History System Table", "/administration-guide/system-tables/query-history")]}),
    ("Liquid Clustering and Predictive Optimization", ["liquid clustering", "predictive optimization"],
     {"all": [("Liquid Clustering", "/delta/clustering"),
              ("Predictive Optimization", "/delta/predictive-optimization")]}),
    ("CI/CD and Git Integration", ["standardize ci/cd", "enterprise scm", "git", "iac"],
     {"all": [("Databricks Repos", "/repos"), ("Asset Bundles (DABs)", "/dev-tools/bundles"),
              ("CI/CD Patterns", "/dev-tools/ci-cd"), ("Terraform Provider", "/dev-tools/terraform")]}),
    ("Job Retries and Resilience", ["auto retries", "job automation recovery", "job success rate", "recurring job failure"],
     {"all": [("Job Retries", "/jobs/settings#retries"), ("Task Orchestration", "/jobs/use-task-orchestration"),
              ("Job Run System Table", "/administration-guide/system-tables/lakeflow")]}),
    ("Cluster Utilization Efficiency", ["cluster utilization efficiency", "24/7"],
     {"all": [("Job Clusters", "/jobs/use-compute"),
              ("Compute System Table", "/administration-guide/system-tables/compute")]}),
    ("Auto-Scaling for ETL and DLT", ["etl autoscaling", "sql warehouse autoscaling", "auto-scaling", "scaling"],
     {"all": [("Cluster Autoscaling", "/compute/configure#autoscaling"),
              ("DLT Enhanced Autoscaling", "/delta-live-tables/settings#enhanced-autoscaling"),
              ("SQL Warehouse Scaling", "/compute/sql-warehouse/create#scaling")]}),
    ("Spot/Preemptible Instance Strategy", ["spot instance", "spot", "preemptible"],
     {"aws": [("Spot Instances", "/compute/configure#spot-instances")],
      "azure": [("Azure Spot VMs", "/compute/configure#spot-instances")],
      "gcp": [("Preemptible VMs", "/compute/configure#spot-instances")]}),
    ("Cost Monitoring and Budget Alerts", ["monitor costs", "cost reports", "budget alert", "cost trend", "concentration risk"],
     {"all": [("Billing System Table", "/administration-guide/system-tables/billing"),
              ("Budget Alerts", "/administration-guide/account-settings/budgets"),
              ("Cluster Tags", "/compute/configure#cluster-tags")],
      "aws": [("AWS Cost Explorer", "/administration-guide/account-settings/usage-analysis")],
      "azure": [("Azure Cost Management", "/administration-guide/account-settings/usage-analysis")]}),
    ("Reserved Instances and Committed Use", ["on-demand vs reserved", "reserved"],
     {"aws": [("Savings Plans", "/administration-guide/account-settings/usage-analysis")],
      "azure": [("Reserved Instances", "/administration-guide/account-settings/usage-analysis")],
      "gcp": [("Committed Use Discounts", "/administration-guide/account-settings/usage-analysis")]}),
    ("Job Clusters for Cost Efficiency", ["job cluster"],
     {"all": [("Job Compute", "/jobs/use-compute"), ("Job Cluster Configuration", "/jobs/settings#compute")]}),
    ("Tagging for Chargeback", ["tag cluster", "chargeback"],
     {"all": [("Cluster Tags", "/compute/configure#cluster-tags"),
              ("Tag-Based Billing", "/administration-guide/account-settings/usage-analysis")]}),
]

# Our own short guidance per topic (same order as TOPICS).
GUIDANCE = [
    ("A single catalog gives one place for permissions, lineage and audit.",
     ["Create a metastore and attach the workspace.", "Migrate tables from the legacy metastore.",
      "Grant access to groups, not users."]),
    ("Declared quality rules stop bad records before they spread downstream.",
     ["Add expectations to pipeline tables.", "Route failing rows to quarantine tables.", "Alert on expectation metrics."]),
    ("Audit trails are needed to investigate incidents and prove compliance.",
     ["Enable audit log delivery.", "Enable the access system tables.", "Schedule reviews of sensitive actions."]),
    ("Groups managed at account level keep access consistent across workspaces.",
     ["Sync groups from the identity provider.", "Grant BROWSE on catalogs for discovery."]),
    ("Managed tables get lifecycle, optimization and governance for free.",
     ["Create new tables as managed tables.", "Review external locations and retire unused ones."]),
    ("Central sign-on and provisioning remove orphaned accounts.",
     ["Configure single sign-on.", "Provision users and groups with SCIM."]),
    ("Private networking and IP restrictions shrink the attack surface.",
     ["Deploy into a customer-managed network.", "Enable private connectivity.", "Turn on IP access lists."]),
    ("Automation should not depend on personal credentials.",
     ["Create service principals for jobs and tools.", "Use OAuth machine-to-machine tokens.",
      "Transfer production job ownership."]),
    ("Data in the DBFS root is readable by every workspace user.",
     ["Disable the DBFS file browser.", "Move data to governed volumes or tables."]),
    ("Spikes in failed logins or permission changes signal attacks or drift.",
     ["Query the audit system table on a schedule.", "Alert on thresholds."]),
    ("Policies bound instance types, sizes and tags for every cluster.",
     ["Define a small set of policies per workload.", "Require a policy for cluster creation."]),
    ("Clusters left running burn spend without doing work.",
     ["Set auto-termination on all-purpose clusters.", "Run scheduled work on job clusters."]),
    ("Serverless compute starts fast and bills only for use.",
     ["Use serverless or pro SQL warehouses.", "Move notebooks and jobs to serverless compute."]),
    ("The right instance family lowers cost for the same work.",
     ["Prefer efficient instance families.", "Use standard access mode where possible."]),
    ("Failing and slow queries waste compute and block users.",
     ["Inspect query profiles of slow queries.", "Enable predictive optimization.", "Watch the query history table."]),
    ("Data layout decides how much data each query reads.",
     ["Use liquid clustering on large tables.", "Enable predictive optimization."]),
    ("Versioned, reviewed deployments make changes repeatable and reversible.",
     ["Keep code in Git folders.", "Deploy with asset bundles or Terraform.", "Run CI checks before deploys."]),
    ("Retries and orchestration absorb transient failures.",
     ["Configure task retries.", "Investigate jobs that fail repeatedly.", "Track run outcomes in system tables."]),
    ("Always-on clusters cost the most and are rarely busy.",
     ["Move scheduled work to job clusters.", "Review uptime in the compute system table."]),
    ("Autoscaling matches capacity to load.",
     ["Enable cluster autoscaling.", "Use enhanced autoscaling for pipelines.", "Allow multi-cluster warehouses."]),
    ("Spare capacity is much cheaper for fault-tolerant work.",
     ["Use spot or preemptible workers with on-demand drivers."]),
    ("Spend needs owners, budgets and alerts.",
     ["Report from the billing system table.", "Set budget alerts.", "Tag clusters for attribution."]),
    ("Commitments lower the price of steady usage.",
     ["Size steady usage.", "Buy reserved capacity or commitments."]),
    ("Job clusters cost less than all-purpose clusters for scheduled work.",
     ["Run jobs on job clusters.", "Share job clusters between tasks of a job."]),
    ("Tags let spend be charged back to teams.",
     ["Define mandatory tags.", "Enforce them through policies."]),
]

KB_SCHEMA = T.StructType([
    T.StructField("topic_ord", T.IntegerType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("applies_to", T.ArrayType(T.StringType()), False),
    T.StructField("why", T.StringType(), False),
    T.StructField("steps", T.ArrayType(T.StringType()), False),
    T.StructField("docs", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("path", T.StringType())])))),
])


def remediation_kb(spark: SparkSession) -> DataFrame:
    rows = []
    for i, ((topic, pats, docs), (why, steps)) in enumerate(zip(TOPICS, GUIDANCE)):
        rows.append((i + 1, topic, pats, why, steps,
                     {k: [(lab, path) for lab, path in v] for k, v in docs.items()}))
    return spark.createDataFrame(rows, KB_SCHEMA)


def remediation_match(spark: SparkSession) -> DataFrame:
    """Per rule, the first topic one of whose patterns is in the lower-cased name.

    Both sides are static reference data, so the map is made once where the plan is.
    """
    rows = []
    for r in rules():
        name = r[2].lower()
        hit = next(((i + 1, topic) for i, (topic, patterns, _docs) in enumerate(TOPICS) if any(p and p.lower() in name for p in patterns)), (None, None))
        rows.append((r[1], *hit))
    return spark.createDataFrame(rows, "rule_id string, topic_ord int, topic string")


def remediation_plan(scores: DataFrame, match: DataFrame) -> DataFrame:
    """Per pillar, verified rules scoring below 2, lowest score first.

    The first rule of a topic within a pillar carries the topic's steps
    (``full``); later ones refer back to it (``see_above``); rules without a
    topic get generic guidance.
    """
    issues = scores.where((F.col("score") < 2) & F.col("verified")).join(
        F.broadcast(match.select("rule_id", "topic_ord", "topic")), on="rule_id", how="left")
    by_pillar = Window.partitionBy("workspace_id", "pillar").orderBy("score", "ord")
    by_topic = Window.partitionBy("workspace_id", "pillar", "topic").orderBy("score", "ord")
    return issues.select(
        "workspace_id", "pillar", "ord", "rule_id", "name", "score",
        F.row_number().over(by_pillar).cast("bigint").alias("seq"),
        "topic",
        F.when(F.col("topic").isNull(), F.lit("generic"))
        .when(F.row_number().over(by_topic) == 1, F.lit("full"))
        .otherwise(F.lit("see_above")).alias("guidance"),
    )


def remediation_docs(plan: DataFrame, base: DataFrame, kb: DataFrame) -> DataFrame:
    """Documentation links of every topic a plan spells out, for the workspace's cloud."""
    full = plan.where(F.col("guidance") == "full").select("workspace_id", "topic").distinct()
    with_cloud = full.join(base.select("workspace_id", "cloud"), on="workspace_id", how="left")
    docs_base = F.create_map(*[x for k, v in DOCS_BASE.items() for x in (F.lit(k), F.lit(v))])
    k = F.broadcast(kb.select("topic", "docs"))
    links = with_cloud.join(k, on="topic").select(
        "workspace_id", "topic",
        F.coalesce(docs_base[F.col("cloud")], F.lit(DOCS_BASE["aws"])).alias("_base"),
        F.concat(F.coalesce(F.col("docs")["all"], F.array()),
                 F.coalesce(F.col("docs")[F.coalesce(F.col("cloud"), F.lit("unknown"))], F.array())).alias("_links"))
    return links.select(
        "workspace_id", "topic", "_base", F.posexplode("_links").alias("link_ord", "l")).select(
        "workspace_id", "topic", (F.col("link_ord") + 1).cast("bigint").alias("link_ord"),
        F.col("l.label").alias("label"),
        F.concat(F.col("_base"), F.lit("/"), F.regexp_replace(F.col("l.path"), "^/+", "")).alias("url"))
