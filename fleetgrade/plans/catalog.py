"""Rule catalogue and pillar dimension (static, broadcast-sized: 140 and 7 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The seven pillars in report order, with display names and principles.
PILLARS = (
    ("gov", "Data & AI Governance", "Data & AI Governance",
     ("Establish governance processes", "Manage metadata centrally", "Track lineage and discovery",
      "Govern AI assets", "Define data quality standards", "Enforce standardized formats")),
    ("int", "Interoperability & Usability", "Interoperability & Usability",
     ("Standard integration patterns", "Open formats and standards", "Self-service and productivity",
      "Reusable data products")),
    ("ops", "Operational Excellence", "Operational Excellence",
     ("Dedicated operations", "Standardize CI/CD and MLOps", "Environment isolation",
      "Automated workflows", "Monitoring and capacity")),
    ("sec", "Security", "Security, Compliance & Privacy",
     ("Least privilege", "Data protection", "Network security", "Compliance")),
    ("rel", "Reliability", "Reliability",
     ("ACID and resilient storage", "Managed services", "Schema management", "Backup and recovery")),
    ("perf", "Performance", "Performance Efficiency",
     ("Scaling and serverless", "Data patterns", "Query optimization", "Monitoring")),
    ("cost", "Cost", "Cost Optimization",
     ("Optimized formats and compute", "Right-sizing", "Auto-scaling and termination", "Cost monitoring")),
)

# The 140 rules in catalogue order.
# id | name | principle | domains (comma separated)
RULES_TABLE = """
gov-001 | Establish governance process | Establish governance processes | Governance, Metadata Management
gov-002 | Manage metadata in one place | Manage metadata centrally | Unity Catalog, Metadata Management
gov-003 | Track lineage | Track lineage and discovery | Lineage, Data Discovery
gov-004 | Add descriptions | Manage metadata centrally | Metadata Management, Documentation
gov-005 | Allow discovery | Track lineage and discovery | Data Discovery, Catalog
gov-006 | Govern AI assets | Govern AI assets | MLOps, Model Registry, Feature Store
gov-007 | Centralize access control | Establish governance processes | Unity Catalog, IAM, Security
gov-008 | Configure audit logging | Establish governance processes | Audit, Compliance, Security
gov-009 | Audit events | Establish governance processes | Audit, Compliance
gov-010 | Define DQ standards | Define data quality standards | Data Quality, Governance
gov-011 | Use DQ tools | Define data quality standards | Data Quality, Expectations
gov-012 | Enforce standardized formats | Enforce standardized formats | Data Format, Delta Lake, Ingest
gov-013 | Account-level group management | Establish governance processes | IAM, Groups, SCIM, Identity
gov-014 | Prefer managed tables | Manage metadata centrally | Unity Catalog, Managed Tables, Storage
gov-015 | BROWSE privilege for discovery | Track lineage and discovery | Unity Catalog, Data Discovery, Privileges
int-001 | Standard integration patterns | Standard integration patterns | Integration, ETL, Connectors
int-002 | Optimized connectors | Standard integration patterns | Connectors, Ingest, Performance
int-003 | Certified partner tools | Standard integration patterns | Partner Ecosystem, Integration
int-004 | Reduce pipeline complexity | Standard integration patterns | Workflow Management, DLT, ETL
int-005 | Use IaC | Standard integration patterns | Infrastructure, Terraform, Deployments
int-006 | Open data formats | Open formats and standards | Delta Lake, Parquet, Data Format
int-007 | Secure sharing | Open formats and standards | Delta Sharing, Security, Data Sharing
int-008 | Open ML standards | Open formats and standards | MLflow, MLOps, Model Format
int-009 | Self-service | Self-service and productivity | SQL Warehouses, Notebooks, Workspace
int-010 | Serverless compute | Self-service and productivity | Compute, SQL Warehouses, Serverless
int-011 | Predefined compute templates | Self-service and productivity | Cluster Policies, Compute, Standardization
int-012 | AI productivity | Self-service and productivity | AI, Assistant, Productivity
int-013 | Reusable data products | Reusable data products | Data Products, Delta Sharing, Catalog
int-014 | Semantic consistency | Reusable data products | Semantic Layer, BI, Consistency
int-015 | UC for discovery | Track lineage and discovery | Unity Catalog, Data Discovery, Catalog
ops-001 | Dedicated ops team | Dedicated operations | Organization, Operations
ops-002 | Enterprise SCM | Standardize CI/CD and MLOps | Git, CI/CD, Source Control
ops-003 | Standardize CI/CD | Standardize CI/CD and MLOps | CI/CD, Deployments, Automation
ops-004 | MLOps processes | Standardize CI/CD and MLOps | MLOps, Model Registry, ML Lifecycle
ops-005 | Environment isolation | Environment isolation | Workspaces, Environments, Isolation
ops-006 | Catalog strategy | Environment isolation | Unity Catalog, Catalog, Governance
ops-007 | IaC deployments | Standardize CI/CD and MLOps | Terraform, IaC, Deployments
ops-008 | Standardize compute | Standardize CI/CD and MLOps | Cluster Policies, Compute, Standardization
ops-009 | Automated workflows | Automated workflows | Jobs, Workflows, Orchestration
ops-010 | Event-driven ingestion | Automated workflows | Auto Loader, Streaming, Ingest
ops-011 | ETL frameworks | Automated workflows | DLT, ETL, Delta Live Tables
ops-012 | Deploy-code ML | Standardize CI/CD and MLOps | MLOps, Model Serving, Deployment
ops-013 | Model registry | Standardize CI/CD and MLOps | MLflow, Model Registry, MLOps
ops-014 | Automate experiment tracking | Standardize CI/CD and MLOps | MLflow, Experiments, MLOps
ops-015 | Reuse ML infra | Standardize CI/CD and MLOps | ML, Compute, Infrastructure
ops-016 | Declarative management | Automated workflows | DLT, Pipelines, Declarative
ops-017 | Service limits | Monitoring and capacity | Limits, Capacity, Governance
ops-018 | Capacity planning | Monitoring and capacity | Capacity, Planning, Scalability
ops-019 | Monitoring processes | Monitoring and capacity | Monitoring, Alerting, Operations
ops-020 | Platform monitoring tools | Monitoring and capacity | Databricks SQL, Metrics, Monitoring
ops-021 | Automated rollbacks | Standardize CI/CD and MLOps | CI/CD, Rollback, Deployment
ops-022 | Workload identity federation | Standardize CI/CD and MLOps | CI/CD, Authentication, Identity Federation
ops-023 | Restart long-running clusters | Monitoring and capacity | Clusters, Security, Patching
ops-024 | Cluster utilization efficiency (deep) | Monitoring and capacity | System Tables, Compute, Utilization, Deep
sec-001 | Least privilege IAM | Least privilege | IAM, Unity Catalog, Access Control
sec-002 | Data protection transit/rest | Data protection | Encryption, Security, Data Protection
sec-003 | Network security | Network security | VPC, Firewall, Network
sec-004 | Shared responsibility | Compliance | Security, Cloud, Responsibility
sec-005 | Compliance requirements | Compliance | Compliance, Audit, Regulatory
sec-006 | System security monitoring | Compliance | Monitoring, Security, Detection
sec-007 | Generic controls | Compliance | Security, Policies, Controls
sec-008 | SSO configuration | Data protection | SSO, Identity, Authentication
sec-009 | SCIM provisioning | Least privilege | SCIM, Identity, Provisioning
sec-010 | Service principals for automation | Least privilege | Service Principals, Automation, Identity
sec-011 | Customer-managed VPC | Network security | VPC, Private Link, Network
sec-012 | Restrict DBFS root data storage | Data protection | DBFS, Storage, Data Protection
sec-013 | Failed login monitoring (deep) | Monitoring and compliance | System Tables, Audit, Auth Failures, Deep
sec-014 | Permission change audit (deep) | Monitoring and compliance | System Tables, Audit, Permissions, Deep
rel-001 | ACID format | ACID and resilient storage | Delta Lake, ACID, Storage
rel-002 | Resilient engine | ACID and resilient storage | Photon, Spark, Compute
rel-003 | Rescue invalid data | ACID and resilient storage | Auto Loader, Rescued Data, Ingest
rel-004 | Auto retries | Managed services | Jobs, Retries, Resilience
rel-005 | Scalable serving | Managed services | Model Serving, ML, Scalability
rel-006 | Managed services | Managed services | Jobs, Pipelines, Serverless
rel-007 | Layered storage | ACID and resilient storage | Storage, Delta Lake, Architecture
rel-008 | Reduce redundancy | ACID and resilient storage | Architecture, Data Duplication
rel-009 | Active schema mgmt | Schema management | Schema Evolution, Delta Lake
rel-010 | Constraints/expectations | Schema management | Constraints, Data Quality, Expectations
rel-011 | Data-centric ML | Schema management | ML, Data, Feature Store
rel-012 | ETL autoscaling | Managed services | DLT, Autoscaling, Pipelines
rel-013 | SQL warehouse autoscaling | Managed services | SQL Warehouses, Autoscaling
rel-014 | Regular backups | Backup and recovery | Backup, Delta Lake, DR
rel-015 | Streaming recovery | Backup and recovery | Streaming, Checkpoints, Recovery
rel-016 | Time travel recovery | Backup and recovery | Delta Lake, Time Travel, Recovery
rel-017 | Job automation recovery | Backup and recovery | Jobs, Retries, Recovery
rel-018 | DR pattern | Backup and recovery | DR, Replication, Availability
rel-019 | Service principal job ownership | Managed services | Service Principals, Jobs, Reliability
rel-020 | Job success rate (deep) | Resilient workloads | System Tables, Jobs, Success Rate, Deep
rel-021 | Recurring job failures (deep) | Resilient workloads | System Tables, Jobs, Recurring Failures, Deep
perf-001 | Scaling | Scaling and serverless | Autoscaling, Compute, Clusters
perf-002 | Serverless | Scaling and serverless | Serverless, SQL Warehouses, Compute
perf-003 | Data patterns | Data patterns | Data Layout, Partitioning, Z-Ordering
perf-004 | Parallel computation | Data patterns | Spark, Parallelism, Compute
perf-005 | Execution chain | Data patterns | DLT, Pipelines, Execution
perf-006 | Larger clusters | Scaling and serverless | Clusters, Compute, Sizing
perf-007 | Native Spark | Data patterns | Spark, Photon, Compute
perf-008 | Native engines | Data patterns | Photon, Compute, Performance
perf-009 | Hardware awareness | Data patterns | Compute, Instance Types, Hardware
perf-010 | Caching | Query optimization | Delta Cache, Caching, Performance
perf-011 | Compaction | Data patterns | Optimize, VACUUM, Delta Lake
perf-012 | Data skipping | Query optimization | Data Skipping, Z-Ordering, Performance
perf-013 | Avoid over-partition | Data patterns | Partitioning, Delta Lake, Data Layout
perf-014 | Join optimization | Query optimization | Joins, AQE, Query
perf-015 | Table statistics | Query optimization | Statistics, ANALYZE, Query
perf-016 | Test on production data | Query optimization | Testing, Validation, Performance
perf-017 | Prewarming | Query optimization | SQL Warehouses, Prewarm, Performance
perf-018 | Identify bottlenecks | Monitoring | Profiling, Diagnostics, Performance
perf-019 | Monitor queries | Monitoring | SQL, Query History, Monitoring
perf-020 | Monitor streaming | Monitoring | Streaming, DLT, Monitoring
perf-021 | Monitor jobs | Monitoring | Jobs, Cluster, Monitoring
perf-022 | Predictive optimization | Query optimization | Predictive Optimization, OPTIMIZE, VACUUM
perf-023 | Liquid clustering | Data patterns | Liquid Clustering, Delta Lake, Data Layout
perf-024 | Graviton instance types | Scaling and serverless | Graviton, Instance Types, AWS
perf-025 | Standard access mode | Scaling and serverless | Access Mode, Compute, UC
perf-026 | Query failure rate (deep) | Monitoring and tuning | System Tables, Query, Failure Rate, Deep
perf-027 | Slow query prevalence (deep) | Monitoring and tuning | System Tables, Query, Slow Queries, Deep
perf-028 | Warehouse utilization balance (deep) | Scaling and serverless | System Tables, Warehouse, Utilization, Deep
cost-001 | Optimized formats | Optimized formats and compute | Delta Lake, Compression, Storage
cost-002 | Job clusters | Optimized formats and compute | Jobs, Clusters, Compute
cost-003 | SQL for SQL | Right-sizing | SQL Warehouses, Compute, Workload
cost-004 | Up-to-date runtimes | Optimized formats and compute | DBR, Runtimes, Maintenance
cost-005 | GPU right workloads | Right-sizing | GPU, ML, Compute
cost-006 | Serverless | Optimized formats and compute | Serverless, SQL Warehouses, Compute
cost-007 | Right instance type | Right-sizing | Instance Types, Compute, Clusters
cost-008 | Efficient compute size | Right-sizing | Cluster Size, Workers, Compute
cost-009 | Performance engines | Optimized formats and compute | Photon, Performance, Compute
cost-010 | Auto-scaling | Auto-scaling and termination | Autoscaling, Clusters, SQL Warehouses
cost-011 | Auto-termination | Auto-scaling and termination | Auto-stop, SQL Warehouses, Clusters
cost-012 | Cluster policies costs | Right-sizing | Cluster Policies, Governance, Cost
cost-013 | Monitor costs | Cost monitoring | Cost, Tagging, Monitoring
cost-014 | Tag clusters | Cost monitoring | Tags, Clusters, Chargeback
cost-015 | Chargeback | Cost monitoring | Chargeback, Tags, Cost Allocation
cost-016 | Cost reports | Cost monitoring | Reporting, Cost, Analytics
cost-017 | Streaming balance | Right-sizing | Streaming, Cost, Throughput
cost-018 | On-demand vs reserved | Optimized formats and compute | Reserved, Spot, Instance Savings
cost-019 | Spot instance strategy | Right-sizing | Spot, AWS, Compute, Cost
cost-020 | Budget alerts | Cost monitoring | Budget, Alerts, Cost Monitoring
cost-021 | Idle cluster waste (deep) | Eliminate waste | System Tables, Compute, Idle, Deep
cost-022 | Cost trend analysis (deep) | Cost monitoring | System Tables, Billing, Trend, Deep
cost-023 | DBU concentration risk (deep) | Cost monitoring | System Tables, Billing, Concentration, Deep
"""

PILLAR_OF_PREFIX = {p[0]: p[1] for p in PILLARS}


def rules() -> list[tuple[int, str, str, str, str, list[str]]]:
    """(ord, rule_id, name, pillar, principle, domains) in catalogue order."""
    out = []
    for i, line in enumerate(l for l in RULES_TABLE.strip().splitlines() if l.strip()):
        rid, name, principle, domains = (x.strip() for x in line.split(" | "))
        out.append((i + 1, rid, name, PILLAR_OF_PREFIX[rid.split("-")[0]], principle,
                    [d.strip() for d in domains.split(",") if d.strip()]))
    return out


RULE_IDS = tuple(r[1] for r in rules())

CATALOG_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("pillar", T.StringType(), False),
    T.StructField("principle", T.StringType(), False),
    T.StructField("domains", T.ArrayType(T.StringType()), False),
])

PILLAR_SCHEMA = T.StructType([
    T.StructField("pillar_ord", T.IntegerType(), False),
    T.StructField("pillar", T.StringType(), False),
    T.StructField("display_name", T.StringType(), False),
    T.StructField("principles", T.ArrayType(T.StringType()), False),
])


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), CATALOG_SCHEMA)


def pillar_dim(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, p[1], p[2], list(p[3])) for i, p in enumerate(PILLARS)]
    return spark.createDataFrame(rows, PILLAR_SCHEMA)
