"""The 140 rules as Column expressions over the per-workspace input row.

Every rule is an ordered list of branches ``(condition, score, verified, note)``;
the first branch whose condition holds wins, the last one has no condition. A
branch's ``verified`` flag is fixed by the branch (E2): scores 0 and 2 are always
verified, a 1 is unverified where the evidence cannot be read from the inputs.
Notes are our own wording; numbers in them come from the row.

Rules that reuse another rule's result are declared with ``same_as``. New rules
can be added at runtime with ``register_rule`` (the plug-in surface, E10).
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column
from pyspark.sql import functions as F

# A fifth member QUICK marks a zero that a setting alone would mend.
Branch = tuple[Column | None, int, bool, Column | str] | tuple[Column | None, int, bool, Column | str, bool]
QUICK = True
RULES: dict[str, Callable[[], list[Branch]]] = {}
ALIASES: dict[str, str] = {}


# Column expressions are immutable and reused by many rules; each one costs JVM
# calls to build, so shared ones are built once per Spark application.
_SHARED: dict[tuple, Column] = {}


def _app() -> str | None:
    from pyspark.sql import SparkSession

    from fleetgrade.session import app_id
    active = SparkSession.getActiveSession()
    return app_id(active) if active else None


def shared(fn):
    """Memoise a Column-building helper per application and arguments."""
    def wrapper(*args):
        key = (_app(), fn.__name__, args)
        if key not in _SHARED:
            _SHARED[key] = fn(*args)
        return _SHARED[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@shared
def C(name: str) -> Column:  # noqa: N802 - short column accessor for rule tables
    return F.col(name)


@shared
def N(name: str) -> Column:  # noqa: N802
    """Numeric feature with NULL read as 0 (the reference's ``or 0``)."""
    return F.coalesce(F.col(name), F.lit(0))


def txt(fmt: str, *cols: Column) -> Column:
    return F.format_string(fmt, *cols)


def rule(rule_id: str):
    def deco(fn):
        RULES[rule_id] = fn
        return fn
    return deco


def same_as(rule_id: str, source: str) -> None:
    ALIASES[rule_id] = source


def register_rule(rule_id: str, branches: Callable[[], list[Branch]]) -> None:
    """Plug-in surface: add or replace a rule's branches."""
    RULES[rule_id] = branches
    ALIASES.pop(rule_id, None)
    from fleetgrade.plans.scoring import clear_compiled
    clear_compiled()


def branches_of(rule_id: str) -> list[Branch]:
    src = ALIASES.get(rule_id, rule_id)
    if src not in RULES:
        return [(None, 0, True, "No scoring function defined.", QUICK)]
    return RULES[src]()


def compile_branches(rule_id: str) -> tuple[Column, list[int], list[bool], list[Column], list[bool]]:
    """(index of the first matching branch, scores, verified flags, notes, quick-fix flags) for one rule.

    Conditions are evaluated once into a branch index; score, flags and note are
    then picked by index, so each condition appears once in generated code.
    """
    bs = branches_of(rule_id)
    *conds, _last = bs
    idx = F.lit(len(bs) - 1)
    for i in range(len(conds) - 1, -1, -1):
        idx = F.when(conds[i][0], F.lit(i)).otherwise(idx)
    return idx, [b[1] for b in bs], [b[2] for b in bs], [_note(b[3]) for b in bs], [QUICK in b[4:] for b in bs]


def _note(n: Column | str) -> Column:
    return F.lit(n) if isinstance(n, str) else n


# ---------------------------------------------------------------------------
# Shared predicates
# ---------------------------------------------------------------------------

@shared
def metastore() -> Column:
    return F.coalesce(C("has_metastore"), F.lit(False))


@shared
def ms_name() -> Column:
    return C("metastore_name").isNotNull() & (C("metastore_name") != "")


@shared
def cats() -> Column:
    return N("catalog_count")


@shared
def uc_with_catalogs() -> Column:
    return ms_name() & (cats() > 0)


@shared
def cloud_known() -> Column:
    return C("cloud").isin("aws", "azure", "gcp")


@shared
def cloud_upper() -> Column:
    return F.upper(F.coalesce(C("cloud"), F.lit("unknown")))


# Per-cloud labels used in cloud-aware notes.
IDP_NAMES = {"azure": "Microsoft Entra ID", "gcp": "Google Cloud Identity"}
NETWORK_LABELS = {"aws": "customer-managed VPC with PrivateLink",
                  "azure": "VNet injection with Private Link",
                  "gcp": "customer-managed VPC with Private Service Connect"}
SPOT_LABELS = {"aws": "Spot instances", "azure": "Azure Spot VMs", "gcp": "Preemptible VMs"}
EFFICIENT_LABELS = {"aws": "Graviton", "azure": "Arm-based Dv5/Ev5", "gcp": "T2D/N2D"}


def by_cloud(mapping: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for cloud, label in mapping.items():
        out = F.when(C("cloud") == cloud, F.lit(label)).otherwise(out)
    return out


def literal(score: int, verified: bool, note: str) -> Callable[[], list[Branch]]:
    return lambda: [(None, score, verified, note)]


# ---------------------------------------------------------------------------
# Data & AI Governance
# ---------------------------------------------------------------------------

@rule("gov-001")
def _():
    return [
        (metastore() & (cats() > 100), 1, True, txt("Metastore with %d catalogs: catalog sprawl, formalize governance.", cats())),
        (metastore() & (cats() > 0), 2, True, txt("Metastore with %d catalogs: governance process in place.", cats())),
        (metastore(), 1, True, "Metastore present without catalogs; define a governance process."),
        (None, 0, True, "No metastore; adopt a central catalog and governance process.", QUICK),
    ]


@rule("gov-002")
def _():
    return [(metastore(), 2, True, txt("One metastore (%s) holds the metadata.", C("metastore_name"))),
            (None, 0, True, "No metastore; metadata is not managed centrally.", QUICK)]


@rule("gov-003")
def _():
    return [(ms_name(), 1, True, "Lineage available through the metastore; check it is used."),
            (None, 0, True, "No metastore, so no lineage.", QUICK)]


@rule("gov-004")
def _():
    return [(cats() > 100, 0, True, txt("%d catalogs; descriptions are unlikely to be maintained.", cats())),
            (cats() > 0, 1, True, "Catalogs present; check that objects carry descriptions."),
            (None, 0, True, "No catalogs to describe.")]


@rule("gov-005")
def _():
    return [(cats() > 100, 1, True, txt("%d catalogs make discovery hard; curate them.", cats())),
            (cats() > 0, 2, True, "Catalogs support data discovery."),
            (None, 0, True, "No catalogs; discovery not set up.", QUICK)]


@rule("gov-006")
def _():
    return [(N("endpoint_count") > 0, 1, True, txt("%d serving endpoints; govern the models behind them.", N("endpoint_count"))),
            (None, 0, True, "No serving endpoints; register models under governance.")]


@rule("gov-007")
def _():
    owner = F.lower(F.coalesce(C("metastore_owner"), F.lit("")))
    return [
        (owner.contains("account users") | owner.contains("account_users"), 0, True,
         txt("Metastore owned by '%s', which is too broad.", C("metastore_owner")), QUICK),
        (owner != "", 2, True, txt("Access control centralized; metastore owner %s.", C("metastore_owner"))),
        (F.coalesce(C("has_open_catalog"), F.lit(False)), 1, True, "Catalogs in OPEN isolation; isolate production catalogs."),
        (ms_name(), 1, True, "Metastore present; confirm central access control."),
        (None, 0, True, "No central access control."),
    ]


@rule("gov-008")
def _():
    # Quirk Q17: the security collector's counters default to 0, so the IP-list
    # count is always known once the workspace was scanned.
    return [(F.coalesce(C("has_settings"), F.lit(False)) | F.lit(True), 1, True,
             "Workspace configuration readable; audit logging partly confirmed."),
            (ms_name(), 1, True, "Metastore present; confirm audit logging through system tables."),
            (None, 0, True, "Nothing here records who did what; deliver audit logs.", QUICK)]


@rule("gov-009")
def _():
    return [(F.coalesce(C("has_settings"), F.lit(False)), 1, True,
             "Settings readable; set up systematic audit monitoring."),
            (None, 0, True, "No audit events seen.", QUICK)]


@rule("gov-010")
def _():
    return [(N("pipeline_count") > 0, 1, True, txt("%d pipelines; check quality expectations exist.", N("pipeline_count"))),
            (None, 0, True, "No data quality standards seen.", QUICK)]


@rule("gov-011")
def _():
    return [(N("pipeline_count") > 5, 1, True, txt("%d pipelines; check expectations are enforced.", N("pipeline_count"))),
            (N("pipeline_count") > 0, 1, True, "Some pipelines; widen data quality checks."),
            (None, 0, True, "No data quality tooling seen.")]


@rule("gov-012")
def _():
    return [(uc_with_catalogs(), 1, False,
             "Catalog in use, but the table formats cannot verify from the inventory."),
            (None, 0, True, "Standard formats not in evidence.")]


@rule("gov-013")
def _():
    return [(N("idp_synced") > 0, 2, True, txt("%d of %d groups synced from the identity provider.", N("idp_synced"), N("scim_count"))),
            (N("scim_count") > 0, 1, True, txt("%d groups, none synced from the identity provider.", N("scim_count"))),
            (None, 0, True, "No account-level groups.")]


@rule("gov-014")
def _():
    ext = N("external_location_count")
    return [
        ((cats() > 0) & (ext == 0), 2, True, "Catalogs without external locations: managed tables."),
        ((cats() > 0) & (ext > 0) & (F.try_divide(ext.cast("double"), F.greatest(cats(), F.lit(1)).cast("double")) > 0.5),
         0, True, txt("%d external locations for %d catalogs; move to managed tables.", ext, cats())),
        ((cats() > 0) & (ext > 0), 1, True, txt("%d external locations; prefer managed tables.", ext)),
        (None, 0, True, "No catalogs; managed tables not in use."),
    ]


@rule("gov-015")
def _():
    return [(uc_with_catalogs(), 1, True, "Catalog in use; grant BROWSE for discovery."),
            (None, 0, True, "No catalog; BROWSE privilege not applicable.", QUICK)]


# ---------------------------------------------------------------------------
# Interoperability & Usability
# ---------------------------------------------------------------------------

@rule("int-001")
def _():
    return [(N("dab_jobs") > 0, 1, True, txt("%d bundle-deployed jobs; extend the pattern.", N("dab_jobs"))),
            (N("job_count") > 0, 1, True, "Jobs present without a standard integration pattern."),
            (None, 0, True, "No integration pattern seen.")]


@rule("int-002")
def _():
    return [(N("connect_pipelines") > 0, 1, True, txt("%d connector or gateway pipelines.", N("connect_pipelines"))),
            (None, 1, True, "No connector pipelines seen; prefer native connectors.")]


@rule("int-003")
def _():
    return [(N("ip_access_list_count") > 0, 1, True, "IP access lists hint at external tools; confirm they are certified."),
            (None, 1, True, "Partner tools not seen in the inventory.")]


@rule("int-004")
def _():
    return [((N("pipeline_count") > 0) & (N("failed_pipelines") > 0), 1, True,
             txt("%d pipelines, %d failed.", N("pipeline_count"), N("failed_pipelines"))),
            (N("pipeline_count") > 0, 2, True, txt("%d declarative pipelines.", N("pipeline_count"))),
            (None, 0, True, "No declarative pipelines.", QUICK)]


@rule("int-005")
def _():
    return [(N("iac_jobs") > 0, 1, True, txt("%d jobs deployed as code; extend to all infrastructure.", N("iac_jobs"))),
            (None, 1, True, "No infrastructure-as-code deployments seen.")]


@rule("int-006")
def _():
    return [(uc_with_catalogs(), 2, True, "Open table format through the catalog."),
            (None, 0, True, "Open data formats not in evidence.")]


@rule("int-007")
def _():
    scope = F.coalesce(C("delta_sharing_scope"), F.lit(""))
    return [(scope.contains("EXTERNAL"), 2, True, txt("Sharing scope %s allows secure external sharing.", scope)),
            (scope != "", 1, True, txt("Sharing scope %s; consider external sharing.", scope)),
            (None, 1, True, "Secure sharing not configured.")]


@rule("int-008")
def _():
    return [(N("endpoint_count") > 0, 2, True, txt("%d serving endpoints on open ML tooling.", N("endpoint_count"))),
            (None, 0, True, "No open ML serving seen.")]


@rule("int-009")
def _():
    return [(N("warehouse_count") > 0, 2, True, txt("%d SQL warehouses for self-service.", N("warehouse_count"))),
            (None, 1, True, "No SQL warehouses for self-service.")]


@rule("int-010")
def _():
    return [(N("pro_or_serverless_wh") > 0, 2, True, txt("%d pro or serverless warehouses.", N("pro_or_serverless_wh"))),
            (N("warehouse_count") > 0, 1, True, "Warehouses present but none pro or serverless."),
            (None, 0, True, "No SQL warehouses.")]


@rule("int-011")
def _():
    return [(N("policy_count") > 20, 1, True, txt("%d cluster policies: too many to act as templates.", N("policy_count"))),
            (N("policy_count") > 0, 2, True, txt("%d cluster policies as compute templates.", N("policy_count"))),
            (None, 0, True, "No cluster policies.", QUICK)]


RULES["int-012"] = literal(1, False, "AI assistance usage is not verifiable from the inventory.")


@rule("int-013")
def _():
    scope = F.coalesce(C("delta_sharing_scope"), F.lit(""))
    return [(scope != "", 1, True, "Sharing configured; define reusable data products."),
            (None, 1, True, "No sharing; reusable data products not defined.")]


RULES["int-014"] = literal(1, False, "Semantic consistency is not verifiable from the inventory.")


@rule("int-015")
def _():
    return [(ms_name(), 2, True, txt("Catalog %s serves discovery.", C("metastore_name"))),
            (None, 0, True, "No catalog for discovery.")]


# ---------------------------------------------------------------------------
# Operational Excellence
# ---------------------------------------------------------------------------

RULES["ops-001"] = literal(1, False, "Cannot verify the operations team set-up from the inventory.")


@rule("ops-002")
def _():
    return [(N("repo_count") > 0, 2, True, txt("%d Git folders in use.", N("repo_count"))),
            (None, 1, True, "No Git folders seen.")]


@rule("ops-003")
def _():
    return [(N("git_jobs") > 0, 2, True, txt("%d of %d jobs run from Git.", N("git_jobs"), N("job_count"))),
            (N("job_count") > 0, 1, True, txt("%d jobs, none from Git.", N("job_count"))),
            (None, 0, True, "No jobs.")]


@rule("ops-004")
def _():
    return [(N("endpoint_count") > 0, 1, False,
             txt("%d serving endpoints; registry use cannot verify from the inventory.", N("endpoint_count"))),
            (None, 0, True, "No model registry use seen.")]


def _catalog_levels(two: str, one: str, none: str):
    return [(cats() >= 2, 2, True, txt(two, cats())), (cats() > 0, 1, True, one), (None, 0, True, none)]


@rule("ops-005")
def _():
    return _catalog_levels("%d catalogs separate environments.", "One catalog; add per-environment catalogs.",
                           "No environment isolation seen.")


@rule("ops-006")
def _():
    return _catalog_levels("%d catalogs: a catalog strategy exists.", "One catalog; define a dev/test/prod layout.",
                           "No catalog strategy.")


same_as("ops-007", "int-005")


@rule("ops-008")
def _():
    return [(N("policy_count") > 0, 2, True, txt("%d cluster policies standardize compute.", N("policy_count"))),
            (N("cluster_count") > 0, 1, True, "Clusters without policies."),
            (None, 0, True, "No cluster policies.")]


@rule("ops-009")
def _():
    return [(N("job_count") >= 3, 2, True, txt("%d automated jobs.", N("job_count"))),
            (N("job_count") > 0, 1, True, "A few jobs; automate more."),
            (None, 0, True, "No job or pipeline runs by itself yet.")]


RULES["ops-010"] = literal(1, False, "Event-driven ingestion is not verifiable from the inventory.")


@rule("ops-011")
def _():
    return [(N("pipeline_count") > 0, 2, True, txt("%d declarative pipelines.", N("pipeline_count"))),
            (None, 0, True, "No declarative pipelines.")]


@rule("ops-012")
def _():
    return [(N("endpoint_count") > 0, 2, True, txt("%d model serving endpoints.", N("endpoint_count"))),
            (None, 1, True, "No model serving seen.")]


same_as("ops-013", "ops-004")
RULES["ops-014"] = literal(1, False, "Experiment tracking is not verifiable from the inventory.")
RULES["ops-015"] = literal(1, False, "Reuse of ML infrastructure is not verifiable from the inventory.")
same_as("ops-016", "ops-011")
RULES["ops-017"] = literal(1, False, "Service limits are not verifiable from the inventory.")
RULES["ops-018"] = literal(1, False, "Capacity planning is not verifiable from the inventory.")


@rule("ops-019")
def _():
    return [((N("job_count") > 0) | (N("pipeline_count") > 0), 1, False,
             "Jobs or pipelines present; monitoring is not fully verifiable from the inventory."),
            (None, 1, False, "Monitoring is not fully verified from the inventory.")]


@rule("ops-020")
def _():
    return [(N("warehouse_count") > 0, 2, True, "SQL warehouses provide monitoring views."),
            (None, 1, True, "No platform monitoring tools seen.")]


@rule("ops-021")
def _():
    return [(N("git_jobs") > 0, 1, True, txt("%d jobs from Git; check rollback procedures.", N("git_jobs"))),
            (None, 0, True, "No Git-backed jobs; no rollback path.")]


@rule("ops-022")
def _():
    return [(N("sp_count") > 0, 1, True, txt("%d service principals; check federation for CI/CD.", N("sp_count"))),
            (None, 0, True, "No service principals.")]


@rule("ops-023")
def _():
    return [(N("running_no_autoterm") > 0, 0, True, txt("%d running clusters without auto-termination.", N("running_no_autoterm"))),
            (N("running_clusters") > 0, 1, True, txt("%d running clusters with auto-termination; restart them for patches.", N("running_clusters"))),
            (None, 2, True, "No long-running clusters.")]


@rule("ops-024")
def _():
    avg = F.try_divide(N("total_running_hours_30d").cast("double"), N("uptime_rows").cast("double"))
    return [(~C("compute_available"), 1, False, "Requires --deep scan: cluster timeline not available."),
            (N("uptime_rows") == 0, 1, True, "No cluster lifecycle rows."),
            (N("max_running_hours") > 500, 0, True,
             txt("%d clusters run around the clock, first %s; move their work to jobs or serverless.", N("always_on_rows"), F.coalesce(C("always_on_names"), F.lit("?")))),
            (avg > 200, 1, True, txt("Mean uptime %.0f h over %d clusters.", F.bround(avg, 0), N("uptime_rows"))),
            (None, 2, True, txt("%d active clusters, mean uptime %.0f h.", N("uptime_rows"), F.bround(avg, 0)))]


# ---------------------------------------------------------------------------
# Security
# ---------------------------------------------------------------------------

@rule("sec-001")
def _():
    return [(ms_name(), 2, True, "Catalog-based least-privilege access."),
            (None, 1, False, "Least privilege is not verifiable without a metastore.")]


def _cloud_advice(known_note: Column, unknown_note: str):
    return [(cloud_known(), 1, True, known_note), (None, 1, False, unknown_note)]


@rule("sec-002")
def _():
    return _cloud_advice(txt("Check encryption at rest and in transit on %s.", cloud_upper()),
                         "Encryption is not verifiable from the inventory.")


@rule("sec-003")
def _():
    ipl = N("ip_access_list_count")
    return [((ipl > 0) & F.coalesce(C("ipl_on"), F.lit(False)), 2, True, txt("%d IP access lists, enforced.", ipl)),
            (ipl > 0, 1, True, txt("%d IP access lists but enforcement is off.", ipl)),
            (None, 1, True, "No IP access lists.")]


RULES["sec-004"] = literal(1, False, "Shared responsibility is not verifiable from the inventory.")


@rule("sec-005")
def _():
    return [(F.coalesce(C("dbfs_off"), F.lit(False)) & F.coalesce(C("ipl_on"), F.lit(False)), 2, True,
             "DBFS browser off and IP access lists on."),
            (F.coalesce(C("has_settings"), F.lit(False)), 1, True, "Some security settings in place; review the rest."),
            (None, 1, False, "Compliance controls are not fully verified.")]


RULES["sec-006"] = literal(1, False, "System table monitoring is not verifiable from the inventory.")


@rule("sec-007")
def _():
    return [(F.coalesce(C("dbfs_off"), F.lit(False)), 2, True, "DBFS browser disabled."),
            (F.coalesce(C("has_settings"), F.lit(False)), 1, True, "Settings present; disable the DBFS browser."),
            (None, 1, False, "Generic controls are not fully verified.")]


@rule("sec-008")
def _():
    idp = by_cloud(IDP_NAMES, "your identity provider")
    return [(N("idp_synced") > 0, 2, True, txt("%d synced groups: SSO through %s.", N("idp_synced"), idp)),
            (N("scim_count") > 0, 1, True, txt("Groups exist but none synced; configure SSO with %s.", idp)),
            (None, 1, False, txt("SSO is not verifiable from the workspace; configure it with %s.", idp))]


@rule("sec-009")
def _():
    return [(N("idp_synced") >= 3, 2, True, txt("%d synced groups.", N("idp_synced"))),
            (N("idp_synced") > 0, 1, True, txt("Only %d synced groups.", N("idp_synced"))),
            (None, 0, True, "No provisioned groups.")]


@rule("sec-010")
def _():
    return [(N("sp_count") >= 3, 2, True, txt("%d service principals.", N("sp_count"))),
            (N("sp_count") > 0, 1, True, txt("Only %d service principals.", N("sp_count"))),
            (None, 0, True, "No service principals.")]


@rule("sec-011")
def _():
    net = by_cloud(NETWORK_LABELS, "customer-managed network with private links")
    return [(F.coalesce(C("ipl_on"), F.lit(False)), 1, True, txt("IP lists on (%s); check %s.", cloud_upper(), net)),
            (None, 0, True, txt("No network controls (%s); configure %s.", cloud_upper(), net), QUICK)]


@rule("sec-012")
def _():
    return [(F.coalesce(C("dbfs_off"), F.lit(False)), 2, True, "DBFS browser disabled."),
            (F.coalesce(C("has_settings"), F.lit(False)), 0, True, "DBFS browser enabled; disable it.", QUICK),
            (None, 1, False, "DBFS root access is not verifiable.")]


@rule("sec-013")
def _():
    n = N("failed_logins")
    return [(~C("audit_available"), 1, False, "Requires --deep scan: audit events not available."),
            (n > 50, 0, True, txt("%d failed logins in the window.", n), QUICK),
            (n > 10, 1, True, txt("%d failed logins in the window.", n)),
            (None, 2, True, txt("%d failed logins in the window.", n))]


@rule("sec-014")
def _():
    n = N("permission_changes")
    return [(~C("audit_available"), 1, False, "Requires --deep scan: audit events not available."),
            (n > 200, 0, True, txt("%d permission changes in the window.", n)),
            (n > 50, 1, True, txt("%d permission changes in the window.", n)),
            (None, 2, True, txt("%d permission changes in the window.", n))]


# ---------------------------------------------------------------------------
# Reliability
# ---------------------------------------------------------------------------

same_as("rel-001", "gov-012")


@rule("rel-002")
def _():
    return [(N("photon_clusters") > 0, 2, True, txt("%d clusters on the vectorized engine.", N("photon_clusters"))),
            (N("cluster_count") > 0, 1, True, "Clusters without the vectorized engine."),
            (None, 1, True, "Without clusters there is nothing to judge here.")]


@rule("rel-003")
def _():
    return [(N("pipeline_count") > 0, 1, False, "Pipelines present; rescue handling cannot verify from the inventory."),
            (None, 0, True, "No pipelines handling invalid data.")]


@rule("rel-004")
def _():
    return [(N("retry_jobs") > 0, 2, True, txt("%d jobs retry on failure.", N("retry_jobs"))),
            (N("job_count") > 0, 1, True, "Jobs without retries."),
            (None, 0, True, "No jobs.")]


same_as("rel-005", "ops-012")


@rule("rel-006")
def _():
    t = N("job_count") + N("pipeline_count") + N("warehouse_count")
    return [(t >= 3, 2, True, txt("%d managed jobs, pipelines and warehouses.", t)),
            (t > 0, 1, True, "Few managed services."),
            (None, 0, True, "No managed services.")]


@rule("rel-007")
def _():
    return [(cats() >= 2, 1, False, "Several catalogs; layered storage cannot verify from the inventory."),
            (cats() > 0, 1, True, "One catalog; add layers."),
            (None, 0, True, "No layered storage.")]


RULES["rel-008"] = literal(1, False, "Redundancy is not verifiable from the inventory.")


@rule("rel-009")
def _():
    return [(N("pipeline_count") > 0, 1, False, "Pipelines present; schema management cannot verify from the inventory."),
            (None, 1, True, "No pipelines to manage schemas.")]


same_as("rel-010", "rel-009")
RULES["rel-011"] = literal(1, False, "Data-centric ML is not verifiable from the inventory.")


@rule("rel-012")
def _():
    return [(N("autoscale_pipelines") > 0, 2, True, txt("%d autoscaling pipelines.", N("autoscale_pipelines"))),
            (N("pipeline_count") > 0, 1, True, "Pipelines without autoscaling."),
            (None, 0, True, "No pipelines.")]


@rule("rel-013")
def _():
    return [(N("multi_or_serverless_wh") > 0, 2, True, txt("%d warehouses scale out.", N("multi_or_serverless_wh"))),
            (N("warehouse_count") > 0, 1, True, "Warehouses without scaling."),
            (None, 0, True, "No warehouses.", QUICK)]


RULES["rel-014"] = literal(1, False, "Backups are not verifiable from the inventory.")


@rule("rel-015")
def _():
    return [(N("pipeline_count") > 0, 1, False, "Pipelines present; checkpoint recovery cannot verify from the inventory."),
            (None, 0, True, "No streaming recovery set-up.")]


@rule("rel-016")
def _():
    return [(uc_with_catalogs(), 2, True, "Catalog tables support time travel."),
            (None, 0, True, "Time travel not in evidence.")]


same_as("rel-017", "rel-004")
RULES["rel-018"] = literal(1, False, "Disaster recovery is not verifiable from the inventory.")


@rule("rel-019")
def _():
    return [((N("sp_count") > 0) & (N("sp_owned_jobs") > 0), 2, True,
             txt("%d of %d jobs owned by service principals.", N("sp_owned_jobs"), N("job_count"))),
            (N("sp_count") > 0, 1, True, "Service principals exist but own no job."),
            (N("job_count") > 0, 0, True, "People own the jobs; hand them to service principals.", QUICK),
            (None, 1, True, "No jobs.")]


@rule("rel-020")
def _():
    rate = N("success_rate_pct")
    return [(~C("jobs_available"), 1, False, "Requires --deep scan: job runs not available."),
            (N("total_runs") == 0, 1, True, "No job runs in the window."),
            (rate < 90, 0, True, txt("Job success rate %.2f%% over %d runs.", rate.cast("double"), N("total_runs"))),
            (rate < 98, 1, True, txt("Job success rate %.2f%% over %d runs.", rate.cast("double"), N("total_runs"))),
            (None, 2, True, txt("Job success rate %.2f%% over %d runs.", rate.cast("double"), N("total_runs")))]


@rule("rel-021")
def _():
    return [(~C("jobs_available"), 1, False, "Requires --deep scan: job runs not available."),
            (N("failing_jobs") == 0, 2, True, "No recurring job failures."),
            (N("chronic_jobs") >= 3, 0, True, txt("%d jobs with 5 or more failures.", N("chronic_jobs"))),
            (N("chronic_jobs") > 0, 1, True, txt("%d jobs with 5 or more failures.", N("chronic_jobs"))),
            (None, 1, True, txt("%d jobs failed, none chronically.", N("failing_jobs")))]


# ---------------------------------------------------------------------------
# Performance
# ---------------------------------------------------------------------------

@rule("perf-001")
def _():
    return [(N("autoscale_clusters") > 0, 2, True, txt("%d autoscaling clusters.", N("autoscale_clusters"))),
            (N("cluster_count") > 0, 1, True, "Clusters without autoscaling."),
            (None, 0, True, "No clusters.", QUICK)]


same_as("perf-002", "int-010")
RULES["perf-003"] = literal(1, False, "File layout optimization is not verifiable from the inventory.")


@rule("perf-004")
def _():
    return [(N("total_workers") > 0, 2, True, txt("%d workers across clusters.", N("total_workers"))),
            (N("cluster_count") > 0, 1, True, "Clusters without worker counts."),
            (None, 1, True, "Parallelism not in use.")]


same_as("perf-005", "ops-011")


@rule("perf-006")
def _():
    return [(N("max_workers") > 0, 2, True, txt("Clusters sized up to %d workers.", N("max_workers"))),
            (N("cluster_count") > 0, 1, True, "Cluster sizes unknown."),
            (None, 0, True, "No clusters.")]


same_as("perf-007", "rel-002")
same_as("perf-008", "rel-002")


@rule("perf-009")
def _():
    return [((N("cluster_count") > 0) & (N("node_type_count") > 1), 2, True, txt("%d instance types in use.", N("node_type_count"))),
            ((N("cluster_count") > 0) & (N("node_type_count") == 1), 1, True, txt("Single instance type %s.", C("node_type_sample"))),
            (None, 1, True, "Instance types not matched to workloads.")]


RULES["perf-010"] = literal(1, False, "Caching is not verifiable from the inventory.")
same_as("perf-011", "perf-003")
same_as("perf-012", "perf-003")
RULES["perf-013"] = literal(1, False, "Partitioning is not verifiable from the inventory.")
RULES["perf-014"] = literal(1, True, "Let the optimizer pick join strategies; review skewed joins.")
RULES["perf-015"] = literal(1, False, "Table statistics are not verifiable from the inventory.")
RULES["perf-016"] = literal(1, False, "Testing on production-sized data is not verifiable from the inventory.")


@rule("perf-017")
def _():
    return [(N("photon_wh") > 0, 2, True, txt("%d warehouses on the vectorized engine.", N("photon_wh"))),
            (N("warehouse_count") > 0, 1, True, "Warehouses without the vectorized engine."),
            (None, 1, True, "No warehouses.")]


@rule("perf-018")
def _():
    return [(N("warehouse_count") > 0, 2, True, "Query profiles available through warehouses."),
            (None, 1, True, "No warehouses for bottleneck analysis.")]


@rule("perf-019")
def _():
    return [(N("warehouse_count") > 0, 2, True, "Query history available through warehouses."),
            (None, 1, True, "No warehouses for query monitoring.")]


@rule("perf-020")
def _():
    return [(N("pipeline_count") > 0, 2, True, "Pipelines expose streaming metrics."),
            (None, 0, True, "No streaming monitoring.")]


@rule("perf-021")
def _():
    return [(N("job_count") > 0, 2, True, "Job runs are monitored."),
            (None, 0, True, "No jobs to monitor.")]


@rule("perf-022")
def _():
    return [(uc_with_catalogs(), 1, True, "Catalog tables can use predictive optimization."),
            (None, 0, True, "Predictive optimization not available.", QUICK)]


@rule("perf-023")
def _():
    return [(ms_name(), 1, True, "Catalog tables can use liquid clustering."),
            (None, 0, True, "Liquid clustering not available.")]


@rule("perf-024")
def _():
    eff = (F.when(C("cloud") == "aws", N("efficient_aws"))
           .when(C("cloud") == "azure", N("efficient_azure"))
           .when(C("cloud") == "gcp", N("efficient_gcp")).otherwise(F.lit(0)))
    label = by_cloud(EFFICIENT_LABELS, "cost-efficient")
    return [(N("cluster_count") == 0, 1, True, txt("No clusters; use %s instances.", label)),
            (eff > 0, 2, True, txt("%d of %d clusters on %s instances.", eff, N("cluster_count"), label)),
            (None, 0, True, txt("No %s instances among %d clusters.", label, N("cluster_count")))]


@rule("perf-025")
def _():
    std, none = N("standard_mode_clusters"), N("none_mode_clusters")
    return [(N("cluster_count") == 0, 1, True, "No clusters; use standard access mode."),
            ((std > 0) & (none == 0), 2, True, txt("%d clusters in standard access mode.", std)),
            (std > 0, 1, True, txt("%d standard clusters, %d without access mode.", std, none)),
            (none > 0, 0, True, txt("%d clusters without access mode.", none)),
            (None, 1, True, "Clusters in dedicated mode.")]


@rule("perf-026")
def _():
    rate = N("failure_rate_pct")
    return [(~C("query_available"), 1, False, "Requires --deep scan: query history not available."),
            (N("total_queries") == 0, 1, True, "No queries in the window."),
            (rate > 10, 0, True, txt("Query failure rate %.2f%% of %d queries.", rate.cast("double"), N("total_queries"))),
            (rate > 2, 1, True, txt("Query failure rate %.2f%% of %d queries.", rate.cast("double"), N("total_queries"))),
            (None, 2, True, txt("Query failure rate %.2f%% of %d queries.", rate.cast("double"), N("total_queries")))]


@rule("perf-027")
def _():
    pct = F.try_divide(N("slow_query_count").cast("double"), N("total_queries").cast("double")) * 100
    p95 = F.bround(F.bround(F.coalesce(C("p95_duration_ms"), F.lit(0.0)), 2) / 1000, 1)
    return [(~C("query_available"), 1, False, "Requires --deep scan: query history not available."),
            (N("total_queries") == 0, 1, True, "No queries in the window."),
            (pct > 5, 0, True, txt("%d slow queries of %d, P95 %.1f s.", N("slow_query_count"), N("total_queries"), p95)),
            (pct > 1, 1, True, txt("%d slow queries of %d, P95 %.1f s.", N("slow_query_count"), N("total_queries"), p95)),
            (None, 2, True, txt("%d slow queries of %d, P95 %.1f s.", N("slow_query_count"), N("total_queries"), p95))]


@rule("perf-028")
def _():
    top = F.try_divide(N("wh_top_count").cast("double"), N("total_queries").cast("double")) * 100
    return [(~C("query_available"), 1, False, "Requires --deep scan: query history not available."),
            ((N("wh_rows") == 0) | (N("total_queries") == 0), 1, True, "No warehouse utilization rows."),
            ((N("wh_rows") == 1) & (top > 90), 1, True, txt("One warehouse has %.1f%% of the queries and no other has any.", F.bround(top, 1))),
            (top > 80, 1, True, txt("One of %d warehouses has %.1f%% of the queries.", N("wh_rows"), F.bround(top, 1))),
            (None, 2, True, txt("Queries spread over %d warehouses.", N("wh_rows")))]


# ---------------------------------------------------------------------------
# Cost
# ---------------------------------------------------------------------------

same_as("cost-001", "gov-012")


@rule("cost-002")
def _():
    return [(N("job_cluster_jobs") > 0, 2, True, txt("%d jobs on job clusters.", N("job_cluster_jobs"))),
            (N("job_count") > 0, 1, True, "Jobs not using job clusters."),
            (None, 0, True, "No jobs.")]


@rule("cost-003")
def _():
    return [(N("warehouse_count") > 0, 2, True, "SQL warehouses serve SQL workloads."),
            (None, 1, True, "No SQL warehouses.")]


@rule("cost-004")
def _():
    cl = N("cluster_count") > 0
    return [(cl & (N("recent_runtime_clusters") > 0), 2, True, txt("%d clusters on recent runtimes.", N("recent_runtime_clusters"))),
            (cl & (N("versioned_clusters") > 0), 1, True, "No cluster on a recent runtime."),
            (cl, 1, True, "Runtime versions unknown."),
            (None, 1, True, "Keep runtimes current.")]


@rule("cost-005")
def _():
    return [(N("gpu_clusters") > 0, 1, True, txt("%d GPU clusters; confirm they run GPU work.", N("gpu_clusters"))),
            (N("cluster_count") > 0, 2, True, "No GPU clusters."),
            (None, 1, True, "No clusters.")]


same_as("cost-006", "int-010")


@rule("cost-007")
def _():
    return [(N("policy_count") > 0, 2, True, "Policies constrain instance types."),
            (None, 1, True, "No policies constraining instance types.")]


@rule("cost-008")
def _():
    return [(N("autoscale_clusters") > 0, 2, True, txt("%d autoscaling clusters.", N("autoscale_clusters"))),
            (N("cluster_count") > 0, 1, True, "Clusters with fixed size."),
            (None, 0, True, "No clusters.", QUICK)]


same_as("cost-009", "rel-002")


@rule("cost-010")
def _():
    t = N("autoscale_clusters") + N("multi_cluster_wh")
    return [(t > 0, 2, True, txt("%d clusters and %d warehouses scale automatically.", N("autoscale_clusters"), N("multi_cluster_wh"))),
            ((N("warehouse_count") > 0) | (N("cluster_count") > 0), 1, True, "Compute without autoscaling."),
            (None, 0, True, "No compute.", QUICK)]


@rule("cost-011")
def _():
    t = N("autoterm_clusters") + N("autostop_wh")
    return [(t > 0, 2, True, txt("%d clusters and %d warehouses stop automatically.", N("autoterm_clusters"), N("autostop_wh"))),
            ((N("warehouse_count") > 0) | (N("cluster_count") > 0), 1, True, "Compute without auto-termination."),
            (None, 0, True, "No compute.", QUICK)]


same_as("cost-012", "ops-008")
RULES["cost-013"] = literal(1, False, "Cost tagging is not verifiable from the inventory.")


@rule("cost-014")
def _():
    return [(N("tagged_clusters") > 0, 2, True, txt("%d tagged clusters.", N("tagged_clusters"))),
            (N("cluster_count") > 0, 1, True, "Clusters without tags."),
            (None, 0, True, "No clusters.")]


same_as("cost-015", "cost-013")
same_as("cost-016", "cost-013")
RULES["cost-017"] = literal(1, False, "Streaming versus batch balance is not verifiable from the inventory.")


@rule("cost-018")
def _():
    return _cloud_advice(txt("Review reserved capacity on %s.", cloud_upper()),
                         "Reserved capacity is not verifiable from the inventory.")


@rule("cost-019")
def _():
    label = by_cloud(SPOT_LABELS, "spot capacity")
    return [(N("cluster_count") == 0, 1, True, txt("No clusters; use %s for batch work.", label)),
            (N("spot_clusters") > 0, 2, True, txt("%d of %d clusters use %s.", N("spot_clusters"), N("cluster_count"), label)),
            (None, 1, True, txt("No %s among %d clusters.", label, N("cluster_count")))]


@rule("cost-020")
def _():
    return _cloud_advice(txt("Set budget alerts on %s.", cloud_upper()),
                         "Budget alerts are not verifiable from the inventory.")


@rule("cost-021")
def _():
    return [(~C("compute_available"), 1, False, "Requires --deep scan: cluster timeline not available."),
            (N("idle_rows") == 0, 2, True, "No idle clusters."),
            (N("idle_hours_30d") > 100, 0, True,
             txt("%d idle clusters with %.1f h in the window, first %s.", N("idle_rows"), C("idle_hours_30d"), F.coalesce(C("idle_names"), F.lit("?")))),
            (None, 1, True, txt("%d clusters with some idle time, %.1f h together.", N("idle_rows"), C("idle_hours_30d")))]


@rule("cost-022")
def _():
    tr, dbu = C("trend_pct_change"), F.bround(N("total_dbus_30d").cast("double"), 0)
    return [(~C("billing_available"), 1, False, "Requires --deep scan: billing not available."),
            (tr.isNull(), 1, True, txt("%.0f DBU, too little billing history for a trend.", dbu)),
            (tr > 20, 0, True, txt("Spend up %.1f%% to %.0f DBU.", tr, dbu)),
            (tr > 5, 1, True, txt("Spend up %.1f%% to %.0f DBU.", tr, dbu)),
            (None, 2, True, txt("Spend change %.1f%%, %.0f DBU.", tr, dbu))]


@rule("cost-023")
def _():
    total = N("total_dbus_30d")
    pct = F.try_divide(N("top_cluster_dbus").cast("double"), total.cast("double")) * 100
    return [(~C("billing_available"), 1, False, "Requires --deep scan: billing not available."),
            (C("top_cluster_dbus").isNull() | (total == 0), 1, True, "No per-cluster usage."),
            (pct > 50, 0, True, txt("One cluster takes %.1f%% of the usage.", F.bround(pct, 1))),
            (pct > 30, 1, True, txt("The top cluster takes %.1f%% of the usage.", F.bround(pct, 1))),
            (None, 2, True, txt("Usage is spread, the top cluster takes %.1f%%.", F.bround(pct, 1)))]


def all_rule_ids() -> list[str]:
    from fleetgrade.plans.catalog import RULE_IDS
    return list(RULE_IDS)


def check_complete() -> list[str]:
    """Catalogue ids without a scoring definition (empty when complete)."""
    return [r for r in all_rule_ids() if ALIASES.get(r, r) not in RULES]

