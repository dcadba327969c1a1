"""Plan properties that the scale design relies on."""

import pytest

import __spark_entry__ as entry
from fleetgrade.config import FIXTURE_CONFIG
from fleetgrade.operators import queries
from fleetgrade.sources.fixtures import Fixtures
from tests.conftest import SF001

QUERIES = entry.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = plan_of(QUERIES[key](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_topk_limits_groups_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = queries.warehouse_utilization(Fixtures(spark, SF001).query_history,
                                           FIXTURE_CONFIG.as_of_for("query_history"))
        plan = plan_of(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan
    assert "Partial" in plan[plan.index("WindowGroupLimit"):] or plan.count("WindowGroupLimit") >= 2


def test_percentile_never_uses_a_single_group_buffer(spark):
    plan = plan_of(QUERIES["query_stats"](spark, SF001))
    assert "percentile(" not in plan.lower().replace("percentile_approx", "")


@pytest.mark.parametrize("key,column", [
    ("daily_spend", "l_shipdate"), ("cluster_uptime", "l_shipdate"), ("job_run_stats", "o_orderdate"),
    ("warehouse_utilization", "ts"), ("audit_by_action", "ts"),
])
def test_window_filter_reaches_the_scan(spark, key, column):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(QUERIES[key](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The fixtures also count the suppliers (one per workspace); that scan has no window.
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "supplier.parquet" not in line]
    assert scans and all(f"GreaterThanOrEqual({column}" in line and f"LessThan({column}" in line for line in scans)


def test_materialised_assessment_has_cut_lineage(spark):
    """Roll-ups and reports read the written tables, not the operational sources."""
    from fleetgrade.plans.registered import assessed
    from fleetgrade.session import ensure_checkpoint_dir
    a = assessed(spark, SF001)
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    for df in (a.scores, a.inputs, a.assessment):
        plan = plan_of(df)
        locations = [line for line in plan.splitlines() if "FileScan parquet" in line]
        assert locations
        assert all("/fleetgrade/" in line and base.rstrip("/").split("/")[-1] in line for line in locations)
        assert "lineitem" not in plan and "events.parquet" not in plan


def test_count_lists_are_read_once(spark):
    """All small lists are counted in one scan and one aggregate of the landed pages."""
    from fleetgrade.sources import inventory
    from fleetgrade.sources.landing import landed
    plan = plan_of(inventory.object_counts(landed(spark, SF001)))
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_outdated_page_bodies_are_dropped_before_their_shuffle(spark):
    """Deciding on the current pages reads keys; bodies meet the decision in a semi join, not in an aggregate of all pages."""
    from fleetgrade.session import cut_lineage
    from fleetgrade.sources import snapshots
    rows = spark.createDataFrame([(1, "/api/2.0/repos", 0, "{}", 1, 1, 10)], snapshots.LANDING_SCHEMA)
    table = cut_lineage(rows, "landings")
    assert "body" not in plan_of(snapshots.current_sets(table))
    plan = plan_of(snapshots.current_pages(table))
    assert "LeftSemi" in plan and "Window" not in plan


def test_static_remediation_map_is_no_join(spark):
    from fleetgrade.plans import remediation
    assert "Join" not in plan_of(remediation.remediation_match(spark))


def test_service_principal_jobs_are_counted_without_a_last_join_of_jobs(spark):
    """Jobs are reduced to distinct creators before the index is asked, and not joined again."""
    from fleetgrade.operators.features import sp_owned_jobs
    fx = Fixtures(spark, SF001)
    plan = plan_of(sp_owned_jobs(fx.jobs, fx.service_principals))
    assert plan.count("Generate explode") <= 3 and "job_id" not in plan
