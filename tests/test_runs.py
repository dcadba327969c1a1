"""Landing runs, cached documents, committed calls, daily partials, incremental scores, rule tables."""

import datetime as dt
import json
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from fleetgrade.config import FIXTURE_CONFIG as CFG
from fleetgrade.functions.numbering import numbered, numbered_within
from fleetgrade.functions.percentile import exact_percentiles
from fleetgrade.functions.substring_join import containing_texts, count_containing
from fleetgrade.operators import audit, billing, compute, jobs, queries
from fleetgrade.plans import incremental, rule_table, scoring
from fleetgrade.plans.catalog import rule_catalog
from fleetgrade.plans.registered import assessed, deep_tables
from fleetgrade.sources import inventory as inv
from fleetgrade.sources import json_cache, rolling, snapshots, store
from fleetgrade.sources.fixtures import Fixtures
from fleetgrade.streaming.rescore import start_rescoring
from tests.conftest import SF001, SF01

CLUSTERS = inv.ENDPOINTS["clusters"]


def page(ws, n, landing, pages, at, *ids, endpoint=CLUSTERS):
    return (ws, endpoint, n, json.dumps({"clusters": [{"cluster_id": i, "state": "RUNNING"} for i in ids]}), landing, pages, at)


def landings(spark, rows):
    return spark.createDataFrame(rows, snapshots.LANDING_SCHEMA)


def ids_of(pages):
    return sorted((r["workspace_id"], r["cluster_id"]) for r in inv.clusters(pages).collect())


def test_newest_complete_run_counts(spark):
    rows = [page(1, 0, 1, 1, 10, "old"), page(1, 0, 2, 2, 20, "a"), page(1, 1, 2, 2, 21, "b"), page(1, 0, 3, 2, 30, "torn"),
            page(2, 0, 1, 2, 10, "x1"), page(2, 1, 1, 2, 90, "x2"),                      # completed late
            page(3, 0, 1, 1, 10, "first"), page(3, 0, 1, 1, 12, "again"), page(3, 0, 1, 1, 12, "again"),   # landed three times
            page(4, 0, 1, 2, 10, "half"), page(4, 5, 1, 2, 10, "outside"),
            page(5, 0, 1, 1, 10, "q", endpoint=CLUSTERS + "?count=9"), page(5, 0, 1, 1, 10, "q", endpoint=CLUSTERS + "?count=9")]
    got = snapshots.current_pages(landings(spark, rows))
    assert ids_of(got) == [(1, "a"), (1, "b"), (2, "x1"), (2, "x2"), (3, "again"), (5, "q")]
    report = {r["workspace_id"]: r for r in snapshots.landing_report(landings(spark, rows)).collect()}
    assert (report[1]["landing_used"], report[1]["landing_newest"], report[1]["incomplete_runs"], report[1]["stale"]) == (2, 3, 1, True)
    assert report[3]["repeated_pages"] == 2 and report[4]["landing_used"] is None and report[4]["stale"]
    assert snapshots.current_pages(landings(spark, [])).count() == 0


def test_stream_scores_pages_that_land_in_two_batches(spark):
    base = tempfile.mkdtemp(prefix="fg-two-")
    fx = Fixtures(spark, SF001)
    ws = fx.workspaces.where("workspace_id in (1, 2)")

    def run():
        start_rescoring(spark, f"{base}/pages", ws, None, CFG, f"{base}/out", f"{base}/ckpt", landings=True).awaitTermination(300)

    def score(rule):
        rows = spark.read.parquet(f"{base}/out").where(F.col("rule_id") == rule).orderBy("epoch").collect()
        return {r["workspace_id"]: r["score"] for r in rows}

    tagged = lambda ws_, n, landing, pages, tags: (ws_, CLUSTERS, n, json.dumps({"clusters": [{"cluster_id": f"c{n}", "custom_tags": tags}]}),
                                                   landing, pages, landing * 10 + n)
    snapshots.land_pages(landings(spark, [tagged(1, 0, 1, 1, {}), tagged(2, 0, 1, 1, {"a": "b"})]), f"{base}/pages")
    run()
    assert score("cost-014") == {1: 1, 2: 2}
    snapshots.land_pages(landings(spark, [tagged(1, 0, 2, 2, {"a": "b"})]), f"{base}/pages")     # half of the next run
    run()
    assert score("cost-014") == {1: 1, 2: 2}
    snapshots.land_pages(landings(spark, [tagged(1, 1, 2, 2, {})]), f"{base}/pages")
    run()
    assert score("cost-014") == {1: 2, 2: 2}


def test_json_documents_numbers_as_text_and_bad_documents(spark):
    deep = {"available": True, "compute_history": {"available": True, "total_running_hours_30d": 700.5, "cluster_uptime": [
        {"cluster_id": "c1", "cluster_name": "one", "running_hours": "600.5"}, {"cluster_id": "c2", "running_hours": 100}]},
        "query_history": {"available": True, "total_queries_30d": 10, "p95_duration_ms": "12.5", "warehouse_utilization": [{"warehouse_id": "w", "query_count": "7"}]},
        "job_runs": {"available": False, "top_failing_jobs": [{"job_id": "1", "failures": "6"}, {"job_id": "2", "failures": None}]}}
    body = {"ComputeCollector": {"cluster_count": 3, "clusters": [{"cluster_id": "a", "autoscale": {"max_workers": 4}}, {"cluster_id": "b"}], "policy_count": 2},
            "GovernanceCollector": {"catalogs": ["m", "n"], "catalog_count": 2, "isolation_modes": ["ISOLATED", "OPEN"], "metastore_summary": {"name": "ms"}},
            "OperationsCollector": {}, "SystemTablesCollector": deep, "_cloud_provider": "aws"}
    docs = spark.createDataFrame([(1, "collected", json.dumps(body)), (1, "scored", json.dumps({"workspace_host": "https://h", "best_practice_scores": [
        {"name": "Serverless", "pillar": "Cost", "score": 1, "finding_notes": "x", "verified": True}]})),
        (2, "collected", "{broken"), (3, "collected", "[1]"), (4, "audit", json.dumps([{"command": "ls", "output": "o", "duration": "1.5"}]))],
        "workspace_id long, kind string, body string")
    c = json_cache.read(docs, rule_catalog(spark))
    row = c.deep.where("workspace_id = 1").collect()[0]
    assert (row["uptime_rows"], row["max_running_hours"], row["always_on_names"], row["wh_top_count"], row["p95_duration_ms"]) == (2, 600.5, "one", 7, 12.5)
    assert row["compute_available"] and not row["jobs_available"] and not row["billing_available"] and row["chronic_jobs"] == 1
    from fleetgrade.operators.features import workspace_features
    f = {r["workspace_id"]: r for r in workspace_features(c.inventory).collect()}
    assert (f[1]["cluster_count"], f[1]["autoscale_clusters"], f[1]["has_open_catalog"], f[1]["policy_count"], f[1]["host"]) == (3, 1, True, 2, "https://h")
    assert f[2]["cluster_count"] == 0 and sorted((r["workspace_id"], r["kind"]) for r in c.rejected.collect()) == [(2, "collected"), (3, "collected")]
    assert [(r["rule_id"], r["score"]) for r in c.scores.collect()] == [("cost-006", 1)]
    assert [(r["command"], r["duration_seconds"]) for r in c.calls.collect()] == [("ls", 1.5)]


def test_json_documents_of_a_large_workspace_come_in_parts(spark):
    from fleetgrade.operators.features import workspace_features
    from fleetgrade.plans.registered import inventory
    a = assessed(spark, SF001)
    inv_ = inventory(spark, SF001)
    kept = ["job_id", "name", "has_git_source", "max_retries", "has_job_clusters", "creator_user_name"]
    more = spark.range(10**9, 10**9 + 5300).select(F.lit(3).alias("workspace_id"), F.col("id").alias("job_id"), F.lit("j").alias("name"), F.lit(False).alias("has_git_source"),
                                                   F.lit(0).alias("max_retries"), F.lit(False).alias("has_job_clusters"), F.lit("x").alias("creator_user_name"))
    inv_ = inv_ | {"jobs": inv_["jobs"].select("workspace_id", *kept).unionByName(more)}
    calls = spark.range(1000).select(F.when(F.col("id") < 900, 3).otherwise(1).alias("workspace_id"), (F.col("id") * 7919 % 1000).alias("seq"),
                                     F.col("id").cast("string").alias("command"), F.lit("o").alias("output"), F.lit(1.0).alias("duration_seconds"))
    inputs = a.inputs.withColumn("job_count", F.col("job_count") + F.when(F.col("workspace_id") == 3, 5302).otherwise(0))
    docs = json_cache.documents(inv_, inputs, {}, a.scores, calls).persist()
    sizes = docs.select(F.size(F.from_json(F.get_json_object("body", "$.OperationsCollector.jobs"), "array<string>")).alias("jobs"),
                        F.when(F.col("kind") == "audit", F.size(F.from_json("body", "array<string>"))).alias("calls"))
    most = sizes.agg(F.max("jobs"), F.max("calls")).first()
    assert 0 < most[0] < 2000 and 0 < most[1] <= 256
    c = json_cache.read(docs, rule_catalog(spark))
    docs.unpersist()
    got = {r["workspace_id"]: r for r in workspace_features(c.inventory).collect()}
    want = {r["workspace_id"]: r for r in workspace_features(inv_).collect()}
    same = ("cluster_count", "tagged_clusters", "warehouse_count", "git_jobs", "sp_owned_jobs", "has_open_catalog", "catalog_count", "scim_count", "sp_count", "policy_count", "dbfs_off")
    assert all([got[w][f] for f in same] == [want[w][f] for f in same] for w in want) and set(got) == set(want)
    assert {w: r["job_count"] for w, r in got.items()} == {w: r["job_count"] + 2 * (w == 3) for w, r in want.items()}     # two members that are no objects
    assert c.inventory["jobs"].count() == inv_["jobs"].count() and c.deep.count() == len(want) and c.scores.count() == a.scores.count()
    order = [r["command"] for r in c.calls.where("workspace_id = 3").orderBy("seq").collect()]
    assert order == sorted((str(i) for i in range(900)), key=lambda i: int(i) * 7919 % 1000)
    assert c.calls.where("workspace_id = 3").agg(F.max("seq"), F.count_distinct("seq")).first()[:] == (899, 900)


def test_calls_are_committed_once(spark):
    root = f"{tempfile.mkdtemp(prefix='fg-calls-')}/log"
    rows = [(1, i, f"collector_{'ab'[i % 2]}", "api post /api/2.0/sql/statements" if i % 2 else "ls", "x" * 2500, 1.0, True, None) for i in range(10)]
    schema = "workspace_id long, seq long, collector string, command string, output string, duration_seconds double, success boolean, error string"
    calls = spark.createDataFrame(rows, schema)
    assert store.manifest(spark, root).count() == 0
    calls.write.parquet(f"{root}/data/run=r1/attempt={uuid.uuid4().hex}")      # never committed
    assert store.commit_calls(calls.where("collector = 'collector_a'"), root, "r1") == 5
    assert store.commit_calls(calls, root, "r1") == 5                          # goes on with the other collector
    assert store.commit_calls(calls, root, "r1") == 0
    # Two attempts that raced: both wrote and both have a manifest entry.
    calls.write.parquet(f"{root}/data/run=r1/attempt=late")
    entry = spark.createDataFrame([("r1", "collector_a", "late", 5, dt.datetime(2999, 1, 1))], store._MANIFEST)
    entry.write.mode("append").parquet(f"{root}/manifest")
    back = store.read_calls(spark, root, schema).collect()
    assert sorted(r["seq"] for r in back) == list(range(10))
    assert {len(r["output"]) for r in back if r["command"] == "ls"} == {2500} and {len(r["output"]) for r in back if r["command"] != "ls"} == {2000}


def test_numbers_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 3 and 7, i % 5, "x" * (i % 4)) for i in range(200)], "g int, s int, t string").union(
        spark.createDataFrame([(None, 1, None)] * 5, "g int, s int, t string"))
    got = numbered(df, ["s", F.desc("t")], partitions=7).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(205)) and [r["s"] for r in got] == sorted(r["s"] for r in got)
    within = numbered_within(df, "g", ["s"], partitions=7).collect()
    for g in {r["g"] for r in within}:
        rows = sorted((r["number"], r["s"]) for r in within if r["g"] == g)
        assert [n for n, _ in rows] == list(range(len(rows))) and [s for _, s in rows] == sorted(s for _, s in rows)
    assert numbered(df.where("false"), ["s"]).count() == 0


def test_numbering_has_no_window_over_a_group(spark):
    from fleetgrade.plans.registered import call_log
    from fleetgrade.plans.reports import call_entries
    plan = call_entries(call_log(spark, SF001))._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_percentiles_of_fractions_and_huge_spreads(spark, bits):
    import random

    random.seed(bits)
    groups = {1: [random.random() / 1000 for _ in range(400)], 2: [-1e300, 1e300] + [1 + i * 1e-9 for i in range(300)], 3: [5.5] * 9,
              4: [float(i % 7) for i in range(100)] + [1e12], 5: [0.25]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(6, None), (1, None)], "g int, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, bucket_bits=bits).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            pos = p * (len(vs) - 1)
            lo, hi = int(pos), -int(-pos // 1)
            want = vs[lo] if lo == hi or vs[lo] == vs[hi] else (hi - pos) * vs[lo] + (pos - lo) * vs[hi]
            assert got[g][name] == pytest.approx(want, rel=1e-12)


def test_containment_by_rarest_gram(spark):
    import random

    random.seed(2)
    texts = [(i % 3, "".join(random.choices("abAB-", k=random.randint(0, 9)))) for i in range(300)] + [(0, None), (1, "sp-1-runner"), (1, "sp-1-runner")]
    names = [(i % 3, "".join(random.choices("ab-", k=random.randint(0, 5)))) for i in range(20)] + [(1, "SP-1"), (2, "zzz"), (0, None)]
    left, right = spark.createDataFrame(texts, "ws int, t string"), spark.createDataFrame(names, "ws int, p string")
    want = {w: sum(t is not None and any(x == w and p and p.lower() in t.lower() for x, p in names) for v, t in texts if v == w) for w in range(3)}
    got = {r["ws"]: r["n"] for r in count_containing(left, ["ws"], "t", right, "p", "n").collect()}
    assert got == {w: n for w, n in want.items() if n}
    few = containing_texts(left.select("ws", F.lower("t").alias("_t")).distinct().where("_t is not null"), ["ws"],
                           spark.createDataFrame([(1, "sp-1"), (1, "no such")], "ws int, _p string")).collect()
    assert [(r["ws"], r["_t"]) for r in few] == [(1, "sp-1-runner")]


def test_only_pieces_asked_for_go_on(spark):
    from fleetgrade.functions import substring_join
    texts = spark.range(3000).select((F.col("id") % 3).alias("ws"), F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.com")).alias("_t"))
    texts = texts.unionByName(spark.createDataFrame([(1, "sp-1-runner"), (2, "sp-1-runner")], "ws long, _t string"))
    of = spark.createDataFrame([(1, 3, "sp-"), (1, 3, "p-1")], "ws long, _size int, _g string")
    rows = substring_join.asked_pieces(texts, ["ws"], of).collect()
    assert {(r["_t"], r["_g"]) for r in rows} >= {("sp-1-runner", "sp-"), ("sp-1-runner", "p-1")}
    assert {r["ws"] for r in rows} == {1} and len(rows) < 1000      # 1,000 texts of 14 to 17 pieces each
    got = containing_texts(texts.withColumn("_n", F.lit(2)), ["ws"], spark.createDataFrame([(1, "sp-1")], "ws long, _p string")).collect()
    assert [tuple(r) for r in got] == [(1, "sp-1-runner", 2)]


def test_every_cut_drops_rows(spark):
    """The inputs reach each top-k cut, so a wrong cut shows in the checked tables."""
    t, d = deep_tables(spark, SF01), CFG.lookback_days
    at = CFG.as_of_for
    big = {"k": 10**6}
    for cut, args, k in (
            (billing.spend_by_sku, (t["usage"], at("usage"), d), {}), (billing.top_cost_clusters, (t["usage"], at("usage"), d), {}),
            (compute.cluster_uptime, (t["cluster_timeline"], at("cluster_timeline"), d), {}),
            (compute.idle_clusters, (t["cluster_timeline"], t["job_runs"], at("cluster_timeline"), d), {}),
            (queries.warehouse_utilization, (t["query_history"], at("query_history"), d), {}),
            (jobs.top_failing_jobs, (t["job_runs"], at("job_runs"), d), {}), (audit.audit_by_action, (t["audit"], at("audit"), d), {})):
        assert cut(*args).count() < cut(*args, **big).count(), cut.__name__
    calls = Fixtures(spark, SF01).call_log
    assert calls.where("length(output) > 2000 and contains(command_text, '/sql/statements')").count() > 0


def test_daily_partials_one_day_at_a_time(spark):
    tables, root = deep_tables(spark, SF001), f"{tempfile.mkdtemp(prefix='fg-days-')}/days"
    for back in range(3, -1, -1):      # four daily runs, the last one twice
        last = {n: CFG.as_of_for(n) - dt.timedelta(days=back) for n in tables}
        rolling.update(tables, root, last)
    rolling.update(tables, root, last)
    _, shared = rolling.merged(spark, root, CFG)
    got = {(r["workspace_id"], r["action_name"]): (r["event_count"], r["error_count"]) for r in shared["action_counts"].collect()}
    want = {(r["workspace_id"], r["action_name"]): (r["event_count"], r["error_count"])
            for r in audit.action_counts(tables["audit"], CFG.as_of_for("audit"), 3).collect()}
    assert got == want and want


def test_only_changed_workspaces_are_scored(spark):
    a = assessed(spark, SF001)
    stored = incremental.with_digest(a.inputs.withColumn("job_count", F.when(F.col("workspace_id") == 4, 12345).otherwise(F.col("job_count"))))
    stored_scores = a.scores.withColumn("score", F.when(F.col("workspace_id") == 4, -1).otherwise(F.col("score")))
    scores, changed = incremental.rescore(a.inputs, stored, stored_scores, CFG.as_of)
    assert [r["workspace_id"] for r in changed.collect()] == [4]
    key = lambda df: sorted(map(tuple, df.select("workspace_id", "rule_id", "score", "verified").collect()))
    assert key(scores) == key(a.scores)
    other = stored.withColumn("version", F.lit("other rules"))
    assert incremental.rescore(a.inputs, other, stored_scores, CFG.as_of)[1].count() == a.inputs.count()


def test_rule_table_faults_come_together(spark):
    a = assessed(spark, SF001)
    cols = "rule_id string, seq int, condition string, score int, verified boolean, note string, name string, pillar string, principle string, ord int"
    bad = [("ops-001", 1, "no_such_column > 1", 0, True, "x", None, None, None, None), ("ops-001", 2, None, 3, True, "x", None, None, None, None),
           ("ops-002", 1, "cluster_count +", 0, True, "x", None, None, None, None), ("ops-002", 2, "cluster_count > 1", 2, False, "{nothing}", None, None, None, None),
           ("new-001", 1, "cluster_count", 2, True, "x", "n", "No Pillar", "p", 1), ("new-002", 1, None, 2, True, "x", None, None, None, None),
           ("new-001", 2, None, 2, True, "x", None, None, None, None)]
    with pytest.raises(rule_table.RuleTableError) as e:
        rule_table.read_rules(spark.createDataFrame(bad, cols), a.inputs)
    text = str(e.value)
    for part in ("ops-001 branch 1: condition does not fit", "ops-001 branch 2: score 3", "ops-002 branch 1: condition does not parse",
                 "ops-002 branch 2: the last branch", "ops-002 branch 2: note names 'nothing'", "new-001 branch 1: unknown pillar",
                 "new-001 branch 1: condition is bigint", "new-002 branch 1: is not in the catalogue"):
        assert part in text, part
    fine = spark.createDataFrame([("ops-001", 1, "cluster_count > 0", 2, True, "{cluster_count} clusters", None, None, None, None),
                                  ("ops-001", 2, None, 1, False, "none", None, None, None, None)], cols)
    scores = rule_table.score_with_table(a.inputs, fine)
    assert scores.where("rule_id = 'ops-001'").count() == a.inputs.count() and scores.count() == a.scores.count()
    assert scoring.score_rules(a.inputs.drop("idle_names", "always_on_names", "always_on_rows")).count() == a.scores.count()


def test_values_in_other_forms(spark):
    body = {"clusters": [{"cluster_id": 7, "num_workers": "4", "autoscale": {"max_workers": "8"}, "custom_tags": {"a": 1}},
                         {"cluster_id": "b", "num_workers": "many", "autoscale": None, "auto_termination_minutes": 30.0}, "junk"]}
    p = spark.createDataFrame([(1, CLUSTERS, 0, json.dumps(body))], inv.PAYLOAD_SCHEMA)
    rows = {r["cluster_id"]: r for r in inv.clusters(p).collect()}
    assert (rows["7"]["num_workers"], rows["7"]["autoscale"]["max_workers"], rows["7"]["custom_tags"]) == (4, 8, {"a": "1"})
    assert rows["b"]["num_workers"] is None and rows["b"]["autoscale"] is None and rows["b"]["auto_termination_minutes"] == 30
    assert [(r["field"], r["value"]) for r in inv.rejected_fields(p, "clusters", "clusters").collect()] == [("num_workers", '"many"')]
    assert [(r["kind"], r["n"]) for r in inv.unlisted_members(p).collect()] == [("cluster", 1)]


def test_cached_documents_are_not_broadcast_by_estimate(spark):
    """Lists, documents and pieces are far larger than the files below them make Spark believe."""
    from fleetgrade.operators import deep
    from fleetgrade.operators.features import workspace_features
    from fleetgrade.plans.registered import inventory
    from tests.test_plans import plan_of
    a, kept = assessed(spark, SF001), {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")           # Spark's default
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        docs = json_cache.documents(inventory(spark, SF001), a.inputs, {}, a.scores)
        c = json_cache.read(docs, rule_catalog(spark))
        inputs = deep.assessment_input(workspace_features(c.inventory), c.deep)
        for df in (docs, inputs, scoring.assessment(a.scores, inputs)):
            assert "BroadcastExchange" not in plan_of(df)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_tables_of_documents_have_small_row_groups(spark):
    """A task reads some thousand rows of a row group at once, whatever they hold."""
    import pyarrow.parquet as pq
    from fleetgrade.session import cut_lineage
    docs = spark.range(0, 1000, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "").alias("body"))
    files = cut_lineage(docs, "documents", wide=True).inputFiles()
    assert all(pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups >= 6 for f in files)
