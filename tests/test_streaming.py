import datetime

import pytest

from sparkarch.streaming import executor, journal, planner


def events(spark, revisions):
    return spark.createDataFrame([(r,) for r in revisions], "revision long")


@pytest.mark.parametrize(
    ("after", "want"),
    [(None, ("not_requested", False, None)), (50, ("continuous", False, None)), (49, ("gap", True, "event_retention_gap")), (150, ("continuous", False, None)), (151, ("gap", True, "revision_discontinuity"))],
)
def test_continuity(spark, after, want):
    kept = journal.retained(events(spark, range(1, 151)))
    r = journal.continuity(kept, after).first()
    assert (r["continuity"], r["resync_required"], r["resync_reason"]) == want and (r["earliest_retained_revision"], r["latest_revision"]) == (51, 150)


@pytest.mark.parametrize(("after", "latest", "want"), [(0, 0, "continuous"), (5, 5, "continuous"), (3, 5, "gap"), (6, 5, "gap")])
def test_continuity_without_events(spark, after, latest, want):
    assert journal.continuity(events(spark, []), after, latest=latest).first()["continuity"] == want


def test_pages(spark):
    e = events(spark, [3, 1, 2])
    assert [r["revision"] for r in journal.page(e, 1, 1).collect()] == [2]
    assert [r["revision"] for r in journal.page(e, None, None).collect()] == [1, 2, 3]
    assert journal.page(e, 0, -1).count() == 0


P, D = planner.plan, planner.Delta


@pytest.mark.parametrize(
    ("delta", "rule", "graph", "recompute"),
    [
        (D("m"), "no-op", False, "none"), (D("m", is_new=True, imports=True), "add", True, "dependents"), (D("m", is_deleted=True), "delete", True, "dependents"), (D("m", aliases=True), "alias", False, "alias_users"),
        (D("m", aliases=True, imports=True), "alias", True, "alias_users"), (D("m", imports=True, artifacts_changed=True), "import", True, "none"), (D("m", artifacts_changed=True), "definition", False, "dependents"),
        (D("m", usage=True), "body", False, "none"), (D("m", collision_facts=True), "collision", False, "none"),
    ],
)
def test_plan_rules(delta, rule, graph, recompute):
    p = P(delta)
    assert (p.rule, bool(p.graph), p.recompute) == (rule, graph, recompute)


def test_plan_families():
    assert P(D("m")).patch == ()
    assert P(D("m", usage=True)).patch == ("module_usages", "artifact_consumption", "cached_analytics")
    assert P(D("m", collision_facts=True)).patch == planner.COLLISIONS
    assert "cached_analytics" not in P(D("m", artifacts_changed=True)).patch and "cached_analytics" in P(D("m", artifacts_added_or_removed=True)).patch
    assert set(planner.COLLISIONS) <= set(P(D("m", imports=True, collision_facts=True)).patch)


def test_dependents(spark):
    usage = spark.createDataFrame([("c", "direct_calls", "np.go"), ("d", "direct_calls", "pkg.module.f"), ("e", "direct_calls", "pkg.modules.f"), ("pkg.mod", "direct_calls", "pkg.mod.x")], "module_id string, channel string, value string")
    aliases = spark.createDataFrame([("c", "np", "pkg.mod"), ("f", "z", "pkg.mod.thing")], "module_id string, alias string, target string")
    changed = spark.createDataFrame([("pkg.mod",)], "module_id string")
    assert {r["module_id"] for r in planner.dependents(usage, aliases, changed).collect()} == {"c", "f"}


SCHEMA = "revision long, operation string, module_id string, status string, ts timestamp"


def rows(spark, values):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, "edit", m, s, t + datetime.timedelta(minutes=r)) for r, m, s in values], SCHEMA)


def test_states_and_windows_as_streams(spark, tmp_path):
    folder = f"{tmp_path}/journal"
    rows(spark, [(3, "a", "error"), (1, "a", "ok"), (2, "b", "error"), (12, "b", "ok"), (13, "c", "error")]).write.parquet(folder)
    seen = []
    q = executor.parse_states(journal.stream(spark, folder, SCHEMA)).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["module_id"]: (r["revision"], r["state"]) for r in seen}
    assert got == {"a": (3, "last_known_good"), "b": (12, "fresh"), "c": (13, "unavailable")}
    batch = {r["module_id"]: (r["revision"], r["state"]) for r in journal.parse_state(spark.read.parquet(folder)).collect()}
    assert batch == got
    q = journal.windowed(journal.stream(spark, folder, SCHEMA), width="10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["events"] for r in spark.table("w").collect()) == [2, 3]
    assert {r["module_id"]: r["events"] for r in journal.sessions(rows(spark, [(1, "a", "ok"), (2, "a", "ok")])).collect()} == {"a": 2}


def test_batches_run_once(spark, tmp_path):
    folder, out = f"{tmp_path}/journal", f"{tmp_path}/out"
    rows(spark, [(1, "a", "ok")]).write.parquet(folder)
    apply = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}")
    for _ in range(2):
        journal.run_batches(journal.stream(spark, folder, SCHEMA), apply, f"{tmp_path}/c").awaitTermination(120)
    assert spark.read.parquet(f"{out}/*").count() == 1
