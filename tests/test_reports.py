import datetime

import pytest
from pyspark.sql import functions as F

from sparkarch.operators import reports
from sparkarch.sources import revision


def test_action_items(spark):
    cycles = spark.createDataFrame([(["a", "b", "a"],)], "nodes array<string>")
    clashes = spark.createDataFrame([("f", "function", False, "warning"), ("C", "class", False, "critical"), ("x", "class", True, "info")], "name string, type string, is_identical boolean, severity string")
    spots = spark.createDataFrame([("o", "OUTBOUND_HOTSPOT", 0.9, 12), ("app.main", "ISOLATED", 0.0, 0), ("dead", "ISOLATED", 0.0, 0)], "module string, type string, score double, out_degree int")
    found = reports.action_items(cycles, clashes, spots)
    assert [(i["level"], i["action"]) for i in found] == [("CRITICAL", "break_cycle"), ("BROKEN", "fix_collision"), ("WARNING", "refactor"), ("INFO", "isolated_entry_points"), ("INFO", "isolated_modules")]
    assert found[1] == {"level": "BROKEN", "action": "fix_collision", "target": "C", "count": 1} and found[3]["target"] == ["app.main"]
    assert reports.action_items(cycles.limit(0), clashes.filter("name = 'f'"), spots.limit(0)) == [{"level": "BROKEN", "action": "resolve_collisions", "target": None, "count": 1}]


def test_import_classes(spark):
    usage = spark.createDataFrame([("m", "a", 1, 0), ("m", "b", 0, 2), ("m", "c", 0, 0), ("m", "d", 0, 0)], "module_id string, name string, runtime int, typing int")
    exports = spark.createDataFrame([("m", "d", True), ("m", "c", False)], "module_id string, name string, listed boolean")
    got = {r["name"]: (r["classification"], r["confidence"], r["runtime_available"]) for r in reports.import_usage_classes(usage, exports).collect()}
    assert got == {"a": ("runtime", "high", True), "b": ("type_only", "medium", False), "c": ("unused", "low", False), "d": ("re_exported", "high", True)}
    imports = spark.createDataFrame([("m", "pkg", False), ("m", "pkg.a.f", True), ("m", "json", True), ("m", "pk", False), ("m", None, False)], "module_id string, module string, is_local boolean")
    modules = spark.createDataFrame([("pkg.a",)], "module_id string")
    got = {r["name"]: (r["scope"], r["is_local"]) for r in reports.classify_imports(imports, modules).collect()}
    assert got == {"pkg": ("internal", False), "pkg.a.f": ("internal", True), "json": ("external", False), "pk": ("external", False)}


def test_views_and_traces(spark):
    usage = spark.createDataFrame([("d", "s", "a"), ("d", "s", "d"), ("d", "t", "b")], "definer string, symbol string, consumer string")
    imported = spark.createDataFrame([("d", "a"), ("d", "z")], "definer string, module_id string")
    assert {(r["symbol"], tuple(r["direct"]), tuple(r["transitive"])) for r in reports.symbol_view(usage, imported).collect()} == {("s", ("a",), ("z",)), ("t", ("b",), ("z",))}
    symbols = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "module_id string, symbol string")
    tests = spark.createDataFrame([("t1", "m")], "test_path string, module_id string")
    assert {tuple(map(str, r)) for r in reports.test_trace(symbols, symbols.filter("symbol = 'a'"), tests).collect()} == {("m", "['t1']", "1", "1"), ("n", "[]", "0", "1")}
    ids = spark.createDataFrame([("m", "1/1", "active"), ("n", "2/1", "orphan")], "name string, obj_id string, status string")
    assert {tuple(r) for r in reports.compact(spark.createDataFrame([("m", "n")], "src string, dst string"), ["src", "dst"], ids).select("src", "dst").collect()} == {("1/1", "n")}
    api = spark.createDataFrame([("m", "class", "public", "x"), ("m", "method", "private", None)], "module_id string, kind string, visibility string, doc string")
    assert tuple(reports.api_counts(api).first()) == ("m", 1, 0, 1, 1, 1)


def test_history(spark):
    t = datetime.datetime(2024, 3, 31)
    rows = [("f", f"c{i:02d}", t - datetime.timedelta(days=3 * i), "me", i, 1, "p" * 3000) for i in range(13)] + [("g", "z", t - datetime.timedelta(days=90), "you", 7, 0, None)]
    df = spark.createDataFrame(rows, "path string, commit string, committed_at timestamp, author string, added int, removed int, patch string")
    got = {r["path"]: r for r in reports.file_history(df, F.lit(t)).collect()}
    assert (got["f"]["last_commit"], got["f"]["commits_recent"], got["f"]["churn"], len(got["f"]["patch"])) == ("c00", 11, 1.0, 2000)
    assert (got["g"]["commits_recent"], got["g"]["churn"], got["g"]["patch"]) == (0, 0.0, None)


def test_revision(tmp_path):
    assert revision.branch(str(tmp_path)) is None and revision.commit(str(tmp_path)) is None
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/topic/x\n")
    assert revision.branch(str(tmp_path)) == "topic/x" and revision.commit(str(tmp_path)) is None
    (git / "packed-refs").write_text("# pack\nabc123 refs/heads/topic/x\n")
    assert revision.commit(str(tmp_path)) == "abc123"
    (git / "HEAD").write_text("deadbeef\n")
    assert revision.commit(str(tmp_path)) == "deadbeef" and revision.branch(str(tmp_path)) is None
    other = tmp_path / "tree"
    other.mkdir()
    (other / ".git").write_text("gitdir: ../.git\n")
    assert revision.header(str(other), "full", "now")["commit"] == "deadbeef"


def test_orders_of_builders_and_their_errors(spark):
    from sparkarch.operators import contracts

    make = lambda *rows: spark.createDataFrame(rows, "name string, requires array<string>, provides array<string>")
    got = contracts.build_order(make(("c", ["x", "y"], ["z"]), ("a", [], ["x"]), ("b", ["x"], ["y"]), ("d", [], ["w"])))
    assert {r["name"]: r["step"] for r in got.collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    for rows, text in ((((1, [], ["x"]), (2, [], ["x"])), "twice"), (((1, ["q"], ["x"]),), "nothing provides"), (((1, ["y"], ["x"]), (2, ["x"], ["y"])), "ring")):
        with pytest.raises(ValueError, match=text):
            contracts.build_order(make(*[(str(n), r, p) for n, r, p in rows])).collect()


def test_problems_of_consumption(spark):
    from sparkarch.operators import contracts

    rows = [("m", "p", ["a", "b"], {"a": ["direct_calls"]}), ("m", "q", ["b", "a"], {"c": ["direct_calls"]}), ("", "r", None, {}), ("m", "s", ["a", "a"], {"a": ["nothing"]}), ("m", "t", ["a"], {"a": ["inheritance", "api_imports"]}), ("m", "u", [], {})]
    got = contracts.consumption_problems(spark.createDataFrame(rows, "definer string, symbol string, consumers array<string>, channels map<string, array<string>>")).collect()
    assert sorted((r["symbol"], r["problem"]) for r in got) == [("q", "channel of no consumer"), ("q", "consumers"), ("r", "consumers"), ("r", "name"), ("s", "consumers"), ("s", "unknown channel"), ("t", "channels")]


def test_freshness_goes_as_far_as_needs_do(spark):
    from sparkarch.operators import contracts

    states = spark.createDataFrame([("a", "fresh"), ("b", "stale"), ("c", "fresh"), ("d", "fresh"), ("e", "fresh"), ("f", None)], "family string, state string")
    needs = spark.createDataFrame([("c", "b"), ("d", "c"), ("e", "gone"), ("a", "a")], "family string, needed string")
    fresh = lambda **k: {r["family"] for r in contracts.freshness(states, needs, **k).collect() if r["is_fresh"]}
    assert fresh() == {"a"} and fresh(resync=True) == set()
