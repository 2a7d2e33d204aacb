"""What keeps work and memory bounded on large tables."""

import ast
import itertools
import random

import pytest

from sparkarch.operators import graphs, similarity
from sparkarch.plans import registry
from sparkarch.sources import parse

CODE = '''
import os
class A(Base):
    "doc"
    def run(self, x=None, *, y: int = -1) -> None:
        def inner(): return not x
        self.x[0] = {"k": x, **y}
        match x:
            case None: pass
def f(a, b=1):
    "doc"
    for i in a:
        if a and b: raise ValueError(f"{b!r}")
'''


def two_graphs():
    """Two graphs that nothing links, of 40 nodes each."""
    r = random.Random(5)
    return [[(f"{p}{a}", f"{p}{b}") for a, b in sorted({(r.randrange(40), r.randrange(40)) for _ in range(300)}) if a != b] for p in "ab"]


def test_facts_of_some_families_are_those_of_all():
    every = list(parse.facts("m.py", CODE.encode()))
    assert list(parse.facts("m.py", CODE.encode(), ("api",))) == [x for x in every if x["family"] == "api"] != every


def test_trees_are_written_as_by_the_library():
    for node in ast.walk(ast.parse(CODE)):
        assert parse._dump(node, {}) == ast.dump(node)


def test_limit_of_cycles_is_for_a_component(spark):
    one, two = two_graphs()
    rows = lambda x: spark.createDataFrame(x, "src string, dst string")
    found = [tuple(r["nodes"]) for r in graphs.cycles(rows(one + two), most_edges=max(len(one), len(two))).collect()]
    apart = [tuple(r["nodes"]) for x in (one, two) for r in graphs.cycles(rows(x)).collect()]
    assert sorted(found) == sorted(apart) and len(set(found)) == len(found) > 50
    with pytest.raises(ValueError):
        graphs.cycles(rows(one + two), most_edges=min(len(one), len(two)) - 10)


def test_short_cycles_in_cells(spark):
    one, two = two_graphs()
    edges = set(one + two + [("a0", "a0")])
    nodes = sorted({x for e in edges for x in e})
    want = [(a, a) for a in nodes if (a, a) in edges] + [(a, b, a) for a, b in itertools.combinations(nodes, 2) if {(a, b), (b, a)} <= edges]
    want += [(a, b, c, a) for p in "ab" for a, b, c in itertools.permutations([x for x in nodes if x[0] == p], 3) if a < min(b, c) and {(a, b), (b, c), (c, a)} <= edges]
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    for most in (20, 3_000_000):
        found = graphs.bounded_cycles(df, 3, most)
        assert sorted(tuple(r["nodes"]) for r in found.collect()) == sorted(want)


def test_refactor_plan_searches_no_cycles(spark, small, monkeypatch):
    monkeypatch.setattr(graphs, "cycles", lambda *_: pytest.fail("cycles were searched"))
    assert registry.QUERIES["refactor_plan"](spark, small).count()


def test_clusters_of_copies_need_pairs_of_classes_only(spark):
    r = random.Random(9)
    sets = {f"u{i:02}": frozenset(r.sample("abcdefgh", 4)) for i in range(20)}
    owners = {f"{u}{x}": s for u, s in sets.items() for x in "xyz"} | {"lone1": frozenset("Z"), "lone2": frozenset("Z"), "none": frozenset("Y")}
    like = lambda a, b: len(owners[a] & owners[b]) / len(owners[a] | owners[b])
    near = {a: {b for b in owners if b != a and like(a, b) >= 0.5} for a in owners}
    want, taken = [], set()
    for seed in sorted(owners):
        if seed not in taken:
            group = [seed]
            group += [o for o in sorted(near[seed] - taken) if o > seed and all(o in near[g] for g in group) and not group.append(o)][:0]
            taken.update(group)
            group = sorted(sorted(group, key=lambda g: (-len(near[g]), g))[:5])
            if len(group) > 1:
                pairs = [like(a, b) for a, b in itertools.combinations(group, 2)]
                want.append((group, round(sum(pairs) / len(pairs), 4)))
    items = spark.createDataFrame([(o, x) for o, s in owners.items() for x in s], "owner string, item string")
    classes = len(set(owners.values()))
    found = similarity.clusters(items, 0.5, max_size=5, most_pairs=classes * (classes - 1) // 2).collect()
    assert sorted((r["modules"], r["jaccard_similarity"]) for r in found) == sorted(want) and any("lone1" in g for g, _ in want)


def test_questions_about_files_and_events_analyse_nothing(spark, small, monkeypatch):
    monkeypatch.setattr("sparkarch.streaming.executor.State.rebuild", lambda *_: pytest.fail("the tree was analysed"))
    monkeypatch.setattr("sparkarch.plans.project_queries._PROJECTS", {})
    for name in ("live_events", "file_range", "search_spans"):
        assert registry.QUERIES[name](spark, small).count()


@pytest.mark.parametrize("name", ["module_context", "analyze_single_file", "file_edit_context"])
def test_questions_about_the_graph_resolve_no_uses(spark, small, monkeypatch, name):
    from sparkarch.sources import repository

    monkeypatch.setattr("sparkarch.plans.project_queries._PROJECTS", {})
    monkeypatch.setattr(repository, "usage", lambda *_: pytest.fail("uses were resolved"))
    read = repository.parse
    monkeypatch.setattr(repository, "parse", lambda files, families=None: read(files, families) if families or files.count() == 1 else pytest.fail("all facts of all files were read"))
    assert registry.QUERIES[name](spark, small).count()


def test_import_statements_are_those_of_a_whole_walk():
    code = "import a\ntry:\n import b\nexcept E:\n import c\nelse:\n import d\nfinally:\n import e\nif typing.TYPE_CHECKING:\n from f import g\n def h():\n  import i, j.k as l\nelse:\n from . import m\n"
    code += "class N:\n match o:\n  case 1:\n   import p\n async def q(self):\n  for r in s:\n   import t\n  else:\n   with u: import v\n  while w: from ..x import *\n"
    walk = parse._flat(ast.parse(code))
    whole = [(x, y > 0, z) for x, y, z in zip(walk.nodes, walk.depths, walk.typed, strict=True) if isinstance(x, (ast.Import, ast.ImportFrom))]
    found = list(parse._import_statements(ast.parse(code).body))
    assert [(ast.dump(x), y, z) for x, y, z in found] == [(ast.dump(x), y, z) for x, y, z in whole] and len(found) == 12


def test_a_state_of_some_tables_is_updated_and_refuses_the_others(spark, tmp_path):
    from sparkarch.sources import repository
    from sparkarch.streaming.executor import State, StateError

    rows = [("a.py", "import b\n\ndef f():\n    return b.g()\n"), ("b.py", "def g():\n    return 1\n"), ("bad.py", "def (:\n")]
    files = lambda x: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in x], "path string, content binary")
    some, whole = (State(spark, f"file://{tmp_path}/{n}", "r") for n in ("some", "whole"))
    some.rebuild(files(rows), ("edges",), ("symbols",))
    now = files([rows[0], ("b.py", "import a\n\ndef h():\n    return 1\n"), rows[2]])
    some.update(now, spark.createDataFrame([("b.py", "edit")], "path string, change string"))
    whole.rebuild(now)
    same = lambda x, y: sorted(map(str, x.select(*y.columns).collect())) == sorted(map(str, y.collect()))
    assert same(some.read("edges"), whole.read("edges")) and some.read("edges").count() == 2
    for family in ("module", "imports", "symbols", "skipped"):
        assert same(some.facts(family), whole.facts(family)) and some.facts(family).count()
    for ask in (lambda: some.read("usage"), lambda: some.read("collisions"), lambda: some.facts("api")):
        with pytest.raises(StateError):
            ask()
    assert whole.facts("api").count() and repository.usage(whole.read("facts")).count() == whole.read("usage").count()


def test_whole_summary_resolves_no_uses_and_keeps_no_rings_in_memory(spark, small, monkeypatch):
    from pyspark.sql import DataFrame

    from sparkarch.sources import repository

    searched, kept, cycles, persist = [], [], graphs.cycles, DataFrame.persist
    monkeypatch.setattr("sparkarch.plans.project_queries._PROJECTS", {})
    monkeypatch.setattr(repository, "usage", lambda *_: pytest.fail("uses were resolved"))
    monkeypatch.setattr(graphs, "cycles", lambda *x: searched.append(1) or cycles(*x))
    monkeypatch.setattr(DataFrame, "persist", lambda df, *x: kept.append(df.columns) or persist(df, *x))
    assert registry.QUERIES["analyze_project"](spark, small).count() == 1 and searched
    assert ["nodes"] not in kept


def test_file_update_reads_and_resolves_no_uses(spark, small, monkeypatch):
    from sparkarch.sources import repository

    monkeypatch.setattr("sparkarch.plans.project_queries._PROJECTS", {})
    monkeypatch.setattr(repository, "usage", lambda *_: pytest.fail("uses were resolved"))
    asked, read = [], repository.parse
    monkeypatch.setattr(repository, "parse", lambda files, families=None: asked.append(families) or read(files, families))
    assert registry.QUERIES["file_update"](spark, small).filter("symbol = 'fresh' and change = 'added'").count() == 1
    assert len(asked) == 2 and all(x and "usage" not in x for x in asked)


def test_what_is_asked_of_cycles_is_told_without_their_rings(spark, small, monkeypatch):
    from pyspark.sql import functions as F

    one, two = two_graphs()
    named = lambda x: [(f"{'p' if int(a[1:]) % 4 else 'q'}.{a}", f"{'p' if int(b[1:]) % 4 else 'q'}.{b}") for a, b in x]
    e = spark.createDataFrame(named(one + two), "src string, dst string")
    monkeypatch.setattr(graphs, "PART_NAMES", 50)  # many parts
    monkeypatch.setattr(graphs, "PART_STEPS", 20)
    rings = [r["nodes"] for r in graphs.cycles(e).collect()]
    assert len({tuple(r) for r in rings}) == len(rings) > 50
    assert {r["id"] for r in graphs.cycles(e, give="members").collect()} == {x for r in rings for x in r}
    for inside in ("", "p"):
        want = [r for r in rings if not inside or all(x.startswith("p.") for x in r)]
        got = graphs.cycles(e, graphs.MOST_EDGES, "summary", inside).agg(F.sum("rings"), F.sum("entries"), F.flatten(F.collect_list("first"))).first()
        assert (got[0], got[1]) == (len(want), sum(map(len, want)))
        assert sorted(got[2])[:20] == sorted(" -> ".join(r) for r in want)[:20]
    # reports do not have them written out
    monkeypatch.setattr(graphs, "_written_rings", lambda *_: pytest.fail("rings were written"))
    for name in ("architecture_signals", "debt"):
        assert registry.QUERIES[name](spark, small).count()


def test_uses_of_one_module_are_those_of_all(spark, small):
    from pyspark.sql import functions as F

    from sparkarch.plans import project_queries as pq

    whole, some = pq.project(spark, small), pq.project(spark, small, ("edges",), ("usage",))
    for module in [r["module_id"] for r in whole.facts("module").orderBy("module_id").limit(2).collect()]:
        want = whole.usage().filter(F.col("definer") == module)
        got = some.usage_of(module)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count()


@pytest.mark.parametrize("name", ["analyze_layer", "project_layers", "module_artifacts", "artifact_blast_radius", "layer_isolation", "search_artifacts", "canonical_projection"])
def test_a_question_resolves_no_uses_it_does_not_ask(spark, small, monkeypatch, name):
    from sparkarch.sources import repository

    monkeypatch.setattr("sparkarch.plans.project_queries._PROJECTS", {})
    monkeypatch.setattr(repository, "usage", lambda *_: pytest.fail("all uses were resolved"))
    monkeypatch.setattr(graphs, "_written_rings", lambda *_: pytest.fail("rings were written"))
    assert registry.QUERIES[name](spark, small).count()
