import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from sparkarch.operators import collisions, consumption, degrees, diffs, graphs, hotspots, identity, layers, prefixes, ranking, resolve, search, similarity


def edges(spark, pairs, kind="hard"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, edge_type string")


def one(df, c):
    return {r[0]: r[1] for r in df.select(df.columns[0], c).collect()}


def test_degrees_and_metrics(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "c")]).unionByName(edges(spark, [("a", "b"), ("d", "a")], "soft"))
    assert one(degrees.degrees(degrees.hard(e), degrees.nodes_of(e)), "in_degree") == {"a": 0, "b": 1, "c": 2, "d": 0}
    m = degrees.graph_metrics(e).first()
    assert (m["nodes"], m["edges_hard"], m["edges_soft"], m["edges_total"], m["density"], m["in_degree_max"], m["out_degree_max"]) == (4, 3, 2, 5, 0.25, 2, 2)
    assert degrees.graph_metrics(e.limit(0)).first()["density"] == 0.0


def test_percentiles_with_ties(spark):
    rows = spark.createDataFrame([(f"n{i:02d}", v) for i, v in enumerate([3, 1, 1, 2, 1])], "id string, v int")
    assert one(ranking.percentile_rank(rows, "v", "id", "p").select("id", "p"), "p") == {"n01": 0.0, "n02": 0.25, "n04": 0.5, "n03": 0.75, "n00": 1.0}
    assert ranking.percentile_rank(rows.limit(1), "v", "id", "p").first()["p"] == 1.0


def test_matrix_types_weights_and_self_pairs(spark):
    usage = spark.createDataFrame([("d", "A", "c", "direct_calls"), ("d", "A", "x", "inheritance"), ("d", "B", "c", "other"), ("d", "B", "d", "api_imports"), ("e", "K", "c", "nothing")], "definer string, symbol string, consumer string, channel string")
    kinds = spark.createDataFrame([("e", "K", "method")], "definer string, symbol string, kind string")
    cells = {(r["consumer"], r["definer"]): (r["weight"], r["dep_types"]) for r in degrees.matrix(usage, edges(spark, [("c", "d"), ("z", "d"), ("z", "z")]), kinds).collect()}
    assert cells == {("c", "d"): (2, ["call", "import", "inheritance"]), ("x", "d"): (1, ["call", "inheritance"]), ("c", "e"): (1, ["call"]), ("z", "d"): (0, ["import"])}
    fan = degrees.fan(degrees.matrix(usage, None, kinds))
    assert one(fan.select("id", "fan_in"), "fan_in") == {"c": 0, "d": 2, "e": 1, "x": 0}


def test_isolated_and_config_hubs(spark):
    star = edges(spark, [(f"m{i}", "core.settings") for i in range(12)] + [("m0", "m1")])
    found = {r["module"]: r for r in hotspots.hotspots(star).collect()}
    assert found["core.settings"]["type"] == "CONFIG_HUB"
    soft = edges(spark, [("a", "b")], "soft")
    assert {r["type"] for r in hotspots.hotspots(soft).collect()} == {"ISOLATED"} and hotspots.hotspots(soft).first()["score"] == 0.0


def test_debt_and_status(spark):
    rings = spark.createDataFrame([(["a", "b", "a"],)], "nodes array<string>")
    e = edges(spark, [("a", "b"), ("b", "a")]).unionByName(edges(spark, [("a", "c")], "soft"))
    found = spark.createDataFrame([("a", "CONFIG_HUB", 0.9)], "module string, type string, score double")
    groups = spark.createDataFrame([([f"x{i}" for i in range(8)],), (["a"] + [f"y{i}" for i in range(8)],)], "modules array<string>")
    clashes = spark.createDataFrame([(False,), (True,)], "is_identical boolean")
    d = hotspots.debt(rings, e, found, groups, clashes, 3).first()
    assert (d["score"], d["normalized"], d["label"], d["cluster_penalty"]) == (6 + 0.5 + 1 + 1 + 1.5, round(10 / 3, 4), "critical", 1)
    s = lambda *x: spark.range(1).select(hotspots.status(*map(F.lit, x)).alias("s")).first()["s"]
    assert [s(1, 1, 0), s(1, 0, 0), s(0, 1, 5), s(0, 0, 1), s(0, 0, 0)] == ["CRITICAL", "BROKEN", "BROKEN", "WARNING", "HEALTHY"]


def test_thresholds():
    assert [hotspots.thresholds(n)["cluster_size"] for n in (30, 31, 200, 201)] == [8, 15, 25, 40]


def brute_pagerank(pairs, n_steps):
    out, nodes = defaultdict(set), sorted({x for p in pairs for x in p})
    for a, b in pairs:
        out[a].add(b)
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(n_steps):
        loose = sum(rank[v] for v in nodes if not out[v])
        new = {v: 0.15 / len(nodes) + 0.85 * loose / len(nodes) for v in nodes}
        for a in nodes:
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    top = max(rank.values())
    return {v: round(r / top, 6) for v, r in rank.items()}


def brute_betweenness(pairs, limit):
    out, nodes = defaultdict(set), sorted({x for p in pairs for x in p})
    for a, b in pairs:
        out[a].add(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes[:limit]:
        dist, paths, order, before, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list), deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        credit = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                credit[v] += paths[v] / paths[w] * (1 + credit[w])
            if w != s:
                score[w] += credit[w]
    top = max(score.values())
    return {v: round(x / top, 6) if top else 0.0 for v, x in score.items()}


@pytest.fixture(scope="module")
def random_pairs():
    r = random.Random(5)
    return sorted({(f"n{r.randrange(14):02d}", f"n{r.randrange(14):02d}") for _ in range(40)})


def test_pagerank(spark, random_pairs):
    got, want = one(graphs.pagerank(edges(spark, random_pairs), iterations=8), "pagerank"), brute_pagerank(random_pairs, 8)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_betweenness_and_bridge(spark, random_pairs):
    pairs = [p for p in random_pairs if p[0] != p[1]]
    scores = graphs.betweenness(edges(spark, pairs), 9).cache()
    got, want = one(scores, "betweenness"), brute_betweenness(pairs, 9)
    assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    share = {v: sum((a, b) in set(pairs) for a in out[v] for b in out[v] if a != b) / (len(out[v]) * (len(out[v]) - 1)) if len(out[v]) > 1 else 0 for v in got}
    bridge = one(graphs.bridge(edges(spark, pairs), scores), "bridge_score")
    assert all(math.isclose(bridge[v], got[v] * (1 - share[v]), abs_tol=2e-6) for v in got)


def test_betweenness_without_paths(spark):
    assert one(graphs.betweenness(edges(spark, [("a", "b")])), "betweenness") == {"a": 0.0, "b": 0.0}


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([("a", "b"), ("b", "c")], []), ([("b", "a"), ("a", "b")], [["a", "b", "a"]]), ([("a", "a")], [["a", "a"]]), ([("c", "a"), ("a", "b"), ("b", "c"), ("x", "b")], [["a", "b", "c", "a"]]),
        ([], []),
    ],
)
def test_cycles(spark, pairs, want):
    assert [r["nodes"] for r in graphs.cycles(edges(spark, pairs)).collect()] == want


def test_a_long_ring_is_one_cycle(spark):
    n = 3000
    found = graphs.cycles(edges(spark, [(f"n{i:05d}", f"n{(i + 1) % n:05d}") for i in range(n)])).collect()
    assert len(found) == 1 and len(found[0]["nodes"]) == n + 1


def test_cyclic_nodes_and_bounded(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("p", "q"), ("q", "p"), ("s", "s")])
    assert {r["id"] for r in graphs.cyclic_nodes(e).collect()} == {"a", "b", "c", "p", "q", "s"}
    assert sorted(r["nodes"] for r in graphs.bounded_cycles(e, 3).collect()) == [["a", "b", "c", "a"], ["p", "q", "p"], ["s", "s"]]


def test_components_reach_and_chains(spark):
    e = edges(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("c", "a"), ("y", "x"), ("a", "d")])
    assert one(graphs.components(e, spark.createDataFrame([("lone",)], "id string")), "component") == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "lone": "lone"}
    seed = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["depth"]) for r in graphs.transitive_dependents(e, seed).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert {r["id"] for r in graphs.affected_set(e, e, seed).collect()} == {"a", "b", "c", "d"}
    found = {r["id"]: r["path"] for r in graphs.chains(e, seed, max_nodes=3).collect()}
    assert found == {"b": ["b", "a"], "c": ["c", "a"], "d": ["d", "c", "a"]}
    stops = {r["id"] for r in graphs.chains(e, seed, stop=F.col("id") == "c").collect()}
    assert stops == {"c"}


def test_reexports_follow_to_the_end_and_drop_rings(spark):
    a = spark.createDataFrame([("p.x", "q.x"), ("q.x", "r.x"), ("u", "v"), ("v", "u"), ("w", "u")], "name string, target string")
    assert {tuple(r) for r in graphs.reexport_closure(a).collect()} == {("p.x", "r.x"), ("q.x", "r.x")}


IMPORTS = "module_id string, pos int, module string, level int, names array<string>, is_from_import boolean, is_local boolean, type_only boolean"


def test_resolver(spark):
    modules = spark.createDataFrame([("core.graph",), ("core.util",), ("core.pkg.__init__",), ("app",)], "module_id string")
    rows = [
        ("app", 0, "core.graph", 0, [], False, False, False), ("app", 1, "core.graph.build", 0, [], False, False, False), ("app", 2, "core", 0, ["util", "graph"], True, False, False), ("app", 3, "json", 0, ["x"], True, False, False),
        ("core.graph", 4, "util", 1, ["f"], True, False, False), ("core.graph", 5, None, 1, ["util"], True, False, False), ("core.graph", 6, "graph", 9, [], True, False, False), ("app", 7, "mine.core.util", 0, [], False, False, False),
        ("core.util", 8, "core.util", 0, [], False, False, False), ("core.util", 9, "app", 0, [], False, False, True),
    ]
    imports = spark.createDataFrame(rows, IMPORTS)
    root = resolve.package_root(imports, modules)
    assert root == "mine"
    got = {r["pos"]: (r["target"], r["kind"], r["used_symbol"]) for r in resolve.resolve_imports(imports, modules, root).collect()}
    assert got == {
        0: ("core.graph", "MODULE", None), 1: ("core.graph", "FALLBACK", None), 2: ("core.graph", "FALLBACK", "graph"), 3: (None, "UNKNOWN", None), 4: ("core.util", "MODULE", None), 5: ("core.util", "FALLBACK", "util"),
        6: (None, "UNKNOWN", None), 7: ("core.util", "MODULE", None), 8: ("core.util", "MODULE", None), 9: ("app", "MODULE", None),
    }
    e = {tuple(r) for r in resolve.build_graph(imports, modules).collect()}
    assert e == {("app", "core.graph", "hard"), ("app", "core.graph", "soft"), ("core.graph", "core.util", "hard"), ("core.graph", "core.util", "soft"), ("app", "core.util", "hard"), ("core.util", "app", "soft")}
    assert resolve.package_root(imports.filter("pos = 3"), modules) is None


def test_alias_resolution_takes_the_longest(spark):
    refs = spark.createDataFrame([("m", "np.array.sum"), ("m", "np"), ("m", "other.x"), ("n", "np.y")], "module_id string, name string")
    aliases = spark.createDataFrame([("m", "np", "numpy"), ("m", "np.array", "special")], "module_id string, alias string, target string")
    assert {(r["module_id"], r["name"], r["resolved"]) for r in prefixes.resolve_aliases(refs, aliases).collect()} == {("m", "np.array.sum", "special.sum"), ("m", "np", "numpy"), ("m", "other.x", "other.x"), ("n", "np.y", "np.y")}


def test_suffix_match_is_exact_first_and_refuses_ambiguity(spark):
    asked = spark.createDataFrame([("a/x.py",), ("x.py",), ("y.py",)], "p string")
    files = spark.createDataFrame([("a/x.py",), ("b/a/x.py",), ("c/y.py",)], "path string")
    assert one(prefixes.by_suffix(asked, "p", files, "path"), "matched") == {"a/x.py": "a/x.py", "x.py": None, "y.py": "c/y.py"}


def test_layers(spark):
    e = edges(spark, [("a.x", "a.y"), ("a.x", "ab.z"), ("ab.z", "a.y"), ("c", "ab.z")])
    members = spark.createDataFrame([("a.x", "a"), ("a.y", "a"), ("ab.z", "ab"), ("c", "c")], "module_id string, layer string")
    assert {tuple(r) for r in layers.boundary(e, members, "a").collect()} == {("a.x", "a.y", "internal"), ("a.x", "ab.z", "outbound"), ("ab.z", "a.y", "inbound")}
    rings = spark.createDataFrame([(["a.x", "a.y", "a.x"],), (["a.x", "ab.z", "a.x"],)], "nodes array<string>")
    assert rings.filter(layers.inside("nodes", "a")).count() == 1 and rings.filter(layers.inside("nodes", "")).count() == 2
    assert {r["id"]: (r["in_degree"], r["internal_in"]) for r in layers.layer_degrees(e, members, "a").collect()} == {"a.x": (0, 0), "a.y": (2, 1)}
    assert [layers.recompute_layer(*x) for x in ((3.1, 0), (3, 0.85), (0, 0.9))] == ["full", "filtered", "full"]
    usage = spark.createDataFrame([("a.x", "s", "a.y", "direct_calls"), ("a.y", "s", "c", "direct_calls"), ("c", "s", "c", "direct_calls")], "definer string, symbol string, consumer string, channel string")
    assert one(layers.visibility(members, usage).select("module_id", "visibility"), "visibility") == {"a.x": "internal", "a.y": "public", "ab.z": "private", "c": "private"}


def test_consumption(spark):
    usage = spark.createDataFrame([("d", "s", "d", "direct_calls"), ("d", "s", "c", "direct_calls"), ("d", "t", "d", "api_imports")], "definer string, symbol string, consumer string, channel string")
    assert {tuple(r) for r in consumption.artifact_index(usage).collect()} == {("d", "s", "d"), ("d", "s", "c")}
    assert {tuple(r) for r in consumption.artifact_index(usage, keep_self=False).collect()} == {("d", "s", "c")}
    symbols = spark.createDataFrame([("d", "s"), ("d", "u")], "definer string, symbol string")
    assert {r["symbol"]: r["consumer_count"] for r in consumption.consumption(usage, symbols).collect()} == {"s": 2, "u": 0}
    members = spark.createDataFrame([("d", "x", False), ("c", "y", False), ("t", "x", True), ("e", "x", False)], "module_id string, layer string, is_test boolean")
    r = consumption.blast_radius(usage, edges(spark, [("c", "d"), ("t", "c"), ("e", "c"), ("q", "e")]), members, "d", "s").first()
    assert r.asDict() == {"same_module": 1, "same_layer": 0, "cross_layer": 1, "test": 0, "unknown": 0, "downstream_production": 2, "downstream_test": 1, "downstream_unknown": 1}


def brute_clusters(items, least=0.3, most=25):
    owners = sorted(items)
    j = lambda a, b: len(items[a] & items[b]) / len(items[a] | items[b])
    near = {a: {b for b in owners if b != a and j(a, b) >= least} for a in owners}
    free, out = list(owners), []
    while free:
        seed = free.pop(0)
        if not near[seed]:
            continue
        group = [seed]
        for c in list(free):
            if all(c in near[g] for g in group):
                group.append(c)
                free.remove(c)
        if len(group) > most:
            group = sorted(group, key=lambda g: (-len(near[g]), g))[:most]
        if len(group) > 1:
            group = sorted(group)
            shared = set.intersection(*(items[g] for g in group))
            pairs = [j(a, b) for i, a in enumerate(group) for b in group[i + 1 :]]
            out.append((tuple(group), len(shared), round(sum(pairs) / len(pairs), 4), round(len(shared) / len(set.union(*(items[g] for g in group))), 4)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_and_clusters(spark, seed):
    r = random.Random(seed)
    items = {f"o{i:02d}": {f"i{r.randrange(12)}" for _ in range(r.randrange(1, 9))} | ({"common"} if i % 2 else set()) for i in range(40)}
    df = spark.createDataFrame([(o, x) for o, s in items.items() for x in s], "owner string, item string")
    want = {(a, b) for a in items for b in items if a < b and len(items[a] & items[b]) / len(items[a] | items[b]) >= 0.3}
    assert {(x["a"], x["b"]) for x in similarity.jaccard_pairs(df).collect()} == want
    got = [(tuple(x["modules"]), x["shared_artifact_count"], x["jaccard_similarity"], x["shared_ratio"]) for x in similarity.clusters(df, max_size=5).collect()]
    assert sorted(got) == brute_clusters(items, most=5)


def test_collisions(spark):
    facts = spark.createDataFrame([("m", "f", "function", "def f():\n  1\n"), ("n", "f", "function", "def f():\n\n    1"), ("m", "C", "class", "x"), ("n", "C", "class", "x\ny\nz"), ("m", "run", "function", "a"), ("n", "run", "function", "b"), ("m", "g", "function", "1"), ("m", "g", "function", "2")], "module_id string, name string, type string, code string")
    found = {r["name"]: r for r in collisions.severity(collisions.collisions(facts)).collect()}
    assert set(found) == {"f", "C"} and found["f"]["is_identical"] and not found["C"]["is_identical"]
    assert found["C"]["severity"] == "critical" and found["C"]["nodes"] == ["m", "n"]


def test_diffs(spark):
    old = spark.createDataFrame([("m", "a", "()", "1"), ("m", "b", "()", "1"), ("m", "c", None, "1")], "module_id string, symbol string, signature string, body_fp string")
    new = spark.createDataFrame([("m", "a", "(x)", "2"), ("m", "b", "()", "2"), ("m", "d", None, "1")], "module_id string, symbol string, signature string, body_fp string")
    assert {(r["symbol"], r["change"]) for r in diffs.symbol_diff(old, new).collect()} == {("a", "signature"), ("b", "body"), ("c", "removed"), ("d", "added")}
    rep = lambda **x: spark.createDataFrame([("debt", k, float(v)) for k, v in x.items()], "section string, name string, value double")
    verdict = lambda a, b: diffs.regression(diffs.report_diff(a, b)).first()["verdict"]
    assert verdict(rep(total_score=1), rep(total_score=2)) == "REGRESSION"
    assert verdict(rep(total_score=2, isolated_count=3), rep(total_score=2, isolated_count=1)) == "IMPROVED"
    assert verdict(rep(total_score=2), rep(total_score=2)) == "UNCHANGED"
    assert verdict(rep(total_score=2, hotspot_count=0), rep(total_score=1, hotspot_count=1)) == "REGRESSION"


def test_search(spark):
    ids = spark.createDataFrame(
        [("module", "1/1", "pkg.core", "active", None), ("module", "2/1", "core", "active", None), ("artifact", "A1/1", "pkg.core::Engine.start", "active", None), ("artifact", "A2/1", "other::start", "orphan", None), ("artifact", "A3/1", "other::restart", "active", None)],
        "kind string, obj_id string, name string, status string, path string",
    )
    ask = lambda q: [(r["obj_id"], r["match"], r["score"]) for r in search.resolve_index(q, ids).collect()]
    assert ask("core.py") == [("2/1", "exact", 100)] and ask("pkg/core.py") == [("1/1", "exact", 100)]
    assert ask("PKG.CORE") == [("1/1", "case_insensitive", 100)] or ask("PKG.CORE")[0][0] == "1/1"
    assert ask("start") == [("A2/1", "exact", 100)] and ask("Start") == [("A2/1", "case_insensitive", 95)]
    assert ask("A1/1") == [("A1/1", "exact_id", 100)] and ask("id:zz") == [] and ask("  ") == []
    assert ask("resta") == [("A3/1", "prefix", 70)] and ask("estar") == [("A3/1", "substring", 60)]
    lookup = search.lookup_ids(spark.createDataFrame([("A1/1",), ("A2/1",), ("zz",)], "obj_id string"), ids)
    assert one(lookup.select("obj_id", "status"), "status") == {"A1/1": "active", "A2/1": "recovery", "zz": "missing"}
    texts = spark.createDataFrame([("f", "one\nTwo two\n"), ("g", None)], "path string, text string")
    assert [tuple(r) for r in search.search_source(texts, "two", False).collect()] == [("f", 2, "Two two", 1, 2)]
    assert [r["line_no"] for r in search.search_source(texts, "two").collect()] == [2]
    assert [r["line"] for r in search.line_range(texts, 1, 2).collect()] == ["one", "Two two"]
    blocks = spark.createDataFrame([("A1/1", "1/1", ["2/1", "9/9"]), ("A8/1", "1/1", []), ("A3/1", "7/7", [])], "artifact_id string, definer string, consumers array<string>")
    named, lost = search.rewrite_ids(blocks, ids)
    assert [tuple(r) for r in named.collect()] == [("pkg.core::Engine.start", "pkg.core", ["core"])]
    assert {tuple(r) for r in lost.collect()} == {("A8/1", "artifact"), ("7/7", "definer"), ("9/9", "consumer")}


def test_registry(spark):
    ids = spark.createDataFrame([], "kind string, slot int, generation int, name string, status string, removed_at timestamp")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    state = lambda df: {(r["name"], r["slot"], r["generation"], r["status"]) for r in df.collect()}
    a = identity.sync(ids, names("b", "a", ""), "module").cache()
    assert state(a) == {("a", 1, 1, "active"), ("b", 2, 1, "active")}
    b = identity.sync(a, names("a", "c"), "module").cache()
    assert state(b) == {("a", 1, 1, "active"), ("b", 2, 1, "orphan"), ("c", 3, 1, "active")}
    assert ("b", 2, 1, "active") in state(identity.sync(b, names("a", "b", "c"), "module"))
    gone = identity.collect_garbage(b, spark.createDataFrame([], "obj_id string"), "module", budget=2).cache()
    assert {r["name"] for r in gone.collect()} == {"a", "c"}
    assert identity.collect_garbage(b, spark.createDataFrame([("2/1",)], "obj_id string"), "module", budget=0).count() == 3
    again = identity.reuse(identity.sync(gone, names("a", "c", "d"), "module"), b.filter("name = 'b'"))
    assert ("d", 2, 2, "active") in state(again)


def test_relabelling_does_not_change_results(spark, random_pairs):
    flip = lambda x: "z" + x[::-1]
    a = {flip(k): v for k, v in one(graphs.pagerank(edges(spark, random_pairs), iterations=5), "pagerank").items()}
    b = one(graphs.pagerank(edges(spark, [(flip(x), flip(y)) for x, y in random_pairs]).repartition(3), iterations=5), "pagerank")
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=2e-6) for k in a)
