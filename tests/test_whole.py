"""Queries on whole tables against brute force; those with SQL are in test_queries too."""

import random
import re
from collections import Counter

import pandas as pd

from sparkarch.operators import degrees as deg
from sparkarch.operators import graphs
from sparkarch.operators import hotspots as hot
from sparkarch.plans import registry
from sparkarch.sources import fixtures as fx


def lines(folder):
    return pd.read_parquet(f"{folder}/lineitem.parquet").sort_values(["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])


def test_graph_of_all_orders(spark, small):
    x = lines(small)
    n = x.groupby("l_orderkey")["l_suppkey"].shift(-1)
    pairs = {(int(a), int(b)) for a, b in zip(x["l_suppkey"], n) if b == b and a != b}
    hard = [(a, b) for a, b in pairs if (a + b) % 5]
    want = {f"m{i}": (sum(b == i for _, b in hard), sum(a == i for a, _ in hard)) for i in {i for p in pairs for i in p}}
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in registry.QUERIES["degrees"](spark, small).collect()} == want


def test_usage_and_symbols_of_all_orders(spark, small):
    pairs = lines(small)[["l_suppkey", "l_partkey"]].drop_duplicates()
    want = {f"m{i}": int(k) for i, k in pairs.groupby("l_suppkey")["l_partkey"].nunique().items()}
    assert {r["definer"]: r["export_degree"] for r in registry.QUERIES["export_degree"](spark, small).collect()} == want
    got = {(m, r["symbol"]) for r in registry.QUERIES["ecosystem"](spark, small).collect() for m in r["modules"].split(",")}
    assert got == {(f"m{i}", f"p{k}") for i, k in pairs.itertuples(index=False)}


def test_spans_of_all_orders(spark, small):
    e, o = pd.read_parquet(f"{small}/events.parquet"), pd.read_parquet(f"{small}/orders.parquet")
    spans = {k: [] for k in range(5)}
    for first, customer in zip(o["o_orderkey"].tolist(), o["o_custkey"].tolist()):
        spans[first % 5].append((customer % 300, first, first + customer % 300))
    best = lambda key, at: min((s for s in spans[key] if s[1] <= at <= s[2]), default=(None, None, None))[1:]
    want = sorted((u % 5, i, *best(u % 5, i)) for i, u in zip(e["event_id"].tolist(), e["user_id"].tolist()))
    got = registry.QUERIES["enclosing_span"](spark, small).collect()
    assert len(want) == len(e) and sorted(((r["key"], r["spot"], r["lo"], r["hi"]) for r in got), key=lambda r: r[:2]) == want


def test_reports_on_what_the_operators_find(spark, small):
    q = registry.QUERIES
    nodes, spots = {r["id"]: r for r in q["degrees"](spark, small).collect()}, q["hotspots"](spark, small).collect()
    rings = [r["nodes"] for r in graphs.cycles(deg.hard(fx.edges(spark, small))).collect()]
    assert any(len(r) > 3 for r in rings)
    got = q["debt"](spark, small).first()
    clashes = sum(not r["is_identical"] for r in q["collisions"](spark, small).collect())
    assert (got["cycle_penalty"], got["collision_count"], got["edges_total"]) == (sum(map(len, rings)), clashes, q["graph_metrics"](spark, small).first()["edges_total"])
    limit = hot.thresholds(len(nodes))
    groups = [r["modules"].split(",") for r in q["shared_usage_components"](spark, small).collect()]
    assert got["cluster_penalty"] == sum(len(g) >= limit["cluster_size"] for g in groups) > 0
    plan = q["refactor_plan"](spark, small).collect()
    large = [g for g in groups if limit["refactor_cluster_size"] <= len(g) < 0.6 * len(nodes)]
    assert sorted(r["targets"] for r in plan if r["type"] == "SPLIT_PACKAGE") == sorted(map(",".join, large)) and len(plan) == len(large) + len([r for r in spots if r["type"] != "ISOLATED"][:10])
    members = {r["module"] for r in q["architecture_signals"](spark, small).collect() if "cycle_member" in r["signals"].split(",")}
    assert members == {x for r in rings for x in r}


def test_imports_of_pages_are_counted(spark, small):
    pages = pd.read_parquet(f"{small}/pages.parquet")
    names = {r["page_id"]: r["module_id"] for r in fx.page_modules(spark, small).collect()}
    want = Counter()
    for i, html in zip(pages["page_id"], pages["html"]):
        want[names[i]] += len(re.findall('href="/([^"]*)"', html or ""))
    assert {r["module_id"]: r["import_count"] for r in registry.QUERIES["module_records"](spark, small).collect()} == dict(want) and any(want.values())


def sparse(folder):
    """Order lines that make a sparse graph of 120 suppliers, no edge of it soft, with a long way to m1; its edges."""
    r = random.Random(3)
    name = lambda i: 5 * i + 1
    pairs = sorted({(name(i + 1), name(i)) for i in range(30)} | {(name(a), name(b)) for a, b in ((r.randrange(120), r.randrange(120)) for _ in range(260)) if a != b and min(a, b) > 14})
    rows = [(k, x, 1, n) for k, p in enumerate(pairs, 1) for n, x in enumerate(p, 1)]
    pd.DataFrame(rows, columns=["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber"]).to_parquet(f"{folder}/lineitem.parquet")
    return [(f"m{a}", f"m{b}") for a, b in pairs]


def test_searches_go_as_far_as_the_operators(spark, tmp_path):
    pairs, q, d = sparse(tmp_path), registry.QUERIES, str(tmp_path)
    nodes, out, into = sorted({x for p in pairs for x in p}), {}, {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    total, deepest = dict.fromkeys(nodes, 0.0), 0
    for s in nodes[:80]:
        levels, paths = [[s]], {s: 1}
        while levels[-1]:
            new = Counter()
            for x in levels[-1]:
                for y in out.get(x, ()):
                    if y not in paths:
                        new[y] += paths[x]
            paths |= new
            levels.append(list(new))
        deepest, credit = max(deepest, len(levels) - 2), dict.fromkeys(paths, 0.0)
        for here, below in reversed(list(zip(levels, levels[1:]))):
            for x in here:
                credit[x] = sum(paths[x] / paths[y] * (1 + credit[y]) for y in out.get(x, ()) if y in set(below))
        for x, c in credit.items():
            total[x] += c * (x != s)
    between = {x: c / max(total.values()) for x, c in total.items()}
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    assert deepest > 12 and near({r["id"]: r["betweenness"] for r in q["betweenness"](spark, d).collect()}, between)
    closed = {x: sum(z in out[x] for y in out[x] for z in out.get(y, ())) for x in out}
    want = {x: c * (1 - (closed[x] / (k * (k - 1)) if (k := len(out.get(x, ()))) > 1 else 0)) for x, c in between.items()}
    assert near({r["id"]: r["bridge_score"] for r in q["bridge"](spark, d).collect()}, want)
    seen, front = {"m1": ["m1"]}, {"m1": ["m1"]}
    for depth in range(1, 7):
        new = {}
        for x, path in front.items():
            for y in into.get(x, ()):
                if y not in seen:
                    new[y] = min(new.get(y, [y, *path]), [y, *path])
        seen, front = seen | new, new
        if depth == 4:
            chains = {x: ">".join(p) for x, p in seen.items() if len(p) > 1}
    assert {r["id"]: r["path"] for r in q["entry_chains"](spark, d).collect()} == chains
    assert {r["id"]: r["depth"] for r in q["transitive_dependents"](spark, d).collect()} == {x: len(p) - 1 for x, p in seen.items() if len(p) > 1} and len(seen) > len(chains) + 1
