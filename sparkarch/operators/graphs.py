"""Iterative graph operators over ``edges(src, dst)``.

Loops join the whole edge table with one row per node and combine before they shuffle; state is cut from its lineage through
the shared checkpoint folder, so a lost executor costs one step. Nothing but counters comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, stored
from .degrees import node_universe
from .ranking import over_max


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 50) -> DataFrame:
    """``id``, ``pagerank``: ranks after exactly ``iterations`` steps over the largest, 6 digits.

    Rank of nodes without out-edges is spread evenly over all nodes in each step. A step reads the stored state of the one before
    once: each node keeps its number of out-edges beside its rank, so what has nowhere to go is summed as the state is stored.
    """
    pairs = cut(_pairs(edges))
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    nodes = cut(node_universe(pairs.select("src"), pairs.select("dst")).join(out, "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        loose = ranks.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]  # a number
        share = ranks.filter("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        gained = pairs.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("__gain"))
        rank = F.lit((1 - damping) / n) + damping * (F.coalesce("__gain", F.lit(0.0)) + F.lit(loose / n))
        ranks = cut(nodes.join(gained, "id", "left").select("id", "out", rank.alias("rank")))
    most = ranks.agg(F.max("rank").alias("__most"))
    return ranks.crossJoin(F.broadcast(most)).select("id", over_max(F.col("rank"), F.col("__most")).alias("pagerank"))


def hits(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """``id``, ``hub_score``, ``authority_score``: each step takes new authorities from hubs, hubs from those, then divides both by their maxima; 6 digits.

    Both halves of a step are stored, so no plan holds more than one join with the edges; a maximum is a number.
    """
    pairs = cut(_pairs(edges))
    nodes = cut(node_universe(pairs.select("src"), pairs.select("dst")))
    state = nodes.select("id", F.lit(1.0).alias("h"), F.lit(1.0).alias("a"))
    over = lambda v, m: F.col(v) / m if m else F.lit(0.0)
    mh = ma = 1.0
    for _ in range(iterations):
        auth = cut(pairs.join(state.select(F.col("id").alias("src"), over("h", mh).alias("hub")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a")))
        hub = pairs.join(auth.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        state = cut(nodes.join(auth, "id", "left").join(hub, "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a")))
        mh, ma = state.agg(F.max("h"), F.max("a")).first()
    return state.select("id", F.round(over("h", mh), 6).alias("hub_score"), F.round(over("a", ma), 6).alias("authority_score"))


def betweenness(edges: DataFrame, sample_limit: int = 80) -> DataFrame:
    """``id``, ``betweenness``: shortest directed paths through each node from the first ``sample_limit`` nodes, over the largest; 6 digits.

    A level-by-level search from all sources at once: rows are (source, node, depth, paths); each level is one join with the
    edges, and dependencies flow back level by level. No task holds the graph.
    """
    pairs = cut(_pairs(edges))
    nodes = node_universe(pairs.select("src"), pairs.select("dst"))
    seen = cut(nodes.orderBy("id").limit(sample_limit).select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    levels, front = [seen], seen
    while not front.isEmpty():
        step = front.join(pairs, front["id"] == pairs["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(len(levels)).alias("depth"), "paths"))
        levels.append(front)
        seen = seen.unionByName(front)
    below = levels[-1].select("source", "id", "paths", F.lit(0.0).alias("credit"))
    total = None
    for level in reversed(levels[:-1]):
        back = level.join(pairs, level["id"] == pairs["src"]).select("source", "id", level["paths"].alias("p"), "dst")
        gained = back.join(below.select("source", F.col("id").alias("dst"), F.col("paths").alias("q"), "credit"), ["source", "dst"]).groupBy("source", "id").agg(F.sum(F.col("p") / F.col("q") * (1 + F.col("credit"))).alias("credit"))
        below = cut(level.select("source", "id", "paths").join(gained, ["source", "id"], "left").select("source", "id", "paths", F.coalesce("credit", F.lit(0.0)).alias("credit")))
        part = below.filter("source <> id").select("id", "credit")
        total = part if total is None else total.unionByName(part)
    sums = nodes.join(total.groupBy("id").agg(F.sum("credit").alias("c")), "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("c")) if total is not None else nodes.withColumn("c", F.lit(0.0))
    sums = cut(sums)
    most = sums.agg(F.max("c").alias("__most"))
    return sums.crossJoin(F.broadcast(most)).select("id", over_max(F.col("c"), F.col("__most")).alias("betweenness"))


def bridge(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """``id``, ``bridge_score``: betweenness times one less the share of a node's ordered out-neighbour pairs that are linked.

    With fewer than two out-neighbours that share is 0. Triangles of the undirected graph are found once each, from the end of
    least degree: a hub is the middle of no wedge that a node of less degree can open. Each then says which of its six ordered
    pairs are edges.
    """
    pairs = cut(_pairs(edges).filter("src <> dst"))
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    both = pairs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), (F.col("src") < F.col("dst")).alias("up"))
    links = cut(both.groupBy("u", "v").agg(F.max("up").alias("uv"), F.max(~F.col("up")).alias("vu")))
    degree = cut(links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
    placed = links.join(degree.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    turned = cut(placed.select(pick("u", "v").alias("x"), pick("v", "u").alias("y"), pick("uv", "vu").alias("xy"), pick("vu", "uv").alias("yx")))
    side = lambda *n: turned.select(*[F.col(c).alias(a) for c, a in zip(("x", "y", "xy", "yx"), n, strict=True)])
    wedge = side("x", "y", "xy", "yx").join(side("x", "z", "xz", "zx"), "x").filter("y <> z")
    found = wedge.join(side("y", "z", "yz", "zy"), ["y", "z"])
    # a node counts an ordered pair of its out-neighbours that is an edge
    each = F.array(*[F.struct(F.col(n).alias("id"), (F.expr(f"cast({n}{a} and {n}{b} and {a}{b} as int) + cast({n}{a} and {n}{b} and {b}{a} as int)")).alias("t")) for n, a, b in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))])
    closed = found.select(F.explode(each).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.t").alias("t"))
    share = F.when(F.col("k") >= 2, F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return scores.join(out, "id", "left").join(closed, "id", "left").select("id", F.round(F.col("betweenness") * (1 - share), 6).alias("bridge_score"))


def _forest(links: DataFrame, most: int = 500_000) -> DataFrame:
    """Of ``links(src, dst)`` those that join, within a task, what the ones before did not: the components are the same, the edges far fewer.

    A task keeps at most about ``most`` nodes, and begins anew beyond them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            if len(up) > most:
                up.clear()
            kept = []
            for i, (x, y) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                x, y = root(x) if x in up else up.setdefault(x, x), root(y) if y in up else up.setdefault(y, y)
                if x != y:
                    up[x] = y
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int32()))

    return links.mapInArrow(run, links.schema)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id``, ``component``: the smallest id that undirected edges reach.

    Each task first drops edges within what it has joined already. Then nodes link to their least neighbour, larger neighbours
    first, then smaller ones, until nothing changes.
    """
    links = edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst")
    if all(t in ("string", "bigint", "int") for _, t in links.dtypes):
        links = _forest(links)
    state, before = cut(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(lower.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    every = node_universe(edges.select("src"), edges.select("dst"), *([] if nodes is None else [nodes.select("id")]))
    return every.join(state.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def component_sizes(found: DataFrame) -> DataFrame:
    """``component``, ``size``, largest first, then by smallest node."""
    return found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = True, include_seeds: bool = False) -> DataFrame:
    """``seed``, ``id``, ``depth``: what each seed (column ``id``) is reached from (``reverse``) or reaches, at its least depth.

    A frontier per level, joined with the edges, less what was seen; without ``max_depth`` it runs until a frontier is empty.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    pairs = cut(_pairs(edges).select(F.col(a).alias("id"), F.col(b).alias("next")))
    seen = front = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(pairs, "id").select("seed", F.col("next").alias("id")).distinct()
        front = cut(step.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen if include_seeds else seen.filter("depth > 0")


def transitive_dependents(edges: DataFrame, seeds: DataFrame, max_depth: int = 6) -> DataFrame:
    return reach(edges, seeds, max_depth)


def affected_set(old: DataFrame, new: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id``: the seeds and all that depends on them in either graph, over edges of any type."""
    return reach(old.select("src", "dst").unionByName(new.select("src", "dst")), seeds, include_seeds=True).select("id").distinct()


def chains(edges: DataFrame, targets: DataFrame, stop: Column | None = None, max_nodes: int = 5) -> DataFrame:
    """``target``, ``id``, ``path``: shortest reverse paths from each target to every node within ``max_nodes`` nodes.

    Paths run from the node to the target. Of equally short ones the smallest stays. No path goes on beyond a node where
    ``stop`` (a predicate on ``id``) holds; with it, only paths that end at such a node are returned.
    """
    pairs = cut(_pairs(edges).select(F.col("dst").alias("id"), F.col("src").alias("next")))
    seen = front = cut(targets.select(F.col("id").alias("target"), "id", F.array("id").alias("path")).distinct())
    for _ in range(max_nodes - 1):
        open_ends = front if stop is None else front.filter(~stop)
        step = open_ends.join(pairs, "id").select("target", F.col("next").alias("id"), F.concat(F.array("next"), "path").alias("path"))
        step = step.groupBy("target", "id").agg(F.min("path").alias("path"))
        front = cut(step.join(seen.select("target", "id"), ["target", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = seen.filter(F.size("path") > 1)
    return found if stop is None else found.filter(stop)


def entry_point() -> Column:
    """Modules whose last segment is an entry point's name. Fixed values."""
    return F.element_at(F.split("id", r"\."), -1).isin("main", "cli", "run", "app", "__main__")


def trim_sinks(edges: DataFrame) -> DataFrame:
    """Edges left once nodes without out-edges are dropped again and again: none of those lies on a cycle."""
    left = cut(_pairs(edges))
    n = left.count()
    while n:
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            break
        n = now
    return left


def _search(targets: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Steps of one depth-first search: (0, place, node) puts a node on the path, (1, place, 0) takes the last one off it, and
    (2, place, depth) is a back edge, which closes the ring of the path's nodes from ``place`` up to ``depth``.

    Nodes are numbers in their order; the targets of ``i``, in order, are ``targets[starts[i]:starts[i + 1]]``. A ring has one
    back edge, and that edge is met once, so no ring comes twice.
    """
    n = len(starts) - 1
    at, done = [-1] * n, bytearray(n)
    for root in range(n):
        if done[root]:
            continue
        at[root], depth, path = 0, 1, [root]
        work = [iter(targets[starts[root] : starts[root + 1]].tolist())]
        yield 0, 0, root
        while work:
            for d in work[-1]:
                if at[d] >= 0:
                    yield 2, at[d], depth
                elif not done[d]:
                    at[d] = depth
                    path.append(d)
                    yield 0, depth, d
                    depth += 1
                    work.append(iter(targets[starts[d] : starts[d + 1]].tolist()))
                    break
            else:
                work.pop()
                depth -= 1
                last = path.pop()
                at[last], done[last] = -1, 1
                yield 1, depth, 0


def _components_searched(edges: DataFrame, most_edges: int, found: Callable[[pa.Array, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``found(ids, targets, starts)`` gives of each weakly connected component of what trimming leaves, each in one task."""
    left = trim_sinks(edges)
    placed = cut(left.join(components(left).select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst"))
    n = placed.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if n > most_edges:
        raise ValueError(f"{n} edges of one component lie on paths into cycles; cyclic_nodes() has no such limit")

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        ids = pc.unique(pa.chunked_array(table["src"].chunks + table["dst"].chunks))
        ids = ids.take(pc.sort_indices(ids))  # by bytes, as Spark sorts
        src, dst = (pc.index_in(table[c], ids).to_numpy() for c in ("src", "dst"))
        del table
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        yield from found(ids, dst, np.searchsorted(src, np.arange(len(ids) + 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for b in batches:  # sorted by component
            names = b.column("component")
            cuts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(names)] if len(names) else []
            for i, j in zip(cuts, cuts[1:]):
                if parts and names[i].as_py() != now:
                    yield from whole(parts)
                    parts = []
                now = names[i].as_py()
                parts.append(b.slice(i, j - i))
        if parts:
            yield from whole(parts)

    return placed.repartition("component").sortWithinPartitions("component").mapInArrow(search, schema)


#: Names in the rings of one part of a search, and steps of one.
PART_NAMES, PART_STEPS = 2_000_000, 300_000
#: Edges that one search may hold.
MOST_EDGES = 5_000_000


def cycles(edges: DataFrame, most_edges: int = MOST_EDGES, give: str = "rings", inside: str = "", n: int = 20) -> DataFrame:
    """``nodes``: the cycles that back edges of one depth-first search close, each from its least node, the first repeated.

    The search takes nodes and targets in order, so its result is unique. It never leaves a weakly connected component of what is
    left after trimming, so each component is searched by itself, in one task. More than ``most_edges`` edges in a component raise
    an error: use :func:`cyclic_nodes`, which is distributed.

    Rings hold far more names than there are edges, so who asks no rings should not have them written out. ``give``:
    ``rings``; ``summary``, a row per component with ``rings`` (how many), ``entries`` (their nodes in all, the closing ones counted)
    and ``first`` (the least ``n`` of the texts ``a -> b -> a``), of the rings all of whose nodes lie ``inside`` a layer;
    ``members``, the ``id`` of all nodes on a ring. The last two take a step for a back edge, however long its ring is.
    """
    return {"rings": lambda: _written_rings(edges, most_edges), "summary": lambda: _ring_summary(edges, most_edges, inside, n), "members": lambda: _ring_members(edges, most_edges)}[give]()


def _written_rings(edges: DataFrame, most_edges: int) -> DataFrame:
    """The search hands on its steps, in parts with the path that each begins with; all tasks write the rings out."""

    def steps(ids: pa.Array, targets: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        def part(first: list[int], ops: list[tuple[int, int, int]]) -> pa.RecordBatch:
            kind, a, b = np.array(ops, np.int32).T
            begin = np.array(first, np.int32)
            used, at = np.unique(np.concatenate((begin, b[kind == 0])), return_inverse=True)  # numbers in the order of the names
            begin, b[kind == 0] = at[: len(begin)], at[len(begin) :]
            row = [ids.take(pa.array(used)).to_pylist(), begin.astype(np.int32).tobytes(), kind.astype(np.int8).tobytes(), a.tobytes(), b.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.list_(pa.string()), *[pa.binary()] * 4))], names=["names", "path", "kind", "a", "b"])

        path, first, ops, size = [], [], [], 0
        for op in _search(targets, starts):
            kind, place, last = op
            if kind == 0:
                path.append(last)
            elif kind == 1:
                path.pop()
            else:
                size += last - place + 1
            ops.append(op)
            if size > PART_NAMES or len(ops) > PART_STEPS:
                if size:
                    yield part(first, ops)
                first, ops, size = path.copy(), [], 0
        if size:
            yield part(first, ops)

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, begin, kind, a, b in zip(*batch.columns, strict=True):
                numbers = lambda x, t=np.int32: np.frombuffer(x.as_buffer(), t)
                begin, kind, a, b = numbers(begin), numbers(kind, np.int8), numbers(a), numbers(b)
                path = np.zeros(max(len(begin), int(a.max()) + 1), np.int32)
                path[: len(begin)] = begin
                held, size = [], 0
                for k, place, last in zip(kind.tolist(), a.tolist(), b.tolist(), strict=True):
                    if k == 0:
                        path[place] = last
                    elif k == 2:
                        ring = path[place:last]
                        i = int(ring.argmin())
                        held += (ring[i:].copy(), ring[:i].copy(), ring[i : i + 1].copy())
                        size += last - place + 1
                        if size > 200_000:
                            yield written(names.values, held)
                            held, size = [], 0
                if held:
                    yield written(names.values, held)

    def written(names: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(x) + len(y) + 1 for x, y in zip(held[::3], held[1::3], strict=True)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(held))))], names=["nodes"])

    parts = stored(_components_searched(edges, most_edges, steps, "names array<string>, path binary, kind binary, a binary, b binary"))
    n = parts.count()
    return parts.repartition(max(1, n)).mapInArrow(rings, "nodes array<string>")


def _ring_summary(edges: DataFrame, most_edges: int, inside: str, n: int) -> DataFrame:
    def found(ids: pa.Array, targets: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ids.to_pylist()
        out = [bool(inside) and x != inside and not x.startswith(f"{inside}.") for x in names]
        rank = [0] * len(names)  # in the order of texts that begin with a node, which is not that of names with blanks
        for r, i in enumerate(sorted(range(len(names)), key=lambda i: f"{names[i]} -> ")):
            rank[i] = r
        plain = not any(" ->" in x for x in names)  # else a text's beginning may not tell where its first name ends
        path: list[int] = []
        foreign: list[int] = []  # last place at or before each that lies outside
        low: list[int] = []  # last place at or before each whose node may begin one of the first rings
        rings = entries = 0
        best: list[tuple[str, int]] = []
        most = len(names)  # nodes above it begin none of the first rings
        for kind, place, last in _search(targets, starts):
            if kind == 0:
                path.append(last)
                foreign.append(place if out[last] else foreign[-1] if place else -1)
                low.append(place if rank[last] <= most else low[-1] if place else -1)
            elif kind == 1:
                path.pop()
                foreign.pop()
                low.pop()
            elif foreign[-1] < place:
                rings += 1
                entries += last - place + 1
                if low[-1] < place or not n:
                    continue
                ring = path[place:]
                least = min(ring)
                if rank[least] > most:
                    continue
                i = ring.index(least)
                text = " -> ".join([names[x] for x in (*ring[i:], *ring[:i], least)])
                if len(best) < n or text < best[-1][0]:
                    best = sorted([*best, (text, rank[least])])[:n]
                    if plain and len(best) == n and (now := max(x[1] for x in best)) < most:
                        most, at = now, -1
                        for j, x in enumerate(path):
                            at = j if rank[x] <= most else at
                            low[j] = at
        if rings:
            yield pa.RecordBatch.from_arrays([pa.array([rings], pa.int64()), pa.array([entries], pa.int64()), pa.array([[x[0] for x in best]], pa.list_(pa.string()))], names=["rings", "entries", "first"])

    return _components_searched(edges, most_edges, found, "rings long, entries long, first array<string>")


def _ring_members(edges: DataFrame, most_edges: int) -> DataFrame:
    def found(ids: pa.Array, targets: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        path: list[int] = []
        back: list[int] = []  # the least place that a back edge from each, or from below it, leads to
        on = np.zeros(len(ids), bool)
        for kind, place, last in _search(targets, starts):
            if kind == 0:
                path.append(last)
                back.append(len(on))
            elif kind == 2:
                back[-1] = min(back[-1], place)
            else:
                node, least = path.pop(), back.pop()
                on[node] = least <= place
                if place:
                    back[-1] = min(back[-1], least)
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(on))], names=["id"])

    return _components_searched(edges, most_edges, found, "id string")


def _triangles(pairs: DataFrame, most: int) -> DataFrame:
    """``nodes``: a, b, c, a of all edges a to b, b to c, c to a where a is the least.

    Nodes are dealt to p groups and triples of nodes to p * p * p cells; an edge goes to the cells in which it can be the first, second
    or third one, 2 p on the average. So no path of two edges, of which there are far more than edges, is ever exchanged or stored:
    a cell, of about ``most`` edges, is searched by itself.
    """
    p = max(1, math.ceil(math.sqrt(2 * pairs.count() / most)))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    g, h, any_ = group("src"), group("dst"), F.explode(F.sequence(F.lit(0), F.lit(p - 1)))
    cell = lambda a, b, c: ((a * p + b) * p + c).alias("cell")
    with_any = pairs.select("src", "dst", g.alias("g"), h.alias("h"), any_.alias("x"))
    up, x = F.col("src") < F.col("dst"), F.col("x")
    role = F.explode(F.array(F.struct(F.when(up, F.lit(1)).otherwise(F.lit(3)).alias("role"), F.when(up, cell(F.col("g"), F.col("h"), x)).otherwise(cell(F.col("h"), x, F.col("g"))).alias("cell")), F.struct(F.lit(2).alias("role"), cell(x, F.col("g"), F.col("h")))))
    dealt = with_any.filter("src <> dst").select("src", "dst", role.alias("r")).select(F.col("r.cell").alias("cell"), F.col("r.role").cast("byte").alias("role"), "src", "dst")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for b in batches:
            for kept, column in zip(parts, b.columns):
                if column.type == pa.string():
                    x = column.dictionary_encode()
                    codes = np.array([ids.setdefault(v, len(ids)) for v in x.dictionary.to_pylist()], np.int32)
                    kept.append(codes[x.indices.to_numpy()])
                else:
                    kept.append(column.to_numpy())
        if not parts[0]:
            return
        cells, roles, src, dst = (np.concatenate(x) for x in parts)
        parts.clear()
        names, n = pa.array(list(ids), pa.string()), len(ids)
        ids.clear()
        for k in np.unique(cells):
            here = cells == k
            role, s, d = roles[here], src[here], dst[here]
            (a1, b1), (b2, c2), (c3, a3) = ((s[role == i], d[role == i]) for i in (1, 2, 3))
            o1, o2, o3 = np.argsort(a1, kind="stable"), np.argsort(b2, kind="stable"), np.argsort(a3, kind="stable")
            a1, b1, c2, a3, c3 = a1[o1], b1[o1], c2[o2], a3[o3], c3[o3]
            first = np.searchsorted(b2[o2], np.arange(n + 1))
            mark = np.zeros(n, bool)
            heads, at1 = np.unique(a1, return_index=True)
            at1 = np.append(at1, len(a1))
            lo3, hi3 = np.searchsorted(a3, heads), np.searchsorted(a3, heads, "right")
            out, size = [], 0
            for i, a in enumerate(heads.tolist()):
                if lo3[i] == hi3[i]:
                    continue
                back = c3[lo3[i] : hi3[i]]
                mark[back] = True
                bs = b1[at1[i] : at1[i + 1]]
                width = first[bs + 1] - first[bs]
                for x in np.split(np.arange(len(bs)), np.flatnonzero(np.diff(np.cumsum(width) // 2_000_000)) + 1):  # paths of two edges that are looked at at once
                    w = width[x]
                    total = int(w.sum())
                    if not total:
                        continue
                    ends = np.cumsum(w)
                    c = c2[np.arange(total) + np.repeat(first[bs[x]] - ends + w, w)]
                    hit = np.flatnonzero(mark[c])
                    if not len(hit):
                        continue
                    many = np.bincount(np.searchsorted(ends, hit, "right"), minlength=len(x))
                    got = np.flatnonzero(many)
                    out.append((np.full(len(got), a, np.int32), bs[x[got]], many[got], c[hit]))
                    size += len(hit)
                    if size > 300_000:
                        yield batch(names, out)
                        out, size = [], 0
                mark[back] = False
            if out:
                yield batch(names, out)

    def batch(names: pa.Array, out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, many, c = (np.concatenate(x) for x in zip(*out))
        ends = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.ListArray.from_arrays(ends, names.take(pa.array(c)))], names=["a", "b", "c"])

    # dealt to more partitions than cells, so that few hold two
    found = dealt.repartition(3 * p**3, "cell").mapInArrow(search, "a string, b string, c array<string>")
    return found.select("a", "b", F.explode("c").alias("c")).select(F.array("a", "b", "c", "a").alias("nodes"))


def bounded_cycles(edges: DataFrame, longest: int = 3, most_edges: int = 3_000_000) -> DataFrame:
    """``nodes``: all simple cycles of at most ``longest`` edges, each once, from its least node, the first repeated.

    Cycles of three edges are found in cells of about ``most_edges`` edges; longer ones by joins that hold every shorter path.
    """
    pairs = stored(_pairs(edges))
    out = pairs.filter("src = dst").select(F.array("src", "src").alias("nodes"))
    if longest >= 2:
        # both ways of a pair meet in one row
        both = pairs.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n")).filter("n = 2")
        out = out.unionByName(both.select(F.array("a", "b", "a").alias("nodes")))
    if longest >= 3:
        out = out.unionByName(_triangles(pairs, most_edges))
    if longest > 3:
        paths = pairs.filter("src < dst").select(F.array("src", "dst").alias("p"))
        for k in range(2, longest + 1):
            step = paths.join(pairs, F.element_at("p", -1) == F.col("src"))
            if k > 3:
                out = out.unionByName(step.filter(F.col("dst") == F.col("p")[0]).select(F.concat("p", F.array("dst")).alias("nodes")))
            paths = step.filter((F.col("dst") > F.col("p")[0]) & ~F.array_contains("p", F.col("dst"))).select(F.concat("p", F.array("dst")).alias("p"))
    return out


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """``id`` of nodes left once sinks and sources are trimmed again and again: those on cycles or on paths between cycles."""
    left = trim_sinks(edges)
    while not left.isEmpty():
        back = trim_sinks(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        now = trim_sinks(back)
        if now.count() == left.count():
            break
        left = now
    return node_universe(left.select("src"), left.select("dst"))


def cycle_violations(found: DataFrame) -> DataFrame:
    return found.select(F.lit("CYCLE").alias("kind"), F.array_join("nodes", " -> ").alias("message"), "nodes", F.lit(None).cast("string").alias("artifact_type"), F.lit(None).cast("boolean").alias("is_identical"))


def reexport_closure(aliases: DataFrame) -> DataFrame:
    """``name``, ``target`` from ``aliases(name, target)``, followed to the end; names on or into a ring are dropped.

    Pointer jumping: the distance covered doubles in each round.
    """
    state = cut(aliases.select("name", "target").groupBy("name").agg(F.min("target").alias("target")))
    rounds = max(1, state.count().bit_length())
    for _ in range(rounds + 1):
        step = state.join(state.select(F.col("name").alias("target"), F.col("target").alias("beyond")), "target", "left")
        state = cut(step.select("name", F.coalesce("beyond", "target").alias("target")))
        if state.join(state.select(F.col("name").alias("target")), "target", "left_semi").isEmpty():
            return state
    return state.join(state.select(F.col("name").alias("target")), "target", "left_anti").select("name", "target")
