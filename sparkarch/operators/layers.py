"""Layers: classification by prefix rules, visibility, boundaries, violations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LAYER_ORDER
from .degrees import degrees, hard

DEFAULT_LAYER = "adapter"
#: Pairs of layers, and a layer with a prefix, that must not depend on each other. Fixed values.
FORBIDDEN_LAYERS = (("ui", "cli"), ("cli", "ui"))
FORBIDDEN_PREFIXES = (("ui", "core.internal"),)


def layer_by_rules(name: Column, rules: list[tuple[str, str]], default: str = DEFAULT_LAYER) -> Column:
    """Layer of the first rule whose prefix the name has, in the rules' order."""
    out = None
    for prefix, layer in rules:
        out = F.when(name.startswith(prefix), layer) if out is None else out.when(name.startswith(prefix), layer)
    return F.lit(default) if out is None else out.otherwise(default)


def top_layer(name: Column) -> Column:
    return F.split(name, r"\.")[0]


def in_layer(name: Column, prefix: str) -> Column:
    """The layer itself or below it; an empty prefix is the root and holds all. A sibling that only begins alike is outside."""
    return F.lit(True) if not prefix else (name == prefix) | name.startswith(f"{prefix}.")


def visibility(modules: DataFrame, usage: DataFrame) -> DataFrame:
    """``module_id``, ``layer``, ``visibility``: public if a module of another layer uses it, internal if only its own, else private.

    ``modules(module_id, layer)``; ``usage(definer, consumer, ...)``. One row per pair of layers is exchanged per definer.
    """
    pairs = usage.filter("consumer <> definer").select("definer", "consumer").distinct()
    seen = pairs.join(modules.select(F.col("module_id").alias("consumer"), F.col("layer").alias("__from")), "consumer", "left")
    seen = seen.groupBy(F.col("definer").alias("module_id")).agg(F.collect_set(F.coalesce("__from", F.lit(DEFAULT_LAYER))).alias("__layers"))
    out = modules.join(seen, "module_id", "left")
    kind = F.when(F.col("__layers").isNull(), "private").when(F.exists("__layers", lambda x: x != F.col("layer")), "public").otherwise("internal")
    return out.select("module_id", "layer", kind.alias("visibility"))


def boundary(edges: DataFrame, members: DataFrame, layer: str) -> DataFrame:
    """``src``, ``dst``, ``direction`` (internal, inbound, outbound) of hard edges that touch a layer; ``members(module_id, layer)``."""
    own = members.filter(F.col("layer") == layer).select("module_id").distinct()
    pairs = hard(edges)
    s, d = own.select(F.col("module_id").alias("src"), F.lit(True).alias("__s")), own.select(F.col("module_id").alias("dst"), F.lit(True).alias("__d"))
    both = pairs.join(s, "src", "left").join(d, "dst", "left").filter("__s or __d")
    way = F.when(F.col("__s") & F.col("__d"), "internal").when(F.col("__d"), "inbound").otherwise("outbound")
    return both.select("src", "dst", way.alias("direction"))


def boundary_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``layer``, numbers of internal, inbound and outbound hard edges, for every layer in one pass over the edges."""
    of = members.select("module_id", "layer").distinct()
    both = hard(edges).join(of.select(F.col("module_id").alias("src"), F.col("layer").alias("a")), "src", "left").join(of.select(F.col("module_id").alias("dst"), F.col("layer").alias("b")), "dst", "left")
    same = F.col("a") == F.col("b")
    each = both.select(F.explode(F.when(same, F.array(F.struct(F.col("a").alias("layer"), F.lit("internal").alias("way")))).otherwise(F.array(F.struct(F.col("a").alias("layer"), F.lit("outbound").alias("way")), F.struct(F.col("b").alias("layer"), F.lit("inbound").alias("way"))))).alias("x")).select("x.*")
    return each.filter("layer is not null").groupBy("layer").agg(*[F.count_if(F.col("way") == w).alias(f"{w}_edges") for w in ("internal", "inbound", "outbound")])


def rank_violations(cells: DataFrame, members: DataFrame, order: tuple[str, ...] = LAYER_ORDER) -> DataFrame:
    """``src``, ``src_layer``, ``dst``, ``dst_layer`` where a layer uses one that stands before it; unknown layers never count."""
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)])
    of = members.select("module_id", "layer").distinct()
    both = cells.select(F.col("consumer").alias("src"), F.col("definer").alias("dst")).filter("src <> dst").distinct()
    both = both.join(of.select(F.col("module_id").alias("src"), F.col("layer").alias("src_layer")), "src").join(of.select(F.col("module_id").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
    return both.filter(rank[F.col("src_layer")] > rank[F.col("dst_layer")]).select("src", "src_layer", "dst", "dst_layer")


def rule_violations(edges: DataFrame, members: DataFrame, layers=FORBIDDEN_LAYERS, prefixes=FORBIDDEN_PREFIXES) -> DataFrame:
    """``src``, ``dst``, ``rule`` of hard edges between forbidden layers, or from a layer to names with a forbidden prefix."""
    of = members.select("module_id", "layer").distinct()
    both = hard(edges).join(of.select(F.col("module_id").alias("src"), F.col("layer").alias("a")), "src").join(of.select(F.col("module_id").alias("dst"), F.col("layer").alias("b")), "dst", "left")
    rule = None
    for a, b in layers:
        hit = (F.col("a") == a) & (F.col("b") == b)
        rule = F.when(hit, f"{a}->{b}") if rule is None else rule.when(hit, f"{a}->{b}")
    for a, p in prefixes:
        hit = (F.col("a") == a) & ((F.col("dst") == p) | F.col("dst").startswith(f"{p}."))
        rule = F.when(hit, f"{a}->{p}") if rule is None else rule.when(hit, f"{a}->{p}")
    return both.withColumn("rule", rule if rule is not None else F.lit(None).cast("string")).filter("rule is not null").select("src", "dst", "rule")


def inside(nodes: str, prefix: str) -> Column:
    """All of an array of modules lie in the layer: cycles and collisions that belong to it."""
    return F.forall(nodes, lambda n: in_layer(n, prefix))


def layer_collisions(collisions: DataFrame, prefix: str) -> DataFrame:
    return collisions.filter(~F.col("is_identical") & inside("nodes", prefix))


def layer_degrees(edges: DataFrame, members: DataFrame, layer: str) -> DataFrame:
    """``id`` of each module of a layer with degrees, boundary edges included, and those inside the layer only."""
    own = members.filter(F.col("layer") == layer).select(F.col("module_id").alias("id")).distinct()
    found = boundary(edges, members, layer)
    every = degrees(found.select("src", "dst"))
    within = degrees(found.filter("direction = 'internal'").select("src", "dst")).select("id", F.col("in_degree").alias("internal_in"), F.col("out_degree").alias("internal_out"))
    out = own.join(every, "id", "left").join(within, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree", "internal_in", "internal_out")])


def layer_metrics(edges: DataFrame, members: DataFrame, nodes: int, global_density: float) -> DataFrame:
    """``layer``, ``nodes``, edges by direction, ``density``, ``density_ratio`` to the whole graph, for every layer."""
    size = members.groupBy("layer").agg(F.count_distinct("module_id").alias("nodes"))
    out = size.join(boundary_counts(edges, members), "layer", "left")
    zero = [F.coalesce(f"{w}_edges", F.lit(0)).alias(f"{w}_edges") for w in ("internal", "inbound", "outbound")]
    density = F.when(F.col("nodes") > 1, F.round(F.col("internal_edges") / (F.col("nodes") * (F.col("nodes") - 1)), 4)).otherwise(0.0)
    out = out.select("layer", "nodes", *zero).withColumn("density", density)
    return out.withColumn("density_ratio", F.round(F.col("density") / global_density, 2) if global_density > 0 else F.lit(0.0))


def recompute_layer(density_ratio: float, hub_score: float) -> str:
    """``full`` where a layer stands out so much that its hotspots must be computed anew, else ``filtered``."""
    return "full" if density_ratio > 3.0 or hub_score > 0.85 else "filtered"
