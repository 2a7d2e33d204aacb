"""Degrees, graph metrics, the dependency matrix and what is counted from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dependency type of each channel, and of kinds without channel evidence. Fixed values.
CHANNEL_TYPE = {
    "direct_calls": "call", "runtime_calls": "call", "callback_calls": "call", "event_bindings": "call",
    "api_imports": "import", "qualified_refs": "import", "inheritance": "inheritance",
}
KIND_TYPE = {"function": "call", "method": "call"}


def hard(edges: DataFrame) -> DataFrame:
    return edges.filter("edge_type = 'hard'").select("src", "dst").distinct()


def node_universe(*columns: DataFrame) -> DataFrame:
    """Distinct ids of frames of one column each, named ``id``."""
    out = columns[0].toDF("id")
    for c in columns[1:]:
        out = out.unionByName(c.toDF("id"))
    return out.filter("id is not null").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return node_universe(edges.select("src"), edges.select("dst"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id``, ``in_degree``, ``out_degree`` of every node, zeros included.

    One exchange by id: both ends of each edge become a row, and counts are combined before they are shuffled.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def graph_metrics(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges by type, density of hard edges, largest hard degrees."""
    typed = edges.select("src", "dst", "edge_type").distinct()
    counts = typed.agg(F.count_if(F.col("edge_type") == "hard").alias("edges_hard"), F.count_if(F.col("edge_type") == "soft").alias("edges_soft"), F.count("*").alias("edges_total"))
    every = nodes_of(typed) if nodes is None else node_universe(typed.select("src"), typed.select("dst"), nodes.select("id"))
    per = degrees(hard(typed), every).agg(F.count("*").alias("nodes"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("in_degree_max"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("out_degree_max"))
    n = F.col("nodes")
    density = F.when(n > 1, F.round(F.col("edges_hard") / (n * F.greatest(n - 1, F.lit(1))), 4)).otherwise(0.0)
    return per.crossJoin(counts).select("nodes", "edges_hard", "edges_soft", "edges_total", density.alias("density"), "in_degree_max", "out_degree_max")  # one row each


def artifact_types(usage: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``definer``, ``symbol``, ``types``: dependency types of an artifact's known channels, else the one of its kind."""
    by_channel = F.create_map(*[F.lit(x) for kv in CHANNEL_TYPE.items() for x in kv])
    by_kind = F.create_map(*[F.lit(x) for kv in KIND_TYPE.items() for x in kv])
    each = usage.groupBy("definer", "symbol").agg(F.array_sort(F.collect_set(by_channel[F.col("channel")])).alias("types"))
    kind = F.lit("import")
    if kinds is not None:
        each = each.join(kinds.select("definer", "symbol", "kind"), ["definer", "symbol"], "left")
        kind = F.coalesce(by_kind[F.col("kind")], kind)
    return each.select("definer", "symbol", F.when(F.size("types") == 0, F.array(kind)).otherwise(F.col("types")).alias("types"))


def matrix(usage: DataFrame, edges: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """``consumer``, ``definer``, ``weight`` (artifacts used), ``dep_types``: self pairs are left out.

    An artifact's types come from all its usage, and a pair has the types of all artifacts it shares. Every hard edge adds the
    type ``import``; without usage its weight is 0. Inheritance is a type only where a channel says so.
    """
    pairs = usage.filter("consumer <> definer").select("definer", "symbol", "consumer").distinct()
    cells = pairs.join(artifact_types(usage, kinds), ["definer", "symbol"]).select("consumer", "definer", F.lit(1).alias("w"), "types")
    if edges is not None:
        imports = hard(edges).filter("src <> dst").select(F.col("src").alias("consumer"), F.col("dst").alias("definer"), F.lit(0).alias("w"), F.array(F.lit("import")).alias("types"))
        cells = cells.unionByName(imports)
    # few distinct sets of types: a set of sets stays small however many artifacts a pair shares
    out = cells.groupBy("consumer", "definer").agg(F.sum("w").alias("weight"), F.collect_set("types").alias("t"))
    return out.select("consumer", "definer", "weight", F.array_sort(F.array_distinct(F.flatten("t"))).alias("dep_types"))


def dep_type_breakdown(cells: DataFrame) -> DataFrame:
    """``dep_type``, ``pairs``."""
    return cells.select(F.explode("dep_types").alias("dep_type")).groupBy("dep_type").agg(F.count("*").alias("pairs"))


def fan(cells: DataFrame) -> DataFrame:
    """``id``, ``fan_in`` (consumers) and ``fan_out`` (definers) from the matrix."""
    return degrees(cells.select(F.col("consumer").alias("src"), F.col("definer").alias("dst"))).select("id", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))


def export_degree(usage: DataFrame) -> DataFrame:
    """``definer``, ``export_degree``: artifacts that anyone uses."""
    return usage.groupBy("definer").agg(F.count_distinct("symbol").alias("export_degree"))


def scoped(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges with both ends in the scope (column ``id``)."""
    return edges.join(scope.select(F.col("id").alias("src")), "src", "left_semi").join(scope.select(F.col("id").alias("dst")), "dst", "left_semi")


def import_profile(imports: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """``module_id``, ``global_imports``, ``local_imports``; modules that import nothing have zeros if ``modules(module_id)`` is given."""
    per = imports.groupBy("module_id").agg(F.count_if(~F.col("is_local")).alias("global_imports"), F.count_if("is_local").alias("local_imports"))
    if modules is None:
        return per
    out = modules.select("module_id").distinct().join(per, "module_id", "left")
    return out.select("module_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("global_imports", "local_imports")])
