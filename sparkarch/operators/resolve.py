"""Import resolution and the dependency graph.

``imports(module_id, pos, module, level, names, is_from_import, is_local, type_only)`` against ``modules(module_id, ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .prefixes import longest_prefix


def candidate(package_root: str | None = None) -> Column:
    """The absolute name an import means: a relative one drops as many of the module's last segments as its level.

    A level that drops all of them leaves the imported name alone. The package root is cut off the front.
    """
    parts = F.split("module_id", r"\.")
    kept = F.size(parts) - F.col("level")
    base = F.when(kept > 0, F.array_join(F.slice(parts, 1, F.greatest(kept, F.lit(1))), ".")).otherwise("")
    name = F.coalesce("module", F.lit(""))
    relative = F.when(name == "", base).when(base == "", name).otherwise(F.concat_ws(".", base, name))
    full = F.when(F.col("level") <= 0, name).otherwise(relative)
    if not package_root:
        return full
    return F.when(full.startswith(f"{package_root}."), F.substring(full, len(package_root) + 2, 1 << 30)).otherwise(full)


def package_root(imports: DataFrame, modules: DataFrame) -> str | None:
    """The first segment without which most imports start with a known module that don't with it; ties go to the smaller, null if none."""
    dotted = imports.select(F.col("module").alias("name")).filter(F.col("name").contains("."))
    counted = cut(dotted.groupBy("name").agg(F.count("*").alias("n")))
    whole = longest_prefix(counted, "name", modules, "module_id").filter("prefix is null").select("name", "n", F.substring_index("name", ".", 1).alias("head"), F.expr("substring(name, instr(name, '.') + 1)").alias("tail"))
    rest = longest_prefix(whole, "tail", modules, "module_id").filter("prefix is not null")
    top = rest.groupBy("head").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "head").first()
    return top and top["head"]


def resolve_imports(imports: DataFrame, modules: DataFrame, root: str | None = None) -> DataFrame:
    """``module_id``, ``pos``, ``target``, ``kind``, ``used_symbol`` of each import.

    The module of just that name (MODULE), else the longest module above it (FALLBACK), else the module that the alphabetically
    first imported name makes of it (FALLBACK with ``used_symbol``), else UNKNOWN. Every step is an equality join.
    """
    rows = imports.withColumn("candidate", candidate(root))
    found = longest_prefix(rows, "candidate", modules, "module_id")
    known = modules.select(F.col("module_id").alias("target")).distinct()
    open_ = found.filter("prefix is null").select("module_id", "pos", "candidate", F.explode("names").alias("symbol"))
    tried = open_.withColumn("target", F.when(F.col("candidate") == "", F.col("symbol")).otherwise(F.concat_ws(".", "candidate", "symbol"))).join(known, "target")
    by_symbol = tried.groupBy("module_id", "pos").agg(F.min("symbol").alias("used_symbol"), F.min_by("target", "symbol").alias("symbol_target"))
    out = found.join(by_symbol, ["module_id", "pos"], "left")
    kind = F.when(F.col("prefix") == F.col("candidate"), "MODULE").when(F.col("prefix").isNotNull() | F.col("symbol_target").isNotNull(), "FALLBACK").otherwise("UNKNOWN")
    return out.select("module_id", "pos", F.coalesce("prefix", "symbol_target").alias("target"), kind.alias("kind"), F.when(F.col("prefix").isNull(), F.col("used_symbol")).alias("used_symbol"))


def graph_edges(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``edge_type``: hard for modules found by name, soft for fallbacks and imports for type checking only."""
    both = resolved.join(imports.select("module_id", "pos", "type_only"), ["module_id", "pos"]).filter("target is not null and target <> module_id")
    kind = F.when(F.coalesce("type_only", F.lit(False)), "soft").when(F.col("kind") == "MODULE", "hard").otherwise("soft")
    return both.select(F.col("module_id").alias("src"), F.col("target").alias("dst"), kind.alias("edge_type")).distinct()


def build_graph(imports: DataFrame, modules: DataFrame, root: str | None = None) -> DataFrame:
    """Edges of the whole graph; the package root is detected if none is given."""
    root = root or package_root(imports, modules)
    return graph_edges(imports, resolve_imports(imports, modules, root))


def replace_out_edges(edges: DataFrame, module_ids: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those out of the given modules (column ``id``) replaced."""
    return edges.join(module_ids.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "edge_type").unionByName(new.select("src", "dst", "edge_type"))


def drop_modules(edges: DataFrame, module_ids: DataFrame) -> DataFrame:
    """Edges without any that touch the given modules."""
    for end in ("src", "dst"):
        edges = edges.join(module_ids.select(F.col("id").alias(end)), end, "left_anti")
    return edges.select("src", "dst", "edge_type")


def classify_import(module: Column, is_local: Column, internal: Column) -> Column:
    """internal / external, and local / global."""
    return F.concat_ws("_", F.when(internal, "internal").otherwise("external"), F.when(is_local, "local").otherwise("global"))
