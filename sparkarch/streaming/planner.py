"""From a change to a plan: which tables a module's new facts make stale, by ordered rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prefixes

# Names of table families and of graph results.
EXISTENCE = ("modules", "definitions", "identity_registry", "module_usages", "dependency_graph", "artifact_consumption", "cached_analytics", "collision_facts", "collisions")
GRAPH_RESULTS = ("macro_metrics", "reverse_blast_radius", "advanced_graph_metrics", "cycles")
COLLISIONS = ("collision_facts", "collisions")


@dataclass(frozen=True)
class Delta:
    """What changed in one module. Aliases and usage are changes of facts; artifacts those of definitions."""

    module: str
    is_new: bool = False
    is_deleted: bool = False
    imports: bool = False
    artifacts_added_or_removed: bool = False
    artifacts_changed: bool = False
    aliases: bool = False
    usage: bool = False
    collision_facts: bool = False

    @property
    def is_empty(self) -> bool:
        return self == Delta(self.module)


@dataclass(frozen=True)
class Plan:
    """Families to patch, graph results to compute anew, and which other modules' usage to resolve again."""

    rule: str
    patch: tuple[str, ...] = ()
    graph: tuple[str, ...] = ()
    recompute: str = field(default="none")  # none, dependents, alias_users


def plan(d: Delta) -> Plan:
    """The first rule that fits: nothing, deleted, added, aliases, imports, definitions, body only."""
    extra = COLLISIONS if d.collision_facts else ()
    if d.is_empty:
        return Plan("no-op")
    if d.is_deleted or d.is_new:
        return Plan("delete" if d.is_deleted else "add", EXISTENCE, GRAPH_RESULTS, "dependents")
    graph = GRAPH_RESULTS if d.imports else ()
    if d.aliases:
        links = ("modules", "dependency_graph") if d.imports else ()
        return Plan("alias", ("definitions", "module_usages", "artifact_consumption", *links, "cached_analytics", *extra), graph, "alias_users")
    if d.imports:
        return Plan("import", ("modules", "definitions", "module_usages", "dependency_graph", "artifact_consumption", "cached_analytics", *extra), graph)
    if d.artifacts_added_or_removed or d.artifacts_changed:
        cached = ("cached_analytics",) if d.artifacts_added_or_removed or d.usage else ()
        return Plan("definition", ("definitions", "identity_registry", "module_usages", "artifact_consumption", *cached, *extra), (), "dependents")
    body = ("module_usages", "artifact_consumption", "cached_analytics") if d.usage else ()
    return Plan("body" if d.usage else "collision", (*body, *extra))


def plans(found: DataFrame) -> DataFrame:
    """Rows of :func:`deltas` with ``rule``, ``patch``, ``graph`` and ``recompute``: one plan for each set of flags that occurs, 256 at most."""
    flags = [c for c in found.columns if c != "module_id"]
    rows = []
    for r in found.select(*flags).distinct().collect():
        p = plan(Delta("", **r.asDict()))
        rows.append((*r, p.rule, list(p.patch), list(p.graph), p.recompute))
    known = found.sparkSession.createDataFrame(rows, ", ".join([*(f"{c} boolean" for c in flags), "rule string, patch array<string>, graph array<string>, recompute string"]))
    return found.join(F.broadcast(known), flags)


def dependents(usage: DataFrame, aliases: DataFrame, changed: DataFrame) -> DataFrame:
    """``module_id`` of other modules that refer to a changed one (``changed(module_id)``) or to anything in it.

    ``usage(module_id, value)`` and ``aliases(module_id, alias, target)``. Names are resolved by the module's own aliases, then
    each prefix is looked up.
    """
    refs = usage.select("module_id", F.col("value").alias("name")).unionByName(aliases.select("module_id", F.col("target").alias("name"))).distinct()
    resolved = prefixes.resolve_aliases(refs, aliases).select("module_id", "resolved")
    hits = prefixes.under(resolved, "resolved", changed.select(F.col("module_id").alias("changed")), "changed")
    return hits.filter("root <> module_id").select("module_id").distinct()


def alias_users(usage: DataFrame, aliases: DataFrame, changed: DataFrame) -> DataFrame:
    """``module_id`` of other modules with any alias, call or qualified reference."""
    every = usage.filter("channel in ('direct_calls', 'qualified_refs')").select("module_id").unionByName(aliases.select("module_id")).distinct()
    return every.join(changed.select("module_id"), "module_id", "left_anti")


def deltas(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """A row per changed module with the flags of :class:`Delta`; tables modules, imports, symbols, usage, collisions of each side.

    Usage rows of channel ``aliases`` are the alias changes.
    """
    from ..operators.diffs import rows_diff, symbol_diff

    one = lambda df, c: df.select("module_id").distinct().withColumn(c, F.lit(True))
    known = rows_diff(old["modules"].select("module_id"), new["modules"].select("module_id"), ["module_id"])
    imports = rows_diff(*[t["imports"].select("module_id", F.col("module"), "level", F.array_join("names", ",").alias("n"), "is_local", "type_only") for t in (old, new)], ["module_id", "module", "level", "n", "is_local", "type_only"])
    symbols = symbol_diff(old["symbols"], new["symbols"])
    usage = rows_diff(old["usage"], new["usage"], ["module_id", "channel", "value", "extra"])
    collisions = rows_diff(*[t["collisions"].select("module_id", "name", "type", F.sha2("code", 256).alias("h")) for t in (old, new)], ["module_id", "name", "type", "h"])
    parts = [
        one(known.filter("op = 'added'"), "is_new"), one(known.filter("op = 'removed'"), "is_deleted"), one(imports, "imports"), one(symbols.filter("change in ('added', 'removed')"), "artifacts_added_or_removed"),
        one(symbols.filter("change = 'signature' or change = 'body'"), "artifacts_changed"), one(usage.filter("channel = 'aliases'"), "aliases"), one(usage.filter("channel <> 'aliases'"), "usage"), one(collisions, "collision_facts"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "module_id", "full_outer")
    flags = [c for c in out.columns if c != "module_id"]
    return out.select("module_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
