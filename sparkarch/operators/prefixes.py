"""Joins on dotted names: exact, longest prefix, and prefix membership.

A prefix condition as such would compare every pair of rows. Here each name becomes a row per prefix of whole segments, and the
join is an equality; a name has as many prefixes as segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(name: Column, separator: str = ".") -> Column:
    """Array of the prefixes of whole segments, the shortest first; empty for null and for an empty name."""
    parts = F.split(name, separator.replace(".", r"\.").replace("::", "::"))
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    return F.when(name.isNull() | (name == ""), F.array().cast("array<string>")).otherwise(each)


def exact(rows: DataFrame, name: str, targets: DataFrame, target: str) -> DataFrame:
    """``rows`` with ``matched``: the target of just that name, or null."""
    keys = targets.select(F.col(target).alias("matched")).distinct()
    return rows.join(keys, F.col(name) == F.col("matched"), "left")


def longest_prefix(rows: DataFrame, name: str, targets: DataFrame, target: str, key: list[str] | None = None) -> DataFrame:
    """``rows`` with ``prefix``, the longest target that is the name or a prefix of its segments, and ``rest``; null if none.

    ``key``: columns that must be equal besides, for targets that belong to a module each. Only distinct names are looked up.
    """
    key = key or []
    names = rows.select(*key, F.col(name).alias("__name")).distinct()
    each = names.select(*key, "__name", F.posexplode(prefixes(F.col("__name"))).alias("__depth", "__prefix"))
    hits = each.join(targets.select(*key, F.col(target).alias("__prefix")).distinct(), [*key, "__prefix"])
    best = hits.groupBy(*key, "__name").agg(F.max_by("__prefix", "__depth").alias("prefix"))
    out = rows.withColumn("__name", F.col(name)).join(best, [*key, "__name"], "left").drop("__name")
    return out.withColumn("rest", F.when(F.col("prefix").isNotNull(), F.expr(f"substring({name}, length(prefix) + 2)")))


def resolve_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``refs(module_id, name)`` with ``resolved``: the longest alias of the module at the name's start replaced by its target."""
    named = longest_prefix(refs, "name", aliases.select("module_id", "alias").distinct(), "alias", ["module_id"])
    targets = aliases.groupBy("module_id", F.col("alias").alias("prefix")).agg(F.min("target").alias("target"))
    out = named.join(targets, ["module_id", "prefix"], "left")
    whole = F.when(F.coalesce("rest", F.lit("")) == "", F.col("target")).otherwise(F.concat_ws(".", "target", "rest"))
    return out.withColumn("resolved", F.when(F.col("target").isNull(), F.col("name")).otherwise(whole)).drop("prefix", "rest", "target")


def under(rows: DataFrame, name: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows whose name is a root, or below one after ``.`` or ``::``; with ``root``: a row for each that fits."""
    plain = F.regexp_replace(name, "::", ".")
    each = rows.withColumn("__root", F.explode(prefixes(plain)))
    keys = roots.select(F.regexp_replace(F.col(root), "::", ".").alias("__root"), F.col(root).alias("root")).distinct()
    return each.join(keys, "__root").drop("__root")


def suffixes(path: Column, separator: str = "/") -> Column:
    """Array of the suffixes of whole segments, the whole first."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def by_suffix(rows: DataFrame, path: str, targets: DataFrame, target: str) -> DataFrame:
    """``rows`` with ``matched``: the target equal to the path, else the one of which it is the only suffix match, else null."""
    asked = rows.select(F.col(path).alias("__path")).distinct()
    each = targets.select(F.col(target).alias("matched"), F.posexplode(suffixes(F.col(target))).alias("__cut", "__path")).join(asked, "__path")
    # the whole path (nothing cut) beats suffixes; several suffix matches are ambiguous
    found = each.groupBy("__path").agg(F.max(F.when(F.col("__cut") == 0, F.col("matched"))).alias("__whole"), F.count_distinct("matched").alias("__n"), F.min("matched").alias("__one"))
    chosen = found.select("__path", F.coalesce("__whole", F.when(F.col("__n") == 1, F.col("__one"))).alias("matched"))
    return rows.withColumn("__path", F.col(path)).join(chosen, "__path", "left").drop("__path")
