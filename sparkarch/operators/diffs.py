"""Differences between two versions of facts, edges, symbols and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a report's difference compares. Fixed values.
METRICS = ("nodes", "edges_total", "edges_hard", "edges_soft", "in_degree_max", "out_degree_max")
DEBT = ("hotspot_count", "isolated_count", "total_score")
LAYER = ("module_count", "cycles_count", "hotspot_count")


def rows_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``op``: rows of ``new`` that ``old`` lacks are added, the reverse removed. Nulls are equal.

    One exchange: each side is marked and the marks of a row are combined, rather than two anti joins.
    """
    both = old.select(*columns, F.lit(1).alias("__o"), F.lit(0).alias("__n")).unionByName(new.select(*columns, F.lit(0).alias("__o"), F.lit(1).alias("__n")))
    per = both.groupBy(*columns).agg(F.max("__o").alias("__o"), F.max("__n").alias("__n")).filter("__o <> __n")
    return per.select(*columns, F.when(F.col("__n") == 1, "added").otherwise("removed").alias("op"))


def facts_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    return rows_diff(old, new, ["module_id", "channel", "value", "extra"])


def file_delta(old_modules: DataFrame, new_modules: DataFrame, old_imports: DataFrame, new_imports: DataFrame, old_symbols: DataFrame, new_symbols: DataFrame) -> DataFrame:
    """``module_id``, ``is_new``, ``is_deleted``, sorted imports and artifacts added and removed, and artifacts whose signature changed."""
    known = rows_diff(old_modules, new_modules, ["module_id"]).withColumnRenamed("op", "m")
    imports = rows_diff(old_imports, new_imports, ["module_id", "value"]).select("module_id", F.concat_ws("_", F.lit("imports"), "op").alias("k"), "value")
    symbols = symbol_diff(old_symbols, new_symbols).select("module_id", F.concat_ws("_", F.lit("artifacts"), F.when(F.col("change").isin("added", "removed"), F.col("change")).otherwise("changed")).alias("k"), F.col("symbol").alias("value"))
    names = ("imports_added", "imports_removed", "artifacts_added", "artifacts_removed", "artifacts_changed")
    per = imports.unionByName(symbols).groupBy("module_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("k") == n, F.col("value")))).alias(n) for n in names])
    out = per.join(known, "module_id", "full_outer")
    empty = F.array().cast("array<string>")
    return out.select("module_id", F.coalesce(F.col("m") == "added", F.lit(False)).alias("is_new"), F.coalesce(F.col("m") == "removed", F.lit(False)).alias("is_deleted"), *[F.coalesce(n, empty).alias(n) for n in names])


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``module_id``, ``symbol``, ``change``: added, removed, signature or body; from (module_id, symbol, signature, body_fp)."""
    key = ["module_id", "symbol"]
    side = lambda df, p: df.select(*key, F.struct(F.col("signature").alias("s"), F.col("body_fp").alias("b")).alias(p))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o.s").eqNullSafe(F.col("n.s")), "signature").when(~F.col("o.b").eqNullSafe(F.col("n.b")), "body")
    return both.select(*key, change.alias("change")).filter("change is not null")


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    return rows_diff(old, new, ["src", "dst", "edge_type"])


def changed_degrees(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id`` with its hard degrees before and after, where they differ; a node that one graph lacks has degree 0 there."""
    from .degrees import degrees, hard

    a = degrees(hard(old)).select("id", F.col("in_degree").alias("old_in"), F.col("out_degree").alias("old_out"))
    b = degrees(hard(new)).select("id", F.col("in_degree").alias("new_in"), F.col("out_degree").alias("new_out"))
    both = a.join(b, "id", "full_outer").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("old_in", "old_out", "new_in", "new_out")])
    return both.filter("old_in <> new_in or old_out <> new_out")


def report_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``section``, ``name``, ``old``, ``new``, ``delta`` of values that differ; a missing value is 0. Input: (section, name, value)."""
    side = lambda df, c: df.groupBy("section", "name").agg(F.max("value").alias(c))
    both = side(old, "old").join(side(new, "new"), ["section", "name"], "full_outer")
    both = both.select("section", "name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("old", "new")])
    return both.filter("old <> new").withColumn("delta", F.round(F.col("new") - F.col("old"), 4))


def regression(diff: DataFrame) -> DataFrame:
    """One row, ``verdict``: REGRESSION if score or hotspots rose, IMPROVED if score, hotspots or isolated fell, else UNCHANGED."""
    delta = lambda n: F.coalesce(F.max(F.when((F.col("section") == "debt") & (F.col("name") == n), F.col("delta"))), F.lit(0.0))
    s, h, i = (delta(n) for n in ("total_score", "hotspot_count", "isolated_count"))
    return diff.agg(F.when((s > 0) | (h > 0), "REGRESSION").when((s < 0) | (h < 0) | (i < 0), "IMPROVED").otherwise("UNCHANGED").alias("verdict"))


def covered(targets: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """One row, ``missing`` and ``surplus``: how many keys only one side has. Both are 0 where coverage is complete."""
    diff = rows_diff(targets, found, key)
    return diff.agg(F.count_if(F.col("op") == "removed").alias("missing"), F.count_if(F.col("op") == "added").alias("surplus"))


def replace_slice(rows: DataFrame, keys: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """``rows`` with those of the given keys replaced: a consumer's slice rebuilt."""
    return rows.join(keys.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def unsorted(column: Column) -> Column:
    """An array that is not sorted, or holds a value twice."""
    return F.array_sort(F.array_distinct(column)) != column
