"""Pieces of reports: action items, import classes, API counts, consumption of symbols, test traces, and names for ids."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefixes import prefixes

#: Parts of names that make an isolated module an entry point. Fixed values.
ENTRY_PARTS = ("cli_", "__main__", "main", "scripts.", "entrypoint", "entry_")


def is_entry_name(name: Column) -> Column:
    tests = [(name == p) | name.endswith("." + p) | name.startswith(p) | name.contains("." + p) for p in ENTRY_PARTS]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def action_items(cycles: DataFrame, collisions: DataFrame, hotspots: DataFrame, most: int = 5) -> list[dict[str, Any]]:
    """What to do first, at most five: the first cycle, collisions, the worst outbound hotspot, isolated entry points and other isolated modules.

    Each takes one row or a count from the executors.
    """
    items: list[dict[str, Any]] = []
    ring = cycles.orderBy("nodes").first()
    if ring:
        items.append({"level": "CRITICAL", "action": "break_cycle", "target": ring["nodes"]})
    real = collisions.filter("not is_identical")
    worst = real.filter("severity = 'critical'").orderBy("name", "type").first()
    n = real.count()
    if n:
        items.append({"level": "BROKEN", "action": "fix_collision" if worst else "resolve_collisions", "target": worst["name"] if worst else None, "count": real.filter("severity = 'critical'").count() if worst else n})
    top = hotspots.filter("type = 'OUTBOUND_HOTSPOT'").orderBy(F.desc("score"), "module").first()
    if top:
        items.append({"level": "WARNING", "action": "refactor", "target": top["module"], "out_degree": top["out_degree"]})
    alone = hotspots.filter("type = 'ISOLATED'").select("module", is_entry_name(F.col("module")).alias("entry"))
    for entry, action in ((True, "isolated_entry_points"), (False, "isolated_modules")):
        own = alone.filter(F.col("entry") == entry)
        k = own.count()
        if k:
            items.append({"level": "INFO", "action": action, "count": k, "target": [r["module"] for r in own.orderBy("module").limit(3).collect()]})
    return items[:most]


def import_class(runtime: Column, typing: Column, exported: Column) -> list[Column]:
    """``classification`` (re_exported, runtime, type_only, unused), ``confidence`` and ``runtime_available`` of an imported name."""
    kind = F.when(exported, "re_exported").when(runtime > 0, "runtime").when(typing > 0, "type_only").otherwise("unused")
    sure = F.when((runtime > 0) | exported, "high").when(typing > 0, "medium").otherwise("low")
    return [kind.alias("classification"), sure.alias("confidence"), ((runtime > 0) | exported).alias("runtime_available")]


def import_usage_classes(usage: DataFrame, exports: DataFrame) -> DataFrame:
    """``usage(module_id, name, runtime, typing)`` with its class; names count as exported only where the module lists them itself."""
    listed = exports.filter("listed").select("module_id", "name").distinct().withColumn("e", F.lit(True))
    both = usage.join(listed, ["module_id", "name"], "left")
    return both.select("module_id", "name", "runtime", "typing", *import_class(F.col("runtime"), F.col("typing"), F.coalesce("e", F.lit(False))))


def classify_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``module_id``, ``name``, ``scope`` (internal or external), ``is_local`` of imported names.

    A name is internal if it, or a module above it, is known, or if a known module lies below it: two equality joins over prefixes.
    """
    rows = imports.filter("coalesce(module, '') <> ''").groupBy("module_id", F.col("module").alias("name")).agg(F.max("is_local").alias("is_local"))
    names = rows.select("name").distinct()
    known = modules.select("module_id").distinct()
    above = names.select("name", F.explode(prefixes(F.col("name"))).alias("module_id")).join(known, "module_id", "left_semi").select("name")
    below = names.join(known.select(F.explode(prefixes(F.col("module_id"))).alias("name")).distinct(), "name", "left_semi")
    inside = above.unionByName(below).distinct().withColumn("inside", F.lit(True))
    out = rows.join(inside, "name", "left")
    return out.select("module_id", "name", F.when(F.col("inside"), "internal").otherwise("external").alias("scope"), (F.col("is_local") & F.coalesce("inside", F.lit(False))).alias("is_local"))


def api_counts(api: DataFrame) -> DataFrame:
    """``module_id``, numbers of classes, functions, methods, public names, and of those with a docstring."""
    k = lambda x: F.count_if(F.col("kind") == x)
    return api.groupBy("module_id").agg(k("class").alias("classes"), k("function").alias("functions"), k("method").alias("methods"), F.count_if(F.col("visibility") == "public").alias("public"), F.count("doc").alias("documented"))


def symbol_view(usage: DataFrame, imported_by: DataFrame) -> DataFrame:
    """``definer``, ``symbol``, ``direct`` consumers, and ``transitive``: modules that import the definer but use nothing of it directly."""
    direct = usage.filter("consumer <> definer").groupBy("definer", "symbol").agg(F.array_sort(F.collect_set("consumer")).alias("direct"))
    known = usage.filter("consumer <> definer").select("definer", F.col("consumer").alias("module_id")).distinct()
    rest = imported_by.select("definer", "module_id").distinct().join(known, ["definer", "module_id"], "left_anti").groupBy("definer").agg(F.array_sort(F.collect_set("module_id")).alias("transitive"))
    return direct.join(rest, "definer", "left").select("definer", "symbol", "direct", F.coalesce("transitive", F.array().cast("array<string>")).alias("transitive"))


def test_trace(symbols: DataFrame, tested: DataFrame, tests: DataFrame) -> DataFrame:
    """``module_id``, ``tests`` that cover it, numbers of ``tested`` and ``untested`` symbols. Inputs: (module_id, symbol) twice, (test_path, module_id)."""
    files = tests.groupBy("module_id").agg(F.array_sort(F.collect_set("test_path")).alias("tests"))
    marked = symbols.select("module_id", "symbol").distinct().join(tested.select("module_id", "symbol").distinct().withColumn("t", F.lit(True)), ["module_id", "symbol"], "left")
    per = marked.groupBy("module_id").agg(F.count("t").alias("tested"), F.count_if(F.col("t").isNull()).alias("untested"))
    return per.join(files, "module_id", "left").select("module_id", F.coalesce("tests", F.array().cast("array<string>")).alias("tests"), "tested", "untested")


def compact(rows: DataFrame, columns: list[str], ids: DataFrame) -> DataFrame:
    """``rows`` with ids for the names in some columns; names without an id stay."""
    for c in columns:
        names = ids.filter("status = 'active'").select(F.col("name").alias(c), F.col("obj_id").alias("__id"))
        rows = rows.join(names, c, "left").withColumn(c, F.coalesce("__id", c)).drop("__id")
    return rows


def file_history(commits: DataFrame, now: Column, days: int = 30, patch_chars: int = 2000) -> DataFrame:
    """``path``, last commit, its time and author, commits of the last days, ``churn`` (a tenth of those, at most 1), lines changed and patch of the last.

    ``commits(path, commit, committed_at, author, added, removed, patch)``, from any version control's log.
    """
    recent = F.count_if(F.col("committed_at") >= now - F.make_dt_interval(F.lit(days)))
    newest = lambda c: F.max_by(c, F.struct("committed_at", "commit"))
    out = commits.groupBy("path").agg(newest("commit").alias("last_commit"), F.max("committed_at").alias("last_modified"), newest("author").alias("last_author"), recent.alias("commits_recent"), newest("added").alias("lines_added"), newest("removed").alias("lines_removed"), F.substring(newest("patch"), 1, patch_chars).alias("patch"))
    return out.withColumn("churn", F.least(F.lit(1.0), F.col("commits_recent") / 10))
