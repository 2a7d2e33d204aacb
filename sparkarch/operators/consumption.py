"""Who uses what: consumption per artifact, shared artifacts, activity, exposure and risk per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHANNELS

# Fixed values.
RISK = {
    ("live", "high"): 0.15, ("live", "medium"): 0.30, ("live", "low"): 0.45,
    ("live_callback", "high"): 0.25, ("live_callback", "medium"): 0.40, ("live_callback", "low"): 0.55,
    ("unused_internal_candidate", "high"): 0.50, ("unused_internal_candidate", "medium"): 0.60, ("unused_internal_candidate", "low"): 0.70,
    ("unused_public_api", "high"): 0.70, ("unused_public_api", "medium"): 0.80, ("unused_public_api", "low"): 0.85,
}
DEFAULT_RISK, EXPOSED_RISK = 0.50, 0.35


def consumption(usage: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``definer``, ``symbol``, ``consumers`` (sorted), ``consumer_count``, ``channels`` (consumer to its sorted channels).

    With ``symbols(definer, symbol)`` every defined symbol has a row. Two levels of grouping: a consumer's channels first.
    """
    per = usage.groupBy("definer", "symbol", "consumer").agg(F.array_sort(F.collect_set("channel")).alias("c"))
    out = per.groupBy("definer", "symbol").agg(F.array_sort(F.collect_list(F.struct("consumer", "c"))).alias("x"))
    if symbols is not None:
        out = symbols.select("definer", "symbol").distinct().join(out, ["definer", "symbol"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<consumer: string, c: array<string>>>")))
    return out.select("definer", "symbol", F.transform("x", lambda e: e["consumer"]).alias("consumers"), F.size("x").cast("long").alias("consumer_count"), F.map_from_entries("x").alias("channels"))


def artifact_index(usage: DataFrame, keep_self: bool = True) -> DataFrame:
    """``definer``, ``symbol``, ``consumer``: artifacts that someone besides the definer uses.

    The definer's own use is kept beside an external one, unless ``keep_self`` is false, and never alone.
    """
    pairs = usage.select("definer", "symbol", "consumer").distinct()
    outside = pairs.filter("consumer <> definer")
    return pairs.join(outside.select("definer", "symbol").distinct(), ["definer", "symbol"], "left_semi").select("definer", "symbol", "consumer") if keep_self else outside


def consumer_counts(usage: DataFrame) -> DataFrame:
    """``definer``, ``symbol``, distinct external consumers in all and per channel."""
    other = usage.filter("consumer <> definer")
    return other.groupBy("definer", "symbol").agg(F.count_distinct("consumer").alias("consumer_count"), *[F.count_distinct(F.when(F.col("channel") == c, F.col("consumer"))).alias(c) for c in CHANNELS])


def shared_artifacts(usage: DataFrame, least: int = 2) -> DataFrame:
    """``definer``, ``symbol``, ``consumer_count`` of artifacts with at least so many external consumers; most consumers first."""
    counted = usage.filter("consumer <> definer").groupBy("definer", "symbol").agg(F.count_distinct("consumer").alias("consumer_count"))
    return counted.filter(F.col("consumer_count") >= least).orderBy(F.desc("consumer_count"), "definer", "symbol")


def consumer_summary(symbols: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: symbols, used symbols, dead symbols, uses."""
    used = usage.filter("consumer <> definer").groupBy("definer", "symbol").agg(F.count("*").alias("uses"))
    both = symbols.select("definer", "symbol").distinct().join(used, ["definer", "symbol"], "left")
    return both.agg(F.count("*").alias("symbols"), F.count("uses").alias("used"), F.count_if(F.col("uses").isNull()).alias("dead"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"))


def is_public(symbol: Column) -> Column:
    """The last segment doesn't begin with an underscore."""
    return ~F.element_at(F.split(symbol, r"\."), -1).startswith("_")


def is_public_artifact(symbol: Column) -> Column:
    """Public, or a name with two underscores on both sides."""
    return is_public(symbol) | F.element_at(F.split(symbol, r"\."), -1).rlike("^__.*__$")


def public_api(symbols: DataFrame) -> DataFrame:
    """``definer`` with sorted distinct public names per kind."""
    found = symbols.filter(is_public(F.col("symbol")))
    return found.groupBy("definer").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("symbol")))).alias(n) for k, n in (("class", "classes"), ("function", "functions"), ("method", "methods"), ("global", "globals"))])


def single_kind(kinds: Column) -> Column:
    """The only category of a name, else ``ambiguous``."""
    return F.when(F.size(kinds) == 1, kinds[0]).otherwise("ambiguous")


def first_kind(kinds: Column) -> Column:
    """The first of class, function, method, global that is among the categories, else ``unknown``."""
    out = F.lit("unknown")
    for k in ("global", "method", "function", "class"):
        out = F.when(F.array_contains(kinds, k), k).otherwise(out)
    return out


def activity(evidence: DataFrame) -> DataFrame:
    """``evidence`` (symbol, is_public and the flags called, events, imports, inheritance, local_calls) with ``status`` and ``confidence``."""
    leaf = F.element_at(F.split("symbol", r"\."), -1)
    flags = [F.col(c) for c in ("called", "events", "imports", "inheritance", "local_calls")]
    runtime = F.col("called") | F.col("imports") | F.col("inheritance") | F.col("local_calls")
    status = F.when(leaf.startswith("__") & leaf.endswith("__"), "live_framework").when(runtime, "live").when(F.col("events"), "live_callback").when(F.col("is_public"), "unused_public_api").otherwise("unused_internal_candidate")
    count = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    confidence = F.when(count >= 2, "high").when(count == 1, "medium").otherwise("low")
    return evidence.withColumn("status", status).withColumn("confidence", confidence)


def activity_summary(found: DataFrame) -> DataFrame:
    """One row: symbols in all and by status."""
    names = (("live", "live"), ("live_callback", "live_callback"), ("unused_public_api", "unused_public_api"), ("unused_internal_candidate", "unused_internal_candidates"))
    return found.agg(F.count("*").alias("total_symbols"), *[F.count_if(F.col("status") == s).alias(n) for s, n in names])


def symbol_risk(found: DataFrame, exposed: str | None = None) -> DataFrame:
    """``found`` (status, confidence) with ``risk``: 0.5 for other pairs, at most 0.35 where the column ``exposed`` holds."""
    key = F.concat_ws("/", "status", "confidence")
    risk = F.coalesce(F.create_map(*[F.lit(x) for (s, c), r in RISK.items() for x in (f"{s}/{c}", r)])[key], F.lit(DEFAULT_RISK))
    if exposed:
        risk = F.when(F.col(exposed), F.least(risk, F.lit(EXPOSED_RISK))).otherwise(risk)
    return found.withColumn("risk", risk)


def module_symbol_risk(risks: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """``module_id``, ``risk``: mean of its symbols', 2 digits, halves up; 0.5 for a module without any.

    Risks are whole hundredths, so sums and halves are exact.
    """
    per = risks.groupBy("module_id").agg(F.sum(F.round(F.col("risk") * 100).cast("long")).alias("s"), F.count("risk").alias("n")).filter("n > 0")
    out = per.select("module_id", (F.expr("(2 * s + n) div (2 * n)") / 100).alias("risk"))
    if modules is not None:
        out = modules.select("module_id").distinct().join(out, "module_id", "left").withColumn("risk", F.coalesce("risk", F.lit(DEFAULT_RISK)))
    return out


def unused_public(symbols: DataFrame, used: DataFrame, exported: DataFrame, referenced: DataFrame) -> DataFrame:
    """Public ``symbols(module_id, symbol)`` that are neither used, nor exported, nor referenced by events or imports."""
    out = symbols.filter(is_public(F.col("symbol"))).select("module_id", "symbol").distinct()
    for other in (used, exported, referenced):
        out = out.join(other.select("module_id", "symbol").distinct(), ["module_id", "symbol"], "left_anti")
    return out


def ecosystem(symbols: DataFrame) -> DataFrame:
    """``symbol``, ``modules`` that define it, sorted."""
    return symbols.groupBy("symbol").agg(F.array_sort(F.collect_set("module_id")).alias("modules"))


def used_elsewhere(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``module_id``, ``symbol``, ``consumer``: symbols that another module uses by their bare name."""
    return symbols.select("module_id", "symbol").distinct().join(calls.select(F.col("module_id").alias("consumer"), F.col("name").alias("symbol")).distinct(), "symbol").filter("consumer <> module_id").select("module_id", "symbol", "consumer")


def blast_radius(usage: DataFrame, edges: DataFrame, members: DataFrame, definer: str, symbol: str, max_depth: int = 6) -> DataFrame:
    """One row: external consumers of an artifact by where they are, and modules downstream of them.

    ``members(module_id, layer, is_test)``; consumers and dependents that it doesn't hold are unknown.
    """
    from .graphs import reach

    own = members.filter(F.col("module_id") == definer).select(F.col("layer").alias("own_layer"))
    used = usage.filter((F.col("definer") == definer) & (F.col("symbol") == symbol)).select(F.col("consumer").alias("module_id")).distinct()
    placed = used.join(members, "module_id", "left").join(F.broadcast(own), F.lit(True), "left")  # one row
    where = F.when(F.col("module_id") == definer, "same_module").when(F.col("layer").isNull(), "unknown").when(F.col("is_test"), "test").when(F.col("layer") == F.col("own_layer"), "same_layer").otherwise("cross_layer")
    direct = placed.select(where.alias("w")).agg(*[F.count_if(F.col("w") == w).alias(w) for w in ("same_module", "same_layer", "cross_layer", "test", "unknown")])
    seeds = used.select(F.col("module_id").alias("id")).unionByName(members.filter(F.col("module_id") == definer).select(F.col("module_id").alias("id")))
    below = reach(edges, seeds, max_depth).select("id").distinct().join(members, F.col("id") == F.col("module_id"), "left")
    down = below.agg(F.count_if(F.col("is_test") == F.lit(False)).alias("downstream_production"), F.count_if("is_test").alias("downstream_test"), F.count_if(F.col("is_test").isNull()).alias("downstream_unknown"))
    return direct.crossJoin(down)
