"""Hotspots: normalised degrees, their mean and class; thresholds, risk, inspection targets and debt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .degrees import degrees, hard, nodes_of
from .ranking import percentile_rank

# Fixed values.
HUB, HOTSPOT, OUTBOUND, LOW = 0.90, 0.85, 0.90, 0.35
CRITICAL = 0.85
RISK_WEIGHTS = (0.5, 0.3, 0.2)
DEBT_WEIGHTS = {"cycle": 2.0, "soft": 0.5, "collision": 1.5}
DEBT_LABELS = ((0.05, "low"), (0.15, "moderate"), (0.30, "high"))


def thresholds(nodes: int) -> dict[str, float]:
    """Limits that depend on the number of nodes, besides the fixed ones."""
    for most, cluster, refactor in ((30, 8, 10), (80, 15, 18), (200, 25, 30)):
        if nodes <= most:
            break
    else:
        cluster, refactor = 40, 50
    return {"hub": HUB, "hotspot": HOTSPOT, "outbound": OUTBOUND, "low": LOW, "inspection": 0.50, "hotspot_score": 0.70, "critical": CRITICAL, "cluster_size": cluster, "refactor_cluster_size": refactor}


def hotspots(edges: DataFrame) -> DataFrame:
    """``module``, ``type``, ``score``, percentiles and degrees of hard edges; nodes of type NORMAL are left out.

    The score is the mean of the in-degree's percentile, the out-degree's percentile, the logarithm of the total degree and the
    geometric mean of both degrees, each over its maximum. Nodes that are only targets have an out-degree percentile of 0, since
    that ranks only nodes with out-edges. Nodes without any neighbour are ISOLATED with score 0.
    """
    node = cut(degrees(hard(edges), nodes_of(edges)))  # read many times below, the edges once
    impact = percentile_rank(node, "in_degree", "id", "impact_percentile")
    sources = percentile_rank(node.filter("out_degree > 0"), "out_degree", "id", "complexity_percentile")
    every = impact.join(sources.select("id", "complexity_percentile"), "id", "left").withColumn("complexity_percentile", F.coalesce("complexity_percentile", F.lit(0.0)))
    total = F.col("in_degree") + F.col("out_degree")
    most = every.agg(F.max(total).alias("__t"), F.max(F.sqrt((F.col("in_degree") * F.col("out_degree")).cast("double"))).alias("__g"))
    every = every.crossJoin(F.broadcast(most))  # one row
    size = F.when(F.col("__t") > 0, F.round(F.log1p(total) / F.log1p("__t"), 4)).otherwise(0.0)
    both = F.when(F.col("__g") > 0, F.round(F.sqrt((F.col("in_degree") * F.col("out_degree")).cast("double")) / F.col("__g"), 4)).otherwise(0.0)
    every = every.withColumn("size_score", size).withColumn("bridge_score", both)
    i, c = F.col("impact_percentile"), F.col("complexity_percentile")
    kind = (
        F.when(total == 0, "ISOLATED")
        .when((i >= HUB) & (c <= LOW), F.when(F.col("id").endswith("settings") | F.col("id").endswith("config"), "CONFIG_HUB").otherwise("HUB"))
        .when((i >= HOTSPOT) & (c >= HOTSPOT), "HOTSPOT")
        .when(c >= OUTBOUND, "OUTBOUND_HOTSPOT")
        .otherwise("NORMAL")
    )
    score = F.when(kind == "ISOLATED", 0.0).otherwise(F.round((i + c + F.col("size_score") + F.col("bridge_score")) / 4, 4))
    zero = lambda x: F.when(F.col("type") == "ISOLATED", 0.0).otherwise(F.col(x)).alias(x)
    found = every.withColumn("type", kind).withColumn("score", score).filter("type <> 'NORMAL'")
    return found.select(F.col("id").alias("module"), "type", "score", zero("impact_percentile"), zero("complexity_percentile"), "in_degree", "out_degree")


def ordered(found: DataFrame, n: int | None = None) -> DataFrame:
    out = found.orderBy(F.desc("score"), "module")
    return out if n is None else out.limit(n)


def split_active(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Isolated and active hotspots."""
    return found.filter("type = 'ISOLATED'"), found.filter("type <> 'ISOLATED'")


def module_risk(edges: DataFrame) -> DataFrame:
    """``module``, ``risk``: weighted degrees over their maxima, a quarter of it below ``config.``."""
    soft = edges.filter("edge_type = 'soft'").select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("soft"))
    node = cut(degrees(hard(edges), nodes_of(edges)).join(soft, "id", "left").withColumn("soft", F.coalesce("soft", F.lit(0))))
    most = node.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"__{c}") for c in ("in_degree", "out_degree", "soft")])
    share = lambda c: F.col(c) / F.col(f"__{c}")
    a, b, d = RISK_WEIGHTS
    risk = share("in_degree") * a + share("out_degree") * b + F.least(share("soft"), F.lit(1.0)) * d
    factor = F.when(F.col("id").startswith("config."), 0.25).otherwise(1.0)
    return node.crossJoin(F.broadcast(most)).select(F.col("id").alias("module"), (F.floor(risk * factor * 10000 + 0.5) / 10000).alias("risk"))


def risk_summary(risks: DataFrame, critical: float = CRITICAL) -> DataFrame:
    """One row: number of critical modules, mean and largest risk (0 without modules). The list itself is a filter on risk."""
    return risks.agg(F.count_if(F.col("risk") >= critical).alias("critical"), F.coalesce(F.round(F.avg("risk"), 4), F.lit(0.0)).alias("average"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("max"))


#: Signal of a hotspot's class. Fixed values.
CLASS_SIGNAL = {"CONFIG_HUB": "shared_configuration_dependency", "HOTSPOT": "high_coupling", "OUTBOUND_HOTSPOT": "high_out_degree", "HUB": "high_dependency_centrality"}


def inspection_targets(found: DataFrame, n: int = 10) -> DataFrame:
    """``module``, ``priority`` (place among the first ``n`` hotspots), ``signals`` (sorted); those without a signal are left out."""
    top = ordered(found, n)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "module"))  # n rows
    of_class = F.create_map(*[F.lit(x) for kv in CLASS_SIGNAL.items() for x in kv])[F.col("type")]
    o, i = F.col("out_degree"), F.col("in_degree")
    seen = F.array_compact(F.array(of_class, F.when(o >= 10, "high_out_degree"), F.when(i >= 10, "high_in_degree"), F.when(i >= 20, "many_dependents")))
    return top.select("module", place.alias("priority"), F.array_sort(F.array_distinct(seen)).alias("signals")).filter(F.size("signals") > 0)


def refactor_plan(found: DataFrame, risks: DataFrame, clusters: DataFrame, nodes: int, n: int = 10) -> DataFrame:
    """``type``, ``targets``, ``priority``, ``reason``: the top hotspots by class, and clusters (column ``modules``) too large for
    the graph but under 60 % of it."""
    limit = thresholds(nodes)
    top = ordered(found, n).join(risks, "module", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    kind = F.col("type")
    action = F.when(kind == "CONFIG_HUB", "KEEP_AS_SHARED_CONFIG").when(kind == "HUB", "EXTRACT_INTERFACE").when(kind.isin("HOTSPOT", "OUTBOUND_HOTSPOT"), "SPLIT_MODULE")
    priority = F.when(kind == "CONFIG_HUB", "INFO").when(F.col("score") + F.col("risk") >= limit["critical"], "HIGH").otherwise("MEDIUM")
    reason = F.create_map(*[F.lit(x) for kv in {"CONFIG_HUB": "central configuration module", "HOTSPOT": "high coupling detected", "HUB": "high dependency centrality", "OUTBOUND_HOTSPOT": "too many outgoing dependencies"}.items() for x in kv])
    plan = top.select(action.alias("type"), F.array("module").alias("targets"), priority.alias("priority"), reason[kind].alias("reason")).filter("type is not null")
    size = F.size("modules")
    large = clusters.filter((size >= limit["refactor_cluster_size"]) & (size < nodes * 0.6))
    return plan.unionByName(large.select(F.lit("SPLIT_PACKAGE").alias("type"), F.col("modules").alias("targets"), F.lit("MEDIUM").alias("priority"), F.lit("large isolated dependency cluster detected").alias("reason")))


def debt(cycles: DataFrame, edges: DataFrame, found: DataFrame, clusters: DataFrame, collisions: DataFrame, nodes: int) -> DataFrame:
    """One row: the score, its parts, the score over all edges, and its label.

    cycles: array ``nodes``, the closing node repeated and counted, or their number ``entries``; clusters: array ``modules``; collisions: ``is_identical``.
    A cluster counts from the graph's size limit and without a CONFIG_HUB in it.
    """
    limit = thresholds(nodes)
    config = found.filter("type = 'CONFIG_HUB'").select(F.col("module").alias("m"))
    large = clusters.filter(F.size("modules") >= limit["cluster_size"]).withColumn("k", F.monotonically_increasing_id())
    spared = large.select("k", F.explode("modules").alias("m")).join(config, "m", "left_semi").select("k").distinct()
    one = (
        cycles.agg(F.coalesce(F.sum("entries" if "entries" in cycles.columns else F.size("nodes")), F.lit(0)).alias("cycle_penalty"))
        .crossJoin(edges.agg(F.count_if(F.col("edge_type") == "soft").alias("soft_edges_count"), F.count("*").alias("edges_total")))
        .crossJoin(large.join(spared, "k", "left_anti").agg(F.count("*").alias("cluster_penalty")))
        .crossJoin(found.agg(F.count_if(F.col("score") >= limit["critical"]).alias("hotspot_penalty")))
        .crossJoin(collisions.agg(F.count_if(~F.col("is_identical")).alias("collision_count")))
    )  # one row each
    c = F.col
    score = c("cycle_penalty") * DEBT_WEIGHTS["cycle"] + c("soft_edges_count") * DEBT_WEIGHTS["soft"] + c("cluster_penalty") + c("hotspot_penalty") + c("collision_count") * DEBT_WEIGHTS["collision"]
    one = one.withColumn("score", F.round(score, 4)).withColumn("normalized", F.round(score / F.greatest("edges_total", F.lit(1)), 4))
    label = F.lit("critical")
    for most, name in reversed(DEBT_LABELS):
        label = F.when(c("normalized") < most, name).otherwise(label)
    return one.withColumn("label", label)


def status(cycles: Column, collisions: Column, active_hotspots: Column) -> Column:
    """CRITICAL with cycles and real collisions, BROKEN with either, WARNING with hubs or hotspots, else HEALTHY."""
    return F.when((cycles > 0) & (collisions > 0), "CRITICAL").when((cycles > 0) | (collisions > 0), "BROKEN").when(active_hotspots > 0, "WARNING").otherwise("HEALTHY")


def architecture_signals(edges: DataFrame, cycles: DataFrame, found: DataFrame) -> DataFrame:
    """``module``, ``signals`` (sorted): what stands out about each module of the graph; cycles: array ``nodes``, or ``id`` of their nodes."""
    node = degrees(hard(edges), nodes_of(edges))
    typed = edges.filter("edge_type = 'soft'")
    marks = [
        node.filter("in_degree > 0").select("id", F.lit("has_dependents").alias("s")),
        node.filter("out_degree > 0").select("id", F.lit("has_dependencies").alias("s")),
        (cycles.select("id") if "id" in cycles.columns else cycles.select(F.explode("nodes").alias("id")).distinct()).select("id", F.lit("cycle_member").alias("s")),  # a node is on many
        typed.select(F.col("src").alias("id"), F.lit("contains_soft_dependencies").alias("s")),
        typed.select(F.col("dst").alias("id"), F.lit("has_soft_dependents").alias("s")),
        found.filter("type in ('HOTSPOT', 'OUTBOUND_HOTSPOT', 'HUB', 'CONFIG_HUB')").select(F.col("module").alias("id"), F.lit("hotspot").alias("s")),
        found.filter("type = 'CONFIG_HUB'").select(F.col("module").alias("id"), F.lit("config_hub").alias("s")),
    ]
    every = node.select("id", F.lit(None).cast("string").alias("s"))
    for m in marks:
        every = every.unionByName(m)
    return every.groupBy(F.col("id").alias("module")).agg(F.array_sort(F.collect_set("s")).alias("signals"))
