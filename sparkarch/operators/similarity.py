"""Similarity of owners by the items they share, and clusters of it. Input: ``items(owner, item)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components, cut

MIN_JACCARD, MAX_CLUSTER, MIN_CLUSTER, SHOWN_ITEMS = 0.30, 25, 2, 20


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_pairs(items: DataFrame, least: float = MIN_JACCARD) -> DataFrame:
    """``a``, ``b`` (a < b), ``jaccard`` of owners that are at least so similar.

    Owners meet in the lists of their rarest items only: two sets of similarity ``least`` share an item among the first
    n - ceil(least * n) + 1 of each, in any common order. So items that most owners have join nobody. Candidates are checked for
    size, then on their whole sets.
    """
    if least <= 0:
        raise ValueError("least must be above 0: owners that share nothing are not paired")
    sets = cut(items.select("owner", "item").filter("owner is not null and item is not null").distinct())
    # numbers stand for the items: sets of numbers are intersected far faster than sets of texts
    held = cut(sets.groupBy("item").agg(F.count("*").alias("df")).withColumn("id", F.monotonically_increasing_id()))
    ranked = cut(sets.join(held, "item").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("df", "id"))).alias("x")).select("owner", F.transform("x", lambda e: e["id"]).alias("s")))
    n = F.size("s")
    first = ranked.select("owner", n.alias("n"), F.explode(F.slice("s", 1, n - F.ceil(F.round(n * least, 9)).cast("int") + 1)).alias("item"))
    left, right = first.select("item", F.col("owner").alias("a"), F.col("n").alias("na")), first.select("item", F.col("owner").alias("b"), F.col("n").alias("nb"))
    near = left.join(right, "item").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)).select("a", "b", "na", "nb").distinct()
    both = near.join(ranked.select(F.col("owner").alias("a"), F.col("s").alias("sa")), "a").join(ranked.select(F.col("owner").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    shared = F.col("shared")
    return both.select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("jaccard")).filter(F.col("jaccard") >= least)


def clusters(items: DataFrame, least: float = MIN_JACCARD, min_size: int = MIN_CLUSTER, max_size: int = MAX_CLUSTER, most_pairs: int = 20_000_000) -> DataFrame:
    """Clusters whose members are all similar to each other: ``modules`` (sorted), ``size``, ``shared_artifact_count``,
    ``shared_artifact_keys`` (the first 20), ``jaccard_similarity`` (mean over pairs), ``shared_ratio``; 4 digits.

    Owners of equal sets are one class: pairs are found between classes, and a copy is similar to what its class is, and to its class.
    Owners in alphabetical order each open a cluster and take in, in that order, every later free owner that is similar to all
    its members. Of a cluster that is too large the members with most similar owners stay; the others stay out for good. Owners
    without a similar one are left out. Pairs and components are found by joins; then each component is clustered by itself,
    which gives the same result, since a member is similar to all others. The order within a component is global, so a component is
    one task's work; one of more than ``most_pairs`` similar pairs raises an error (a higher ``least`` splits it).
    """
    held = items.select("owner", "item").filter("owner is not null and item is not null").distinct()
    each = cut(held.groupBy("owner").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("item"))), 256).alias("h")))
    reps = each.groupBy("h").agg(F.min("owner").alias("rep"), F.count("*").alias("copies"))
    members = cut(each.join(reps, "h").select("owner", "rep", "copies"))
    pairs = cut(jaccard_pairs(held.join(members.select(F.col("rep").alias("owner")).distinct(), "owner", "left_semi"), least))
    where = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    linked = pairs.join(where.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b", "jaccard")
    inside = members.join(where.select(F.col("id").alias("rep"), "component"), "rep", "left").filter("component is not null or copies > 1")
    placed = cut(linked.unionByName(inside.select(F.coalesce("component", "rep").alias("component"), F.col("rep").alias("a"), F.col("owner").alias("b"), F.lit(None).cast("double").alias("jaccard"))))
    largest = placed.filter("jaccard is not null").groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most_pairs:
        raise ValueError(f"a component of {largest} similar pairs; raise least")

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, dict[str, float]] = {}
        of, owners = {}, {}
        for a, b, j in zip(frame["a"], frame["b"], frame["jaccard"], strict=True):
            if j != j:  # a member of a class
                of[b] = a
                owners.setdefault(a, []).append(b)
                near.setdefault(a, {})[a] = 1.0
            else:
                near.setdefault(a, {})[b] = j
                near.setdefault(b, {})[a] = j
        links = {c: sum(len(owners[x]) for x in others) - 1 for c, others in near.items()}
        rows, taken = [], set()
        free = {c: sorted(x) for c, x in owners.items()}
        for seed in sorted(of):
            if seed in taken:
                continue
            group, fit = [seed], near[of[seed]].keys()
            # only what is similar to the seed can join; a class that is similar to all so far stays so for its copies
            for other in sorted(x for c in fit for x in free[c] if x > seed):
                if of[other] in fit:
                    group.append(other)
                    fit = fit & near[of[other]].keys()
            taken.update(group)
            for c in {of[g] for g in group}:
                free[c] = [x for x in free[c] if x not in taken]
            if len(group) < min_size:
                continue
            if len(group) > max_size:
                group = sorted(sorted(group, key=lambda g: (-links[of[g]], g))[:max_size])
            values = [near[of[a]][of[b]] for i, a in enumerate(group) for b in group[i + 1 :]]
            rows.append((group, sum(values) / len(values)))
        return pd.DataFrame({"modules": pd.Series([r[0] for r in rows], dtype=object), "mean": pd.Series([r[1] for r in rows], dtype=float)})

    found = cut(placed.groupBy("component").applyInPandas(greedy, "modules array<string>, mean double"))
    sets = items.select(F.col("owner").alias("m"), "item").distinct()
    uses = found.select("modules", F.explode("modules").alias("m")).join(sets, "m").groupBy("modules", "item").agg(F.count("*").alias("k"))
    per = uses.groupBy("modules").agg(F.count_if(F.col("k") == F.size("modules")).alias("shared"), F.count("*").alias("every"), F.slice(F.array_sort(F.collect_set(F.when(F.col("k") == F.size("modules"), F.col("item")))), 1, SHOWN_ITEMS).alias("keys"))
    out = found.join(per, "modules")
    return out.select("modules", F.size("modules").alias("size"), F.col("shared").alias("shared_artifact_count"), F.col("keys").alias("shared_artifact_keys"), F.round("mean", 4).alias("jaccard_similarity"), F.round(F.col("shared") / F.col("every"), 4).alias("shared_ratio")).orderBy(F.desc("shared_artifact_count"), F.desc("size"), "modules")


def shared_usage_components(usage: DataFrame, least: int = 2, most: int = 30, min_size: int = 2) -> DataFrame:
    """Consumers linked by any artifact that at least ``least`` of them use: ``modules``, ``size``, ``shared_artifacts``.

    Consumers of an artifact are linked to the least of them, not to each other: the components are the same.
    """
    pairs = usage.filter("consumer <> definer").select("definer", "symbol", "consumer").distinct()
    shared = pairs.groupBy("definer", "symbol").agg(F.count("*").alias("k"), F.min("consumer").alias("head")).filter(F.col("k") >= least)
    links = pairs.join(shared.select("definer", "symbol", "head"), ["definer", "symbol"])
    where = cut(components(links.select(F.col("consumer").alias("src"), F.col("head").alias("dst"))))
    sizes = where.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("modules"))
    inside = shared.join(where.select(F.col("id").alias("head"), "component"), "head").groupBy("component").agg(F.count("*").alias("shared_artifacts"))
    out = sizes.join(inside, "component").withColumn("size", F.size("modules")).filter(F.col("size") >= min_size)
    return out.select("modules", "size", "shared_artifacts").orderBy(F.desc("shared_artifacts"), F.desc("size"), "modules").limit(most)


def dominant_definers(usage: DataFrame, where: DataFrame) -> DataFrame:
    """``component``, ``definer``, ``artifacts`` shared in it, most first; ``where(id, component)``."""
    pairs = usage.filter("consumer <> definer").select("definer", "symbol", F.col("consumer").alias("id")).distinct()
    return pairs.join(where, "id").select("component", "definer", "symbol").distinct().groupBy("component", "definer").agg(F.count("*").alias("artifacts")).orderBy("component", F.desc("artifacts"), "definer")


def extraction_candidates(usage: DataFrame, where: DataFrame, n: int = 10) -> DataFrame:
    """``component``, ``definer``, ``symbol``, ``consumers``: the most used artifacts of each component, at most ``n``."""
    from pyspark.sql import Window

    pairs = usage.filter("consumer <> definer").select("definer", "symbol", F.col("consumer").alias("id")).distinct()
    counted = pairs.join(where, "id").groupBy("component", "definer", "symbol").agg(F.count("*").alias("consumers")).filter("consumers > 1")
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("consumers"), "definer", "symbol"))
    return counted.withColumn("r", place).filter(F.col("r") <= n).drop("r")
