"""Checks of tables that others rely on: shapes of consumption, counts that must agree, freshness, orders of builders, excludes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .consumption import CHANNELS
from .diffs import unsorted
from .graphs import reach


def consumption_problems(rows: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """``definer``, ``symbol``, ``problem`` of ``rows(definer, symbol, consumers, channels)`` that break the contract; none if all hold.

    Names aren't empty; consumers, and the channels of each, are sorted and listed once; only consumers have channels, and only known ones.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    held = F.map_values("channels")
    tests = [
        ("name", empty("definer") | empty("symbol")),
        ("consumers", F.col("consumers").isNull() | F.coalesce(unsorted(F.col("consumers")), F.lit(False)) | F.exists(F.coalesce("consumers", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) == "")),
        ("channel of no consumer", F.size(F.array_except(F.map_keys("channels"), F.coalesce("consumers", F.array().cast("array<string>")))) > 0),
        ("channels", F.exists(held, lambda x: F.array_sort(F.array_distinct(x)) != x)),
        ("unknown channel", F.exists(F.flatten(held), lambda c: ~F.coalesce(c.isin(*channels), F.lit(False)))),
    ]
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    return rows.select("definer", "symbol", F.explode(found).alias("problem"))


def sanity(counts: DataFrame) -> DataFrame:
    """Those of ``counts(name, one, other)`` that both sides have and that differ."""
    return counts.filter("one <> other").select("name", "one", "other")


def freshness(states: DataFrame, needs: DataFrame, resync: bool = False) -> DataFrame:
    """``family``, ``state``, ``is_fresh``: a family is fresh if its state says so and so are all it needs, however far; none is during a resync.

    ``states(family, state)``, ``needs(family, needed)``; a needed family without a state is not fresh.
    """
    edges = needs.select(F.col("family").alias("src"), F.col("needed").alias("dst"))
    known = states.select("family", "state")
    bad = known.filter("not state <=> 'fresh'").select(F.col("family").alias("id")).unionByName(needs.select(F.col("needed").alias("family")).join(known, "family", "left_anti").select(F.col("family").alias("id"))).distinct()
    stale = reach(edges, bad, include_seeds=True).select(F.col("id").alias("family")).distinct().withColumn("__stale", F.lit(True))
    return known.join(stale, "family", "left").select("family", "state", (F.col("__stale").isNull() & F.lit(not resync)).alias("is_fresh"))


def build_order(builders: DataFrame) -> DataFrame:
    """``name``, ``step`` of ``builders(name, requires, provides)``: each runs after all that provide what it requires.

    Something provided twice, required and never provided, or a ring, is an error. A step takes all builders whose needs are met.
    """
    given = cut(builders.select("name", F.explode("provides").alias("key")).distinct())
    twice = given.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").orderBy("key").first()
    if twice:
        raise ValueError(f"{twice['key']} is provided twice")
    wanted = cut(builders.select("name", F.explode("requires").alias("key")).distinct())
    lost = wanted.join(given.select("key"), "key", "left_anti").orderBy("key", "name").first()
    if lost:
        raise ValueError(f"{lost['name']} requires {lost['key']}, which nothing provides")
    left = cut(wanted.join(given.select("key", F.col("name").alias("after")), "key").select("name", "after").distinct())
    todo, done, step = cut(builders.select("name").distinct()), None, 0
    while not todo.isEmpty():
        ready = cut(todo.join(left.select("name"), "name", "left_anti").withColumn("step", F.lit(step)))
        if ready.isEmpty():
            raise ValueError("builders require each other in a ring")
        done = ready if done is None else done.unionByName(ready)
        todo = cut(todo.join(ready, "name", "left_anti"))
        left = cut(left.join(ready.select(F.col("name").alias("after")), "after", "left_anti").select("name", "after"))
        step += 1
    return builders.select("name").withColumn("step", F.lit(0)).limit(0) if done is None else done


def export_summary(exports: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """``module_id``, numbers of exported names and of the classes, functions and constants among them, and whether there are any."""
    kinds = symbols.select("module_id", F.col("symbol").alias("name"), "kind").distinct()
    both = exports.select("module_id", "name").distinct().join(kinds, ["module_id", "name"], "left")
    k = lambda x: F.count_distinct(F.when(F.col("kind") == x, F.col("name")))
    per = both.groupBy("module_id").agg(F.count_distinct("name").alias("symbol_count"), k("function").alias("function_count"), k("class").alias("class_count"), k("global").alias("constant_count"))
    counts = ("symbol_count", "function_count", "class_count", "constant_count")
    out = modules.select("module_id").distinct().join(per, "module_id", "left").select("module_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.withColumn("public_api", F.col("symbol_count") > 0)


def stale_excludes(items: DataFrame, files: DataFrame) -> DataFrame:
    """``original`` paths of moved-away ``items(original)`` that are back among ``files(path)``, as a file or as a folder of some."""
    from .prefixes import prefixes

    there = files.select(F.explode(prefixes(F.col("path"), "/")).alias("original")).distinct()
    return items.select("original").distinct().join(there, "original", "left_semi")


def expired(entries: DataFrame, owners: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """``path``, ``reason`` of ``entries(path, owner, used_at)`` to drop: an orphan if none of ``owners(owner)`` has it, else old if unused for so many days."""
    known = owners.select("owner").distinct().withColumn("__known", F.lit(True))
    old = F.col("used_at") < now - F.make_dt_interval(F.lit(days))
    reason = F.when(F.col("__known").isNull(), "orphan").when(old, "old")
    return entries.join(known, "owner", "left").select("path", reason.alias("reason")).filter("reason is not null")
