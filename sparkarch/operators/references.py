"""References by name: matching of used names to symbols, users of imports, and names that several symbols share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefixes import prefixes

#: Names of methods that are too common to guess by. Fixed values.
COMMON_METHODS = (
    "visit", "get", "add", "update", "append", "extend", "insert", "pop", "remove", "clear", "copy", "items", "keys", "values",
    "visit_FunctionDef", "visit_ClassDef", "visit_AsyncFunctionDef", "visit_Call", "visit_Import", "visit_Assign", "visit_Name", "visit_Attribute",
)


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def match_names(uses: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """``uses(module_id, name)`` with ``definer``, ``symbol`` and ``match``: confirmed, ambiguous or none.

    A full name ``module.symbol`` is confirmed. A name that is, or begins with, one of the module's aliases (whole segments) is none
    of ours. A short name that one symbol in all modules has is a guess, called ambiguous; common methods and names with two
    underscores on both sides aren't guessed. ``symbols(module_id, symbol)``, ``aliases(module_id, alias)``.
    """
    known = symbols.select("module_id", "symbol").distinct()
    full = known.select(F.col("module_id").alias("definer"), "symbol", F.concat_ws(".", "module_id", "symbol").alias("name"))
    exact = uses.select("module_id", "name").distinct().join(full, "name", "left")
    heads = uses.select("module_id", "name", F.explode(prefixes(F.col("name"))).alias("alias"))
    rooted = heads.join(aliases.select("module_id", "alias"), ["module_id", "alias"], "left_semi").select("module_id", "name").distinct().withColumn("rooted", F.lit(True))
    placed = exact.withColumn("leaf", leaf(F.col("name"))).join(rooted, ["module_id", "name"], "left")
    single = known.select(F.col("module_id").alias("d"), F.col("symbol").alias("s"), leaf(F.col("symbol")).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("k"), F.min(F.struct("d", "s")).alias("only")).filter("k = 1")
    out = placed.join(single, "leaf", "left")
    guess = F.col("definer").isNull() & F.col("rooted").isNull() & F.col("only").isNotNull() & ~F.col("leaf").isin(*COMMON_METHODS) & ~(F.col("leaf").startswith("__") & F.col("leaf").endswith("__"))
    kind = F.when(F.col("definer").isNotNull(), "confirmed").when(guess, "ambiguous").otherwise("none")
    pick = lambda a, b: F.coalesce(F.col(a), F.when(guess, F.col(b)))
    return out.select("module_id", "name", pick("definer", "only.d").alias("definer"), pick("symbol", "only.s").alias("symbol"), kind.alias("match"))


def import_users(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """``target``, ``module_id``: modules that import a target by its full name, or by a name that ends with its last segment.

    Two equality joins; ``imports(module_id, module)``, ``targets(target)``.
    """
    wanted = targets.select("target", leaf(F.col("target")).alias("leaf")).distinct()
    named = imports.select("module_id", "module").filter("module is not null").distinct()
    full = named.join(wanted, named["module"] == wanted["target"]).select("target", "module_id")
    last = named.withColumn("leaf", leaf(F.col("module"))).filter(F.col("module").contains(".")).join(wanted, "leaf").select("target", "module_id")
    return full.unionByName(last).filter("target <> module_id").distinct()


def import_from_users(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """``definer``, ``symbol``, ``module_id``: from-imports of a symbol by name, or of all public ones by ``*``."""
    each = imports.filter("is_from_import").select("module_id", "module", F.explode("names").alias("symbol"))
    known = symbols.select(F.col("module_id").alias("definer"), "symbol").distinct()
    by_name = each.join(known, (each["module"] == known["definer"]) & (each["symbol"] == known["symbol"])).select("definer", known["symbol"], "module_id")
    stars = each.filter("symbol = '*'").select("module_id", F.col("module").alias("definer")).distinct()
    by_star = stars.join(known.filter(~leaf(F.col("symbol")).startswith("_") & ~F.col("symbol").contains(".")), "definer").select("definer", "symbol", "module_id")
    return by_name.unionByName(by_star).filter("definer <> module_id").distinct()


def short_names(symbols: DataFrame) -> DataFrame:
    """``leaf``, ``ids``: sorted full names of all symbols with a last segment."""
    return symbols.select(leaf(F.col("symbol")).alias("leaf"), F.concat_ws(".", "module_id", "symbol").alias("id")).groupBy("leaf").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolve_target(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """``name`` with ``definer``, ``symbol``, ``status``: ``module::symbol`` or dotted, resolved if just one fits, else ambiguous or unresolved."""
    known = symbols.select(F.col("module_id").alias("definer"), "symbol").distinct()
    names = known.select("definer", "symbol", F.explode(F.array(F.concat_ws("::", "definer", "symbol"), F.concat_ws(".", "definer", "symbol"))).alias("name"))
    per = names.join(asked.select("name").distinct(), "name").groupBy("name").agg(F.count("*").alias("k"), F.min(F.struct("definer", "symbol")).alias("t"))
    out = asked.select("name").distinct().join(per, "name", "left")
    one = F.col("k") == 1
    return out.select("name", F.when(one, F.col("t.definer")).alias("definer"), F.when(one, F.col("t.symbol")).alias("symbol"), F.when(one, "resolved").when(F.col("k") > 1, "ambiguous").otherwise("unresolved").alias("status"))


def texts_with(texts: DataFrame, needles: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Texts that hold at least one of the identifiers in ``needles(name)``: a prefilter before anything costly."""
    tokens = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name"))
    held = tokens.join(needles.select("name").distinct(), "name", "left_semi").select(key).distinct()
    return texts.join(held, key, "left_semi")


def locate(asked: DataFrame, modules: DataFrame) -> DataFrame:
    """``asked`` paths with ``module_id``: the module at that path, else at a path that ends so, else with that file name; the smallest of several."""
    from .prefixes import suffixes

    rows = asked.select("asked").distinct().withColumn("base", F.substring_index("asked", "/", -1))
    ends = modules.select("module_id", "path", F.posexplode(suffixes(F.col("path"))).alias("cut", "end"))
    whole = rows.join(ends, rows["asked"] == ends["end"]).select("asked", "module_id", F.when(F.col("cut") == 0, 0).otherwise(1).alias("rank"))
    named = modules.select("module_id", F.substring_index("path", "/", -1).alias("base"))
    by_base = rows.join(named, "base").select("asked", "module_id", F.lit(2).alias("rank"))
    best = whole.unionByName(by_base).groupBy("asked").agg(F.min(F.struct("rank", "module_id")).alias("b"))
    return asked.select("asked").distinct().join(best, "asked", "left").select("asked", F.col("b.module_id").alias("module_id"))
