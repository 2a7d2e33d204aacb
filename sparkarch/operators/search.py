"""Search: entities by substring, ranked resolution of index queries, source text by line, ranges and enclosing spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entities(rows: DataFrame, name: str, term: str) -> DataFrame:
    """Rows whose name holds the term, case aside; only those equal to it, case aside, if there are any. ``exact`` tells which."""
    low, asked = F.lower(F.col(name)), term.lower()
    found = rows.filter(low.contains(asked)).withColumn("exact", F.lower(F.col(name)) == asked)
    any_exact = found.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("__any"))  # one row
    return found.crossJoin(F.broadcast(any_exact)).filter(F.col("exact") | ~F.col("__any")).drop("__any").orderBy(F.desc("exact"), low, name)


def query_kind(query: str) -> tuple[str, str]:
    """Kind and value of an index query: an explicit ``kind:``, an id, an artifact, a file or a symbol."""
    import re

    text = query.strip()
    if not text:
        return "invalid", ""
    head, sep, rest = text.partition(":")
    if sep and head in ("module", "artifact", "file", "symbol", "id") and not rest.startswith(":"):
        value = rest.strip()
        if head == "id":
            return ("module_id" if re.fullmatch(r"\d+/\d+", value) else "artifact_id" if re.fullmatch(r"A\d+/\d+", value) else "invalid_id"), value
        return head, value
    if re.fullmatch(r"\d+/\d+", text):
        return "module_id", text
    if re.fullmatch(r"A\d+/\d+", text):
        return "artifact_id", text
    if "::" in text:
        return "artifact", text
    if "/" in text or "\\" in text or text.endswith(".py"):
        return "file", text.replace("\\", "/").removeprefix("./")
    return "symbol", text


def resolve_index(query: str, ids: DataFrame) -> DataFrame:
    """``kind``, ``obj_id``, ``name``, ``match``, ``score``, ``source`` of what a query names in ``ids(kind, obj_id, name, status, path)``.

    Exact names and paths score 100, case aside 95, a path's or a qualified symbol's end 85, a file's base name 80; a name that
    begins with the query 70 and one that holds it 60 are suggestions. Only the best score stays, matches before suggestions;
    active ids hide removed ones of the same id. One scan, one row per candidate; a dotted name that is a module's is a module.
    """
    kind, value = query_kind(query)
    low = value.lower()
    name, path = F.col("name"), F.coalesce("path", F.concat(F.translate("name", ".", "/"), F.lit(".py")))
    local = F.element_at(F.split("name", "::"), -1)
    module, artifact = F.col("kind") == "module", F.col("kind") == "artifact"

    def ranked(target: Column, *more: tuple[Column, str, int]) -> tuple[Column, Column]:
        m = F.when(target == value, "exact").when(F.lower(target) == low, "case_insensitive")
        s = F.when(target == value, 100).when(F.lower(target) == low, 95)
        for condition, label, score in more:
            m, s = m.when(condition, label), s.when(condition, score)
        return m, s

    hints = lambda t: ((F.lower(t).startswith(low), "prefix", 70), (F.lower(t).contains(low), "substring", 60))
    if kind in ("invalid", "invalid_id"):
        scope, (match, score) = F.lit(False), (F.lit(None).cast("string"), F.lit(None).cast("int"))
    elif kind in ("module_id", "artifact_id"):
        scope = (module if kind == "module_id" else artifact) & (F.col("obj_id") == value)
        match, score = F.lit("exact_id"), F.lit(100)
    elif kind == "file":
        scope = module
        end = (F.lower(path).endswith("/" + low), "path_suffix", 85) if "/" in value else (F.lower(F.substring_index(path, "/", -1)) == low, "basename", 80)
        match, score = ranked(path, end)
    elif kind == "module":
        scope, (match, score) = module, ranked(name)
    elif kind == "artifact":
        scope, (match, score) = artifact, ranked(name, *hints(name))
    else:
        suffix = ((F.lower(local).endswith("." + low), "qualified_suffix", 85),) if "." not in value else ()
        ma, sa = ranked(local, *suffix, *hints(local))
        scope = artifact | (module & (F.lower(name) == low) if "." in value else F.lit(False))
        match, score = F.when(module, F.when(name == value, "exact").otherwise("case_insensitive")).otherwise(ma), F.when(module, F.when(name == value, 110).otherwise(105)).otherwise(sa)
    found = ids.withColumn("match", match).withColumn("score", score).filter(scope & F.col("score").isNotNull())
    found = found.withColumn("source", F.when(F.col("status") == "active", "active").otherwise("recovery"))
    top = found.agg(F.max("score").alias("__top"))  # one row
    best = found.crossJoin(F.broadcast(top)).filter("score = __top").drop("__top")
    active = best.filter("source = 'active'").select("kind", "obj_id").distinct()
    shown = best.filter("source = 'active'").unionByName(best.filter("source <> 'active'").join(active, ["kind", "obj_id"], "left_anti").select(*best.columns))
    return shown.select("kind", "obj_id", "name", "match", F.least("score", F.lit(100)).alias("score"), "source").orderBy("name", "obj_id")


def lookup_ids(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """``obj_id``, ``name``, ``status`` (active, recovery, missing) for each asked id; active beats removed."""
    known = ids.groupBy("obj_id").agg(F.max(F.when(F.col("status") == "active", F.col("name"))).alias("a"), F.max(F.when(F.col("status") != "active", F.col("name"))).alias("r"))
    out = asked.select("obj_id").distinct().join(known, "obj_id", "left")
    return out.select("obj_id", F.coalesce("a", "r").alias("name"), F.when(F.col("a").isNotNull(), "active").when(F.col("r").isNotNull(), "recovery").otherwise("missing").alias("status"))


def lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key``, ``line_no`` (from 1), ``line`` of every text; null has none."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def line_range(texts: DataFrame, first: int, last: int, key: str = "path", text: str = "text") -> DataFrame:
    """Lines ``first`` to ``last``, both included; the array is cut before rows are made."""
    part = F.slice(F.split(text, "\n"), first, max(last - first + 1, 0))
    return texts.select(key, F.posexplode(part).alias("p", "line")).select(key, (F.col("p") + first).alias("line_no"), "line")


def search_source(texts: DataFrame, needle: str, case_sensitive: bool = True, key: str = "path", text: str = "text") -> DataFrame:
    """``key``, ``line_no``, ``line``, ``column`` (of the first hit, from 1), ``hits`` (without overlap) of lines that hold the needle.

    Texts without it are dropped before they are split.
    """
    if not needle:
        raise ValueError("an empty needle")
    fold = (lambda c: c) if case_sensitive else F.lower
    asked = needle if case_sensitive else needle.lower()
    held = texts.filter(fold(F.col(text)).contains(asked))
    each = lines(held, key, text).withColumn("__l", fold(F.col("line"))).filter(F.col("__l").contains(asked))
    count = (F.length("__l") - F.length(F.replace("__l", F.lit(asked), F.lit("")))) / len(asked)
    return each.select(key, "line_no", "line", F.instr("__l", asked).alias("column"), count.cast("int").alias("hits")).orderBy(key, "line_no")


def smallest_enclosing(hits: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """``hits(key, at)`` with the shortest of ``spans(key, first, last)`` that holds each, or nulls.

    An interval join by buckets of ``width`` places: a span has a row for each bucket it covers, and a hit is in one.
    """
    named = spans.withColumn("__b", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"last div {width}"))))
    asked = hits.select("key", "at").distinct().withColumn("__b", F.expr(f"at div {width}"))
    found = asked.join(named, ["key", "__b"]).filter("first <= at and at <= last").groupBy("key", "at").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("n"), "first", "last")).alias("s"))
    return hits.join(found, ["key", "at"], "left").select(*hits.columns, F.col("s.first").alias("first"), F.col("s.last").alias("last"))


def block_selection(blocks: DataFrame, module: str) -> DataFrame:
    """``blocks(artifact_id, definer, consumers)`` that a module defines or consumes, with ``roles``."""
    roles = F.array_compact(F.array(F.when(F.col("definer") == module, "defines"), F.when(F.array_contains("consumers", module), "consumes")))
    return blocks.withColumn("roles", roles).filter(F.size("roles") > 0)


def rewrite_ids(blocks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with names for ids, and ``obj_id``, ``role`` of those unknown.

    A block with an unknown artifact or definer is left out; of its consumers only unknown ones are.
    """
    names = ids.groupBy("obj_id").agg(F.coalesce(F.max(F.when(F.col("status") == "active", F.col("name"))), F.max("name")).alias("name"))
    n = lambda key: names.select(F.col("obj_id").alias(key), F.col("name").alias(f"{key}_name"))
    rows = blocks.select("artifact_id", "definer", "consumers").join(n("artifact_id"), "artifact_id", "left").join(n("definer"), "definer", "left")
    each = rows.select("artifact_id", F.explode("consumers").alias("consumer")).join(n("consumer"), "consumer", "left")
    whole = rows.filter("artifact_id_name is not null and definer_name is not null")
    used = each.filter("consumer_name is not null").groupBy("artifact_id").agg(F.array_sort(F.collect_set("consumer_name")).alias("c"))
    out = whole.join(used, "artifact_id", "left").select(F.col("artifact_id_name").alias("artifact"), F.col("definer_name").alias("definer"), F.coalesce("c", F.array().cast("array<string>")).alias("consumers"))
    lost = rows.filter("artifact_id_name is null").select(F.col("artifact_id").alias("obj_id"), F.lit("artifact").alias("role"))
    lost = lost.unionByName(rows.filter("definer_name is null").select(F.col("definer").alias("obj_id"), F.lit("definer").alias("role")))
    return out, lost.unionByName(each.filter("consumer_name is null").select(F.col("consumer").alias("obj_id"), F.lit("consumer").alias("role"))).distinct()


def tested_modules(tests: DataFrame, modules: DataFrame) -> DataFrame:
    """``test_path``, ``module_id``: tests named after a module, or that import it; ``tests(test_path, imports)``."""
    base = F.regexp_extract("test_path", r"([^/]+)\.py$", 1)
    stem = F.regexp_replace(F.regexp_replace(base, "^test_", ""), "_test$", "")
    leaf = modules.select("module_id", F.element_at(F.split("module_id", r"\."), -1).alias("stem"))
    by_name = tests.select("test_path", stem.alias("stem")).join(leaf, "stem").select("test_path", "module_id")
    by_import = tests.select("test_path", F.explode("imports").alias("module_id")).join(modules.select("module_id"), "module_id").select("test_path", "module_id")
    return by_name.unionByName(by_import).distinct()


def tested_symbols(symbols: DataFrame, names: DataFrame, has_assert: DataFrame) -> DataFrame:
    """Symbols whose name a test file mentions, if any test asserts anything."""
    real = has_assert.agg(F.coalesce(F.max("has_assert"), F.lit(False)).alias("__any"))
    return symbols.join(names.select(F.col("name").alias("symbol")).distinct(), "symbol", "left_semi").crossJoin(F.broadcast(real)).filter("__any").drop("__any")


def preview(line: Column, tokens: int = 4, width: int = 60) -> Column:
    """The first words of a line, cut to a width."""
    return F.substring(F.array_join(F.slice(F.regexp_extract_all(line, F.lit(r"(\w+|[^\w\s])"), F.lit(1)), 1, tokens), " "), 1, width)


def running_chunks(rows: DataFrame, order: list[str], size: Column, most: int, group: list[str]) -> DataFrame:
    """``rows`` with ``chunk``: the number of the part that a row falls into if parts of ``most`` bytes are filled in order."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("chunk", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / most))
