"""Names that several modules define: conflicts and identical duplicates, and how severe they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that many modules may define. Fixed values.
IGNORED = ("main", "run", "get", "add", "build")


def ignored_name(name: Column) -> Column:
    return (F.coalesce(name, F.lit("")) == "") | name.isin(*IGNORED) | name.startswith("_") | name.startswith("visit_")


def is_constant(name: Column) -> Column:
    """Cased, and without any small letter."""
    return (F.upper(name) == name) & (F.lower(name) != name)


def normal_code(code: Column) -> Column:
    """Lines without outer white space, empty ones left out."""
    lines = F.transform(F.split(code, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def collisions(facts: DataFrame) -> DataFrame:
    """``name``, ``type``, ``kind``, ``message``, ``nodes`` (sorted modules), ``is_identical``, shortest and longest code in lines.

    From ``facts(module_id, name, type, code)``, one group per name and type that more than one module defines. Codes are
    compared by their hash, so a group exchanges a few bytes per definition, and counts are combined before that.
    """
    each = facts.filter(~ignored_name(F.col("name"))).select("module_id", "name", "type", F.sha2(normal_code(F.coalesce("code", F.lit(""))), 256).alias("h"), F.size(F.split(F.coalesce("code", F.lit("")), "\r\n|\r|\n")).alias("lines"))
    per = each.groupBy("name", "type").agg(F.array_sort(F.collect_set("module_id")).alias("nodes"), F.size(F.collect_set("h")).alias("codes"), F.min("lines").alias("min_lines"), F.max("lines").alias("max_lines"))
    found = per.filter(F.size("nodes") > 1)
    same = F.col("codes") == 1
    kind = F.when(same, "IDENTICAL_DEFINITION_DUPLICATE").otherwise("NAME_COLLISION")
    message = F.concat(F.when(same, "Same definition of ").otherwise("Different definitions of "), "type", F.lit(" "), "name", F.lit(" in "), F.array_join("nodes", ", "))
    return found.select("name", "type", kind.alias("kind"), message.alias("message"), "nodes", same.alias("is_identical"), "min_lines", "max_lines")


def severity(found: DataFrame) -> DataFrame:
    """``found`` with ``severity``: classes by how much their lengths differ, functions and variables warning, else info."""
    small, large = F.col("min_lines"), F.col("max_lines")
    of_class = F.when((small > 0) & (large / small >= 2.0), "critical").when(large - small > 5, "warning").otherwise("info")
    return found.withColumn("severity", F.when(F.col("type") == "class", of_class).when(F.col("type").isin("function", "variable"), "warning").otherwise("info"))


def by_severity(found: DataFrame) -> DataFrame:
    """``severity``, ``count`` of real collisions, critical first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.filter("not is_identical").groupBy("severity").agg(F.count("*").alias("count")).orderBy(rank)


def violations(found: DataFrame) -> DataFrame:
    return found.select("kind", "message", "nodes", F.col("type").alias("artifact_type"), "is_identical")


def incomplete(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """``module_id``, ``reason``: facts that lack what a collision needs, and facts of unknown modules."""
    bad = facts.filter("name is null or type is null or code is null").select("module_id", F.lit("missing value").alias("reason"))
    lost = facts.join(modules.select("module_id"), "module_id", "left_anti").select("module_id", F.lit("unknown module").alias("reason"))
    return bad.unionByName(lost).distinct()
