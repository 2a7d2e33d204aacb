"""The registry of stable ids: allocation, restoring, removal and its clean-up. Table ``ids(kind, slot, generation, name, status, removed_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running

BUDGET = {"module": 250 * 1024, "artifact": 100 * 1024}


def obj_id(kind: Column, slot: Column, generation: Column) -> Column:
    """``slot/generation``, artifacts with the letter A before."""
    return F.concat(F.when(kind == "artifact", "A").otherwise(""), slot.cast("string"), F.lit("/"), generation.cast("string"))


def sync(ids: DataFrame, current: DataFrame, kind: str) -> DataFrame:
    """The registry of one kind after names have come and gone: ``current(name)``.

    Active names that are gone become orphans. An orphan's name that is back gets its id back. A new name, in the order of
    names, takes the smallest free slot: one never used with generation 1, or one whose occupants were all removed from the
    table with the next generation. Empty names get none. Slots are only matched where names are new, by rank on both sides.
    """
    own = ids.filter(F.col("kind") == kind)
    names = current.filter("name is not null and name <> ''").select("name").distinct()
    kept = own.join(names.withColumn("__here", F.lit(True)), "name", "left")
    here = F.coalesce("__here", F.lit(False))
    status = F.when(here, "active").otherwise("orphan")
    removed = F.when(here, F.lit(None).cast("timestamp")).otherwise(F.coalesce("removed_at", F.current_timestamp()))
    kept = kept.select("kind", "slot", "generation", "name", status.alias("status"), removed.alias("removed_at"))
    new = names.join(own.select("name"), "name", "left_anti")
    n = new.count()
    if not n:
        return kept
    used = own.select("slot").distinct()
    most = used.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("m")).first()["m"]
    spark = ids.sparkSession
    free = spark.range(1, most + n + 1).select(F.col("id").cast("int").alias("slot")).join(used, "slot", "left_anti")
    free = running(free, ["slot"], F.lit(1), "__r").filter(F.col("__r") < n)  # as many as new names
    ranked = running(new, ["name"], F.lit(1), "__r")
    made = ranked.join(free, "__r").select(F.lit(kind).alias("kind"), "slot", F.lit(1).alias("generation"), "name", F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("removed_at"))
    return kept.unionByName(made)


def reuse(ids: DataFrame, retired: DataFrame) -> DataFrame:
    """``ids`` with generations raised above those that ``retired(kind, slot, generation)`` records for the same slot."""
    last = retired.groupBy("kind", "slot").agg(F.max("generation").alias("__g"))
    return ids.join(last, ["kind", "slot"], "left").withColumn("generation", F.greatest("generation", F.coalesce(F.col("__g") + 1, F.lit(1)))).drop("__g")


def collect_garbage(ids: DataFrame, references: DataFrame, kind: str, budget: int | None = None) -> DataFrame:
    """``ids`` less the oldest orphans that no report refers to, until the kind's names fit the budget in bytes.

    ``references(obj_id)``. Sums run over orphans only, oldest first.
    """
    budget = BUDGET[kind] if budget is None else budget
    size = F.octet_length("name")
    own = ids.filter(F.col("kind") == kind)
    total = own.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    if total <= budget:
        return ids
    loose = own.filter("status = 'orphan'").withColumn("obj_id", obj_id(F.col("kind"), F.col("slot"), F.col("generation"))).join(references.select("obj_id").distinct(), "obj_id", "left_anti")
    gone = running(loose, ["removed_at", "slot", "generation"], size, "__before").filter(F.lit(total) - F.col("__before") > budget)
    return ids.join(gone.select("kind", "slot", "generation"), ["kind", "slot", "generation"], "left_anti").select(*ids.columns)


def repair(names: DataFrame, objects: DataFrame) -> DataFrame:
    """``name``, ``obj_id`` of mappings that both sides agree on, or that only one side holds without a contradiction."""
    both = names.select("name", "obj_id").unionByName(objects.select("name", "obj_id")).distinct()
    once = lambda c: both.groupBy(c).agg(F.count("*").alias("k")).filter("k = 1").select(c)
    return both.join(once("name"), "name", "left_semi").join(once("obj_id"), "obj_id", "left_semi").select("name", "obj_id")
