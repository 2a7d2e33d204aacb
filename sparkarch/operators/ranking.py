"""Ranks, normalisations and limits without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def running(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` (a whole number) over all rows before in the order; with the value 1 that is the row's place from 0.

    One range exchange; the sorted rows are stored, so that the sums stay the same when a task runs again. Windows run inside
    the ranges, and only a range's sum comes to the driver.
    """
    stored = cut(rows.withColumn("__value", value.cast("long")).sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33).cast("int")
    sums, starts, before = stored.groupBy(part.alias("p")).agg(F.sum("__value").alias("s")).collect(), [], 0
    for r in sorted(sums, key=lambda r: r["p"]):
        starts.append((r["p"], before))
        before += r["s"]
    offsets = rows.sparkSession.createDataFrame(starts, "__part int, __start long")  # a row per range
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    held = stored.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return held.withColumn(name, F.col("__start") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).drop("__value", "__at", "__part", "__start")


def percentile_rank(rows: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """``rows`` with the place in the order (value, key) over n - 1, 4 digits; 1 for a single row. Ties get different places.

    The place is the number of rows with a smaller value, from a running sum over one row per distinct value (degrees have few),
    plus the place within the value: rows of one value are ranked in ranges of the key, by its first characters, with a count
    per range and a window inside it. So no task gets all rows of a value.
    """
    per_value = rows.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    before = Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_value.select("__v", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"), F.sum("__k").over(Window.partitionBy()).alias("__n"))
    # first characters split a value's rows into ranges in the order of the key
    part = F.substring(F.col(key).cast("string"), 1, 6)
    per_part = rows.groupBy(F.col(value).alias("__v"), part.alias("__p")).agg(F.count("*").alias("__c"))
    inside = Window.partitionBy("__v").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("__v", "__p", F.coalesce(F.sum("__c").over(inside), F.lit(0)).alias("__skip"))
    place = F.row_number().over(Window.partitionBy("__v", "__p").orderBy(key)) - 1
    ranked = rows.withColumn("__v", F.col(value)).withColumn("__p", part).withColumn("__at", place)
    ranked = ranked.join(parts, ["__v", "__p"]).join(starts, "__v")
    share = F.when(F.col("__n") == 1, 1.0).otherwise(F.round((F.col("__before") + F.col("__skip") + F.col("__at")) / (F.col("__n") - 1), 4))
    return ranked.withColumn(name, share).drop("__v", "__p", "__at", "__skip", "__before", "__n")


def over_max(value: Column, largest: Column, digits: int = 6) -> Column:
    """A score over the largest, 0 where that is 0."""
    return F.when(largest > 0, F.round(value / largest, digits)).otherwise(0.0)


def bounded(rows: DataFrame, order: list, limit: int | None) -> tuple[DataFrame, int, bool]:
    """The first ``limit`` rows (all for None or 0, none if negative), the number of all rows, and whether some were left out."""
    total = rows.count()
    if not limit:
        return rows.orderBy(*order), total, False
    n = max(limit, 0)
    return rows.orderBy(*order).limit(n), total, total > n


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the order."""
    columns = rows.columns
    return rows.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")


def best(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """All rows that have their group's largest score."""
    top = rows.groupBy(*group).agg(F.max(score).alias("__top"))
    return rows.join(top, group).filter(F.col(score) == F.col("__top")).drop("__top")
