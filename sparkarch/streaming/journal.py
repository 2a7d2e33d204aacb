"""The journal of revisions: retention, continuity, latest state, and the same as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETAINED, AFFECTED_SHOWN = 100, 20


def affected(items: Column) -> Column:
    """Struct of the number of affected modules, whether some are left out, and the first 20."""
    return F.when(items.isNotNull(), F.struct(F.size(items).alias("total"), (F.size(items) > AFFECTED_SHOWN).alias("truncated"), F.slice(items, 1, AFFECTED_SHOWN).alias("items")))


def retained(events: DataFrame, most: int = RETAINED) -> DataFrame:
    """The events of the last ``most`` revisions."""
    last = events.agg(F.max("revision").alias("__last"))  # one row
    return events.crossJoin(F.broadcast(last)).filter(F.col("revision") > F.col("__last") - most).drop("__last")


def continuity(events: DataFrame, after: int | None, most: int = RETAINED, latest: int | None = None) -> DataFrame:
    """One row: latest and earliest retained revision, ``continuity``, ``resync_required``, ``resync_reason``.

    Without a cursor continuity isn't asked for. A cursor ahead of the latest revision, or before the one that precedes the
    earliest retained event, is a gap; without events only a cursor at ``latest`` is continuous.
    """
    ends = events.agg(F.max("revision").alias("l"), F.min("revision").alias("e"))
    last = F.coalesce("l", F.lit(latest if latest is not None else 0))
    first = F.when(F.col("l").isNotNull(), F.greatest(F.col("e"), F.col("l") - (most - 1)))
    if after is None:
        state, reason = F.lit("not_requested"), F.lit(None).cast("string")
    else:
        reason = F.when(last < after, "revision_discontinuity").when(F.when(first.isNull(), last != after).otherwise(first - 1 > after), "event_retention_gap")
        state = F.when(reason.isNull(), "continuous").otherwise("gap")
    return ends.select(last.alias("latest_revision"), first.alias("earliest_retained_revision"), state.alias("continuity"), reason.isNotNull().alias("resync_required"), reason.alias("resync_reason"))


def page(events: DataFrame, after: int | None, limit: int | None = 20) -> DataFrame:
    """Events after a revision in order, at most ``limit``; all of the retained ones without a cursor."""
    found = (events if after is None else events.filter(F.col("revision") > after)).orderBy("revision")
    return found if limit is None else found.limit(max(0, limit))


def latest(events: DataFrame, key: str = "module_id") -> DataFrame:
    """``key`` with its largest revision and the operation there; the order of arrival doesn't matter."""
    return events.groupBy(key).agg(F.max("revision").alias("revision"), F.max_by("operation", "revision").alias("operation"))


def parse_state(events: DataFrame, key: str = "module_id") -> DataFrame:
    """``key``, ``revision``, ``state``, ``good_revision`` from events with a ``status``.

    fresh if the last parse went well; last_known_good if it failed but an earlier one went well; else unavailable.
    """
    per = events.groupBy(key).agg(F.max("revision").alias("revision"), F.max_by("status", "revision").alias("s"), F.max(F.when(F.col("status") == "ok", F.col("revision"))).alias("good_revision"))
    state = F.when(F.col("s") == "ok", "fresh").when(F.col("good_revision").isNotNull(), "last_known_good").otherwise("unavailable")
    return per.select(key, "revision", state.alias("state"), "good_revision")


def stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A journal folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes", slide: str | None = None, key: str = "operation") -> DataFrame:
    """Event-time counts per window and key; events later than the watermark are dropped by a stream, and by a stream only."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width, slide or width), key).agg(F.count("*").alias("events"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", key: str = "module_id") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))


def run_batches(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start ``apply(batch, batch_id)`` over a stream: what is there now, then stop. ``apply`` must be repeatable by batch_id."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
