"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, drop_path, new_path, shared_dir  # noqa: F401  the operators take them from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased: every other ASCII character but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many rows, and bytes in columns of no fixed width, are broadcast; beyond, the join is left to a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20
#: Rows of one key that one task of a join may have to read.
HOT_ROWS = 2048
#: Bytes of texts that a Python worker works on at a time.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark drops a query's shuffle files when the query ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def lower_az(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other letter left alone (``lower`` alone would change É too)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it unlike every column and every other name, case aside."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def few(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counted, and ``size`` bytes in columns of no fixed width."""
    rows = BROADCAST_ROWS if rows is None else rows
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType)
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    held = F.sum(F.octet_length(F.to_json(F.struct(*wide)))) if wide else F.lit(0)
    n, held = df.limit(rows + 1).agg(F.count("*"), held).first()
    return n <= rows and (held or 0) <= (BROADCAST_BYTES if size is None else size)


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be :func:`few`, else as it is. ``df`` is read for that, so it should be stored."""
    return F.broadcast(df) if few(df, rows, size) else df


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Keys with more rows than one task should have, and ``__parts`` to split each into. ``counts``: the keys and ``n``, their rows.

    There are at most BROADCAST_ROWS such keys: the limit rises with all rows that hot keys hold.
    """
    hot = cut(counts.filter(F.col(n) > HOT_ROWS).select(*on, F.col(n).alias("__n")))
    held = hot.agg(F.sum("__n")).first()[0] or 0
    most = max(HOT_ROWS, -(-held // max(1, BROADCAST_ROWS)))
    return hot.filter(F.col("__n") > most).select(*on, F.expr(f"cast(__n div {most} + 1 as int)").alias("__parts"))


def spread_join(big: DataFrame, little: DataFrame, on: list[str], by: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``little`` (columns ``on`` in both, never null), where no key of ``big`` fills one task.

    The rows of a hot key are dealt to parts by a hash of ``by``, and ``little``'s rows of that key are copied to each part. Without
    ``hot`` (what :func:`hot_keys` gives), a little one that is :func:`few` is broadcast, and beyond that the keys are counted.
    """
    if hot is None:
        if few(little):
            return big.join(F.broadcast(little), on, how)
        hot = hot_keys(big.groupBy(*on).agg(F.count("*").alias("n")), on)
    if hot.isEmpty():
        return big.join(little, on, how)
    hot, parts = F.broadcast(hot), F.coalesce("__parts", F.lit(1))
    dealt = big.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__parts")
    copied = little.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [*on, "__part"], how).drop("__part")


_KEPT: dict[str, Any] = {}


def release_memory() -> None:
    """Give back what this process has freed: idle workers stay for a minute, beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker_cache(name: str | None = None, make: Callable[[], Any] | None = None) -> Any:
    """What a Python worker keeps for the next task of the same kind; it holds one such thing, so another name drops it.

    Spark uses a worker process again for later tasks. Operators that keep nothing call this without a name.
    """
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            release_memory()
        if name is not None:
            _KEPT[name] = make()
    return _KEPT.get(name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows and ``size`` bytes (or one row), without a copy: what is made of one is gone before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            waiting = [batch.slice(i, rows)]
            while waiting:
                part = waiting.pop()
                half = part.num_rows // 2
                if half and part.nbytes > size:
                    waiting += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
