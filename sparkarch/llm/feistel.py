"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0 to n-1 in the order of their key, a keyed permutation of those numbers says where each row goes,
and ``place % shards`` and ``place // shards`` are its shard and slot. Both can be computed from a row's number, and the
number from them, without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, unused

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.uint64(seed) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, keys: np.ndarray, half: int) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << shift) | right


def _once_back(x: np.ndarray, keys: np.ndarray, half: int) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1]:
        left, right = right ^ (_mix(left ^ key) & mask), left
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """Repeat the step for values that left 0..n-1 until all are back; the domain is under 4n, so few repeat."""
    x = step(np.asarray(x, dtype=np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = step(x[out])
    return x


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each of the row numbers ``0 <= number < n``: a bijection of 0..n-1."""
    keys, half = _keys(seed), _half_bits(n)
    return _walk(numbers, n, lambda x: _once(x, keys, half)).astype(np.int64)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each place."""
    keys, half = _keys(seed), _half_bits(n)
    return _walk(places, n, lambda x: _once_back(x, keys, half)).astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number of the row at a slot of a shard."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with ``name``, the row's number from 0 in the order of the columns ``order`` (nulls first), and the number of rows.

    One range exchange; the sorted rows are stored once, so that the numbers stay the same when a task runs again. Only the
    number of rows of each partition comes to the driver.
    """
    at, in_part, start = unused([*rows.columns, name], "at", "part", "start")
    stored = cut(rows.sort(*[F.col(c).asc_nulls_first() for c in order]).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col(at), 33).cast("int")
    counts = sorted((r["part"], r["rows"]) for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect())
    starts, n = [], 0
    for p, k in counts:
        starts.append((p, n))
        n += k
    offsets = rows.sparkSession.createDataFrame(starts, f"{in_part} int, {start} long")
    numbered = stored.withColumn(in_part, part).join(F.broadcast(offsets), in_part)  # a row per partition
    return numbered.withColumn(name, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, in_part, start), n


def shard(rows: DataFrame, order: list[str], shards: int = 8, seed: int = 20240229) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot``: a reproducible shuffle dealt to ``shards`` shards.

    Shards differ by at most one row and slots have no gaps. Rows that agree in all the columns of ``order`` are numbered in
    any order among themselves; a null sorts before other values; an empty table gives an empty table; with fewer rows than
    shards the last shards stay empty. Where ``rows`` has a column of one of those names, that stays and the new one has an
    underscore behind its name.
    """
    name, shard_, slot, at = unused(rows.columns, "row_number", "shard", "slot", "place")
    numbered, n = number_rows(rows, order, name)

    @F.pandas_udf(T.LongType())
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = numbered.withColumn(at, place(name))
    return placed.select(*numbered.columns, (F.col(at) % shards).cast("int").alias(shard_), F.expr(f"`{at}` div {shards}").alias(slot))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`shard` of all ``documents`` in the order of doc_id, then text and size; a null text has size 1 and the CRC of no bytes."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
