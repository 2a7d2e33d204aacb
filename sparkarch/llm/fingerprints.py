"""Exact deduplication by polynomial fingerprints that combine across chunks.

The fingerprint of a text of bytes b0 b1 ... is the polynomial with those coefficients at a fixed point, modulo two primes.
Fingerprints of neighbouring chunks combine: shift the left one by the right one's length and add. So chunks are hashed in
any order, in any task. Texts of equal length and fingerprint are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, hot_keys, slices, small, spread_join, table, unused, worker_cache

#: Moduli below 2**31 and the points of evaluation.
PRIMES, POINTS = (2147483647, 2147483629), (1048583, 805306457)
CHUNK = 1 << 16
#: Longer texts are hashed in parts of SPREAD_PART bytes, in tasks of their own.
SPREAD_BYTES, SPREAD_PART = 8 << 20, 4 << 20
KEY = ["n_bytes", "h1", "h2"]


@lru_cache(4)
def _powers(primes: tuple[int, ...]) -> np.ndarray:
    out = np.empty((len(primes), CHUNK), dtype=np.uint64)
    for row, (p, r) in enumerate(zip(primes, POINTS, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[row, i] = x
            x = x * r % p
    return out


def chunk_hash(data: bytes, primes: tuple[int, ...] = PRIMES) -> tuple[int, ...]:
    """Fingerprint of at most CHUNK bytes."""
    if not data:
        return (0,) * len(primes)
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    weights = _powers(primes)[:, CHUNK - len(b) :]
    return tuple(int((b * w).sum()) % p for w, p in zip(weights, primes, strict=True))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int, primes: tuple[int, ...] = PRIMES) -> tuple[int, ...]:
    """Fingerprint of two neighbouring stretches of bytes from the fingerprint of each."""
    return tuple((a * pow(r, right_bytes, p) + b) % p for a, b, p, r in zip(left, right, primes, POINTS, strict=True))


def fingerprint(data: bytes, primes: tuple[int, ...] = PRIMES) -> tuple[int, ...]:
    out = chunk_hash(data[:CHUNK], primes)
    for i in range(CHUNK, len(data), CHUNK):
        part = data[i : i + CHUNK]
        out = combine(out, chunk_hash(part, primes), len(part), primes)
    return out


def fingerprints(docs: DataFrame, text: str = "text", primes: tuple[int, ...] = PRIMES, spread_bytes: int = SPREAD_BYTES, spread_part: int = SPREAD_PART) -> DataFrame:
    """One row per document: ``doc_id``, ``tag`` (a number of the row's own), ``n_bytes``, ``h1``, ``h2``, ``text_sha256``.

    A text of more than ``spread_bytes`` is dealt in parts; each part comes back with its hash and the factor that shifts what is
    left of it, and the parts' hashes are combined in order.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("tag"), body.alias("body"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in slices(batches):
            texts = batch.column("body").to_pylist()
            prints = [fingerprint(x, primes) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array([len(x) for x in texts], pa.int64()), *(pa.array([p[i] for p in prints], pa.int64()) for i in range(2)), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())],
                ["doc_id", "tag", *KEY, "text_sha256"],
            )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("body").to_pylist()
            prints = [(*fingerprint(x, primes), *(pow(r, len(x), p) for p, r in zip(primes, POINTS, strict=True))) for x in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array([p[i] for p in prints], pa.int64()) for i in range(4))], [*own, "h1", "h2", "f1", "f2"])

    own = ["doc_id", "tag", "n_bytes", "text_sha256", "part"]
    start = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    step = lambda a, x: F.struct(*[((a[h] * x[f] + x[h]) % p).alias(h) for h, f, p in zip(("h1", "h2"), ("f1", "f2"), primes, strict=True)])
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "h1", "h2", "f1", "f2"))), start, step)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    short = rows.filter(F.octet_length("body") <= spread_bytes).withColumn("tag", F.col("tag") * 2)
    short = short.mapInArrow(whole, f"doc_id {id_type}, tag long, n_bytes long, h1 long, h2 long, text_sha256 string")
    long = rows.filter(F.octet_length("body") > spread_bytes).select("doc_id", (F.col("tag") * 2 + 1).alias("tag"), F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256"), "body")
    long = long.withColumn("part", F.explode(F.expr(f"sequence(0, cast((n_bytes - 1) div {spread_part} as int))"))).withColumn("body", F.expr(f"substring(body, part * {spread_part} + 1, {spread_part})"))
    long = long.repartition("tag", "part").mapInArrow(parts, f"doc_id {id_type}, tag long, n_bytes long, text_sha256 string, part int, h1 long, h2 long, f1 long, f2 long")
    long = long.groupBy("doc_id", "tag", "n_bytes", "text_sha256").agg(joined.alias("h"))
    return short.unionByName(long.select("doc_id", "tag", "n_bytes", "h.h1", "h.h2", "text_sha256"))


def _groups(prints: DataFrame, key: list[str]) -> DataFrame:
    """Groups of more than one row, with the row that stays: largest doc_id, then largest tag."""
    return prints.groupBy(*key).agg(F.max(F.struct("doc_id", "tag")).alias("keeper"), F.count("*").alias("group_size")).filter("group_size > 1")


def unequal_groups(docs: DataFrame, prints: DataFrame, groups: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Keys of those groups whose texts aren't all the same, found by comparing the texts chunk by chunk.

    The least and the greatest of a group's chunks at each place must agree. Each task compares what it holds before anything
    is shuffled, so a group of any size sends a chunk or two per task.
    """
    members = spread_join(prints, groups.select(*KEY), KEY, ["tag"], hot=hot_keys(groups, KEY, "group_size") if not few(groups.select(*KEY)) else None)
    members = small(cut(members.select("doc_id", "text_sha256", *KEY).distinct()))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    held = docs.select(F.col("doc_id").alias("id"), body.alias("body")).join(members, F.col("id").eqNullSafe(F.col("doc_id"))).filter(F.sha2("body", 256) == F.col("text_sha256"))
    chunks = held.select(*KEY, "body", F.explode(F.expr(f"sequence(0, cast((greatest(n_bytes, 1) - 1) div {chunk} as int))")).alias("chunk")).select(*KEY, "chunk", F.expr(f"substring(body, chunk * {chunk} + 1, {chunk})").alias("data"))
    return chunks.groupBy(*KEY, "chunk").agg((F.min("data") != F.max("data")).alias("differ")).filter("differ").select(*KEY).distinct()


def exact_groups(docs: DataFrame, text: str = "text", primes: tuple[int, ...] = PRIMES, spread_bytes: int = SPREAD_BYTES, spread_part: int = SPREAD_PART) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``tag``.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest doc_id stays (a
    null doc_id loses to any other); of rows that agree in doc_id too, just one stays. An empty table gives no rows. Rows whose
    texts share length and fingerprint but differ are told apart by SHA-256.
    """
    prints = cut(fingerprints(docs, text, primes, spread_bytes, spread_part))
    groups = cut(_groups(prints, KEY))
    unequal = cut(unequal_groups(docs, prints, groups, text))
    key, hot = KEY, lambda: None if few(groups) else hot_keys(groups, key, "group_size")
    if not unequal.isEmpty():  # two different texts with one fingerprint
        marked = spread_join(prints, unequal.withColumn("split", F.lit(True)), KEY, ["tag"], "left", hot())
        prints = cut(marked.withColumn("part_of", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split"))
        key = [*KEY, "part_of"]
        groups = cut(_groups(prints, key))
    out = spread_join(prints, groups, key, ["tag"], "left", hot())
    return out.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("group_size").isNull() | (F.col("keeper.tag") == F.col("tag"))).alias("kept"), "text_sha256", "tag")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns and whatever their names.

    One row of each text stays, that with the largest doc_id; null counts as empty, so of null and empty texts one row stays. Of
    rows that agree in doc_id and text any one stays, with all its other columns. doc_id may be of any type that can be ordered.
    """
    rows = cut(exact_groups(docs, text).select("doc_id", "text_sha256", "kept"))
    id_, sha, digest = unused(docs.columns, "id", "sha", "digest")
    dropped = rows.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), "kept").groupBy(id_, sha).agg(F.max("kept").alias("any"), F.count("*").alias("rows"))
    dropped = cut(dropped.filter("not any or rows > 1"))
    out = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    same = out["doc_id"].eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(sha))
    out = out.join(small(dropped.filter("not any").select(id_, sha)), same, "left_anti")
    repeated = dropped.filter("any")
    if not repeated.isEmpty():  # rows that agree in doc_id and text: one stays
        again = small(repeated.select(id_, sha))
        once = out.join(again, same, "left_semi").dropDuplicates(["doc_id", digest])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.drop(digest)


def op7_polynomial_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`exact_groups` of all ``documents``, every row; what it says of nulls, ties and repeated rows holds."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("tag")


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
