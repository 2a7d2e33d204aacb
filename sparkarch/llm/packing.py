"""Packing of encoded documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, worker_cache
from .tokens import CACHE_WORDS, encoded_batches, tokenizer_file

PIECES = "piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs. The rule wastes a few sequences a task, whatever their number.
GROUP_PIECES = 16_384


def pieces(docs: DataFrame, text: str = "text", capacity: int = 2048, spec: str | None = None, end_id: int = 0, cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """The documents' ids, each followed by ``end_id``, cut into pieces of at most ``capacity``: one row per piece.

    ``doc_id`` keeps its type. A null or empty text is one piece, of ``end_id`` alone; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = spec or open(tokenizer_file()).read()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, encoded in encoded_batches(batches, spec, "text", cache_words):
            rows = []
            for doc, ids in enumerate(encoded):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i : i + 4 * capacity]
                    rows.append((doc, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            held = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(held[0]), *held[1:]], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep_words:
            worker_cache()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(cut_up, f"doc_id {kind}, {PIECES}")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, taken in the order given, and the number of bins.

    Each goes where the sum, over the gaps that open bins have left, of the squared number of bins with that gap grows least:
    into a bin with some gap, or into a new one. Of bins with the same gap the last opened is taken; ties go to the smaller
    gap, then to an open bin.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, n = np.empty(len(lengths), dtype=np.int64), 0
    offsets = np.empty(len(lengths), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gap, left = -1, capacity - s
        if left:
            here = count[s:capacity]
            change = 2 * (count[:left] - here) + 2
            change[0] = 1 - 2 * here[0]  # a full bin is no longer open
            change[here == 0] = never
            k = int(change.argmin())
            if change[k] != never and change[k] <= 2 * count[left] + 1:
                gap = s + k
        if gap < 0:
            bins[i], offsets[i] = n, 0
            n += 1
        else:
            bins[i], offsets[i] = open_bins[gap].pop(), capacity - gap
            count[gap] -= 1
            left = gap - s
        if left:
            open_bins[left].append(int(bins[i]))
            count[left] += 1
    return bins, offsets, n


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """:func:`place` for lengths that are all known: the long ones first, by falling length, in two orders of the rest; the better."""
    best = None
    falling = np.argsort(-lengths, kind="stable")
    mixed = np.concatenate([falling[lengths[falling] >= 0.3 * capacity], np.flatnonzero(lengths < 0.3 * capacity)])
    for order in (falling, mixed):
        bins, offsets, n = place(lengths[order], capacity)
        if best is None or n < best[2]:
            b, o = np.empty_like(bins), np.empty_like(offsets)
            b[order], o[order] = bins, offsets
            best = b, o, n
    return best


def pack(docs: DataFrame, text: str = "text", capacity: int = 2048, spec: str | None = None, group_pieces: int = GROUP_PIECES, cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """All pieces of all documents with their ``sequence_id`` and ``offset``.

    The texts are read and encoded once; only the pieces' lengths travel. Full pieces are sequences of their own. The others
    are dealt evenly, by a hash of their place in the table, to tasks of about ``group_pieces`` pieces, each of which packs
    its own by the rule of :func:`place`; so no key or text can fill one task. ``doc_id`` is of any type and other columns aren't
    read. ``cache_words`` bounds the words whose ids a worker keeps, until the next task if ``keep_words``. A null or empty text is a piece of one id; an
    empty table gives no rows; repeated rows are packed each.
    """
    stored = cut(pieces(docs, text, capacity, spec, cache_words=cache_words, keep_words=keep_words).withColumn("row", F.monotonically_increasing_id()))
    full = stored.filter(F.col("length") == capacity)
    rest = stored.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def in_group(held: pa.Table) -> pa.Table:
        held = held.sort_by("row")
        bins, offsets, _ = pack_lengths(held["length"].to_numpy(), capacity)
        ids = bins * groups + held["group"].to_numpy()
        return held.drop_columns(["row", "group"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("group").applyInArrow(in_group, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")
    # numbers below zero belong to full pieces
    return packed.unionByName(full.select(*stored.columns[:-1], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`pack` of all ``documents`` into sequences of at most 2048 tokens; nulls, empty texts and repeated rows as there."""
    return pack(table(spark, sf_dir, "documents"))
