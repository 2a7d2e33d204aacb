"""Near-duplicate groups by bottom-k sketches.

A document's set holds its distinct shingles; its sketch the k smallest values of one hash function over the set. Sketches
estimate, exact sets decide:

1. Documents with the same set form a class; a class is a row from here on.
2. Inverted lists: a class enters the lists of those of its retained values that are rarest in the corpus, as many as make two
   sets of the wanted similarity meet in at least one list.
3. Each list proposes pairs with one member of its own, so that a list of any length proposes no more pairs than it has rows.
   A 256-bit signature and then the union sketch estimate their similarity, and the exact sets confirm it. Links join classes to
   components. Members that have no like one of another component in their list leave it; what is left proposes again.
4. What is left may hide a link only between members of one list in different components that have a like one there. In short
   lists those are compared in pairs; in long ones, members outside the largest component are compared with all, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, hot_keys, new_path, release_memory, shuffles_released, slices, small, spread_join, table, unused, worker_cache

SKETCH = 64
#: Values whose number of lists' rows is worth ranking; those held by fewer classes rank first, by value. Bounds a broadcast.
HEAVY_VALUES = 400_000
#: Rounds in which lists propose pairs with one member each.
STAR_ROUNDS = 2
#: Links (16 bytes each) that one task joins.
LINKS_IN_TASK = 500_000
#: Members of a list up to which they are compared in pairs; beyond, shingles on either side of a block.
SHORT_LIST, BLOCK_OUTSIDE, BLOCK_INSIDE = 32, 50_000, 200_000
#: Members on either side of a block in which a long list looks for like ones.
LIST_BLOCK = 4096
#: How many standard deviations an estimate may be off.
DEVIATIONS = 5.5
CACHE_WORDS = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text.

    Words are what ASCII white space separates, A-Z lower-cased. A text of fewer words has its whole sequence as its one shingle;
    one without words has none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    hashes = worker_cache("word hashes", _WordHashes)
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(size, len(found))
    with np.errstate(over="ignore"):
        z = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for j in range(width):
            z = _mix(z * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(z >> np.uint64(1)).astype(np.int64)


_BUCKETS = np.arange(256, dtype=np.int64) << 55
SIGNATURE = ("s1", "s2", "s3", "s4")


def signature(values: np.ndarray) -> list[int]:
    """A bit of the smallest hash in each 256th of the range, as four numbers; each pair of smallest hashes that differs costs a bit in half of the cases."""
    at = np.searchsorted(values, _BUCKETS)
    ends = np.append(at[1:], len(values))
    bits = np.zeros(256, dtype=np.uint8)
    held = at < ends
    bits[held] = values[at[held]] & 1
    return np.packbits(bits).view(">i8").tolist()


def overlap_bound(n: np.ndarray | int, k: int, percent: int) -> np.ndarray:
    """How many retained values a set of n shares at least with any that is similar enough: exact where all are retained."""
    t = percent / 100
    return np.maximum(1, np.minimum(np.ceil(np.asarray(n) * t - 1e-9), floor(k * t - DEVIATIONS * sqrt(k * t * (1 - t))))).astype(np.int64)


def sketches(docs: DataFrame, text: str, size: int, k: int) -> DataFrame:
    """``doc_id``, ``n``, ``digest`` of the whole set, ``sketch`` and signature ``s1`` to ``s4`` of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, kept, bits = [], [], [], []
            for t in batch.column("text").to_pylist():
                values = shingle_set(t, size)
                n.append(len(values))
                digest.append(xxhash.xxh3_128_digest(values.tobytes()))
                kept.append(values[:k])
                bits.append(signature(values))
            marks = [pa.array([b[i] for b in bits], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(kept, pa.list_(pa.int64())), *marks], ["doc_id", "n", "digest", "sketch", *SIGNATURE])
        release_memory()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, digest binary, sketch array<long>, s1 long, s2 long, s3 long, s4 long")


def repeated_values(classes: DataFrame) -> DataFrame:
    """``value``, ``n``: retained values that more than one class holds."""
    return classes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")


def list_rows(classes: DataFrame, repeated: DataFrame, k: int, percent: int, heavy_values: int = HEAVY_VALUES) -> DataFrame:
    """``value``, ``cid``: the inverted lists. Values rank by the number of classes that retain them, rarest first.

    Two sets that share at least t retained values of m meet among the first m - t + 1 of each, whatever the order, if both use
    the same. So the order only keeps lists short; values held by few classes needn't be told apart.
    """
    least = max(16, -(-classes.count() * k // heavy_values))  # no more than heavy_values can occur so often
    counted = repeated.filter(F.col("n") >= least).toPandas().sort_values("value")
    sent = classes.sparkSession.sparkContext.broadcast((counted["value"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, held_by = sent.value
        for batch in batches:
            column = batch.column("sketch")
            values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            weight = np.zeros(len(values), dtype=np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
                same = heavy[at] == values
                weight[same] = held_by[at[same]]
            m = np.diff(offsets)
            owner = np.repeat(np.arange(len(m)), m)
            order = np.lexsort((values, weight, owner))
            place = np.arange(len(values)) - offsets[:-1][owner]
            taken = m - np.minimum(overlap_bound(batch.column("n").to_numpy(), k, percent), m) + 1
            first = order[place < taken[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(values[first]), pa.array(batch.column("cid").to_numpy()[owner[first]])], ["value", "cid"])

    return classes.select("cid", "n", "sketch").mapInArrow(run, "value long, cid long")


def _alike(a: str, b: str, percent: int) -> Column:
    """What sizes and signatures allow of a pair: columns n, s1 to s4 with the prefixes a and b."""
    c = F.col
    off = (1 - percent / 100) / 2
    most = floor(256 * off + 6 * sqrt(256 * off * (1 - off)))
    sizes = F.least(c(a + "n"), c(b + "n")) * 100 >= F.greatest(c(a + "n"), c(b + "n")) * percent
    differ = reduce(lambda x, y: x + y, [F.bit_count(c(a + s).bitwiseXOR(c(b + s))) for s in SIGNATURE])
    return sizes & (differ <= most)


def _with(pairs: DataFrame, side: str, info: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``info`` of one side of each pair; ``hot``: sides that very many pairs have."""
    named = info.select(*[F.col(c).alias(side if c == "cid" else f"{side}_{c}") for c in info.columns])
    return pairs.join(named, side) if hot is None else spread_join(pairs, named, [side], ["b" if side == "a" else "a"], hot=hot)


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int, hot: DataFrame | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` whose signatures and union sketch allow the similarity, with the estimate ``j``."""
    info = classes.select("cid", "n", *SIGNATURE)
    near = _with(_with(pairs, "a", info, hot), "b", info).filter(_alike("a_", "b_", percent)).select("a", "b")
    brief = classes.select("cid", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("v"))
    both = _with(_with(near, "a", brief, hot), "b", brief)
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("a_v", "b_v")), 1, k)).withColumn("j", F.size(F.array_intersect("u", F.array_intersect("a_v", "b_v"))) / F.size("u"))
    t = percent / 100
    return both.filter(F.col("j") >= t - DEVIATIONS * sqrt(t * (1 - t) / k)).select("a", "b", "j")


def sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """``cid``, ``shingles``: whole sets of the classes in ``cids``, read again from one document each.

    Rows that agree in doc_id and text give a row each; links are made distinct later.
    """
    wanted = cut(classes.select("cid", "digest", "rep").join(small(cids), "cid", "left_semi"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "shingles"])
        release_memory()

    reps = small(wanted.select("rep").distinct())
    texts = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(text).alias("text")).join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    found = texts.select("text").mapInArrow(run, "digest binary, shingles array<long>")
    return found.join(small(wanted.select("cid", "digest")), "digest").select("cid", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None = None) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough."""
    both = _with(_with(pairs.select("a", "b"), "a", sets, hot), "b", sets)
    both = both.withColumn("i", F.size(F.array_intersect("a_shingles", "b_shingles"))).withColumn("u", F.size("a_shingles") + F.size("b_shingles") - F.col("i"))
    return both.filter(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for f in frames:
        for u, v in zip(f["u"].tolist(), f["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    if root:
        yield pd.DataFrame({"cid": list(root), "label": [find(x) for x in root]})


def components(links: DataFrame, links_in_task: int = LINKS_IN_TASK) -> DataFrame:
    """``cid``, ``label`` of every class with a link: the smallest cid that links reach. Links: columns ``a``, ``b``.

    Links counted to be few are joined in one task. Beyond, rounds link larger neighbours and then smaller ones to the least
    neighbour, until nothing changes; a round exchanges the links and no node gathers its neighbours.
    """
    edges, before = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    if edges.count() <= links_in_task:
        return edges.coalesce(1).mapInPandas(_joined, "cid long, label long")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(lower.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())


def _blocks(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the members of a group that are ``outside`` and all its members: ``members(gid, cid, label, outside)``.

    ``sizes(cid, n)``. Blocks are cut by the number of shingles on either side, so a task holds a few MB of any group. A member
    is linked to the label of each other component that it belongs with, not to all of that component.
    """
    parts = lambda x, most: (F.floor(F.sum(x) / most) + 1).cast("long")
    held = members.join(sizes, "cid")
    grid = cut(held.groupBy("gid").agg(parts(F.col("n"), BLOCK_INSIDE).alias("inside"), parts(F.when(F.col("outside"), F.col("n")).otherwise(0), BLOCK_OUTSIDE).alias("asked")))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    placed = spread_join(members, grid, ["gid"], ["cid"])
    rows = placed.filter("outside").select("gid", upto("inside").alias("x"), F.pmod(F.xxhash64("cid"), F.col("asked")).alias("y"), "cid", "label", F.lit(True).alias("out"))
    rows = rows.unionByName(placed.select("gid", F.pmod(F.xxhash64("cid"), F.col("inside")).alias("x"), upto("asked").alias("y"), "cid", "label", F.lit(False).alias("out")))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        inside, asked = frame[~frame["out"]], frame[frame["out"]]
        found: list[tuple[int, int]] = []
        if len(inside) and len(asked):
            lengths = np.array([len(s) for s in inside["shingles"]])
            values, owner = np.concatenate(inside["shingles"].to_list()), np.repeat(np.arange(len(inside)), lengths)
            labels = inside["label"].to_numpy()
            for cid, label, s in zip(asked["cid"], asked["label"], asked["shingles"], strict=True):
                s = np.asarray(s)
                at = np.minimum(np.searchsorted(s, values), len(s) - 1)
                shared = np.bincount(owner[s[at] == values], minlength=len(lengths))
                near = np.unique(labels[shared * 100 >= (lengths + len(s) - shared) * percent])
                found += [(int(cid), int(x)) for x in near if x != label]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.join(sets, "cid").groupBy("gid", "x", "y").applyInPandas(compare, "a long, b long")


def with_alike(lists: DataFrame, percent: int, hot: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Rows of ``lists(value, cid, label, n, s1..s4)`` that have a like one (by size and signature) of another label in their list.

    Of each list one label holds the most members. Those outside it are compared with all, those inside with the ones outside, in
    blocks of at most about ``block`` members on either side, so that a list of any length is many tasks' work.
    """
    marks = ("n", *SIGNATURE)
    per = lists.groupBy("value", "label").agg(F.count("*").alias("c")).groupBy("value").agg(F.max(F.struct("c", "label")).alias("t"), F.sum("c").alias("m")).filter("t.c < m")
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    about = per.select("value", F.col("t.label").alias("main"), F.col("m").alias("all"), F.col("t.c").alias("in"), (F.col("m") - F.col("t.c")).alias("out")).withColumns({c: parts(c) for c in ("all", "in", "out")})
    placed = spread_join(lists, about, ["value"], ["cid"], hot=hot)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    cell = lambda out, x, y: F.struct(F.lit(out).alias("o"), x.alias("x"), y.alias("y"))
    outside = F.col("label") != F.col("main")
    asks = F.when(outside, F.transform(upto("all"), lambda y: cell(True, at("out"), y))).otherwise(F.transform(upto("out"), lambda y: cell(False, at("in"), y)))
    told = F.transform(upto("out"), lambda x: cell(True, x, at("all")))
    told = F.when(outside, F.concat(told, F.transform(upto("in"), lambda x: cell(False, x, at("out"))))).otherwise(told)
    mine = placed.select("value", "cid", "label", *marks, F.when(outside, F.col("all")).otherwise(F.col("out")).alias("times"), F.explode(asks).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in marks])
    other = placed.select(F.col("value").alias("o_value"), F.col("label").alias("o_label"), F.explode(told).alias("o_cell"), *[F.col(c).alias(f"b_{c}") for c in marks])
    same = (F.col("value") == F.col("o_value")) & (F.col("cell") == F.col("o_cell")) & (F.col("label") != F.col("o_label"))
    left = cut(mine.join(other, same & _alike("a_", "b_", percent), "left_semi").select("value", "cid", "label", *marks, "times"))
    several = left.filter("times > 1")  # found in more than one block
    return left.filter("times = 1").unionByName(several.dropDuplicates(["value", "cid"])).drop("times")


def near_groups(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80, k: int = SKETCH, rounds: int = STAR_ROUNDS, short_list: int = SHORT_LIST) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if 100 times the shingles in both are at least ``percent`` times the shingles in either;
    ``component_id`` is the smallest doc_id that links reach. Null and empty texts have no shingles and no links, and are kept.
    A null doc_id takes part; its component has the smallest id among the others, or null if it has no other. Rows that share a
    doc_id but not a text are told apart, and of rows with the kept doc_id each is marked as kept. An empty table gives no rows.

    Sets of at most ``k`` shingles are compared without estimates. Of larger ones a pair is missed only if its sketches differ by
    more than 5.5 standard deviations from what its similarity lets expect. Other columns of ``docs`` aren't read. Sketches are
    written once, as a table, and dropped when the result is stored. Keys that hold many rows (a group of copies, a list, a class
    that many are compared with, a component) are split among tasks.
    """
    with shuffles_released(docs.sparkSession):
        return _near_groups(docs, text, size, percent, k, rounds, short_list)


def _near_groups(docs: DataFrame, text: str, size: int, percent: int, k: int, rounds: int, short_list: int) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "sketches")
    sketches(docs, text, size, k).withColumn("cid", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    groups = cut(rows.filter("n > 0").groupBy("digest").agg(F.min("cid").alias("cid"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    crowds = hot_keys(groups, ["digest"], "copies")
    several = small(groups.filter("copies > 1").select("digest", F.col("cid").alias("first")))
    copies = small(cut(spread_join(rows.filter("n > 0").select("cid", "digest"), several, ["digest"], ["cid"], hot=crowds).filter("cid <> first").select("cid")))
    classes = rows.filter("n > 0").drop("doc_id").join(copies, "cid", "left_anti")
    named = groups.select("cid", "digest", "rep")
    marks = ("n", *SIGNATURE)
    info = classes.select("cid", *marks)

    repeated = cut(repeated_values(classes))
    frequent = hot_keys(repeated, ["value"])
    lists = spread_join(list_rows(classes, repeated, k, percent), repeated.select("value"), ["value"], ["cid"], hot=frequent)
    lists = cut(lists.withColumn("label", F.col("cid")))
    labels, links = None, None
    for r in range(rounds):
        # a list proposes pairs with one member, another one each round; a class tests its best three, and stays in its lists
        heads = lists.groupBy("value").agg(F.count("*").alias("m"), *[F.min_by(c, F.xxhash64("value", "cid", F.lit(r))).alias(n) for c, n in (("cid", "a"), ("label", "a_label"))])
        heads = cut(heads.filter("m > 1"))
        asked = hot_keys(heads.groupBy("a").agg(F.sum("m").alias("n")), ["a"])
        star = spread_join(lists, heads.drop("m"), ["value"], ["cid"], hot=frequent).filter("label <> a_label").select("a", F.col("cid").alias("b")).distinct()
        ranked = estimated(star, classes, k, percent, asked).selectExpr("a", "b", "row_number() over (partition by b order by j desc, a) as r").filter("r <= 3")
        ranked = cut(ranked.select("a", "b"))
        sets = sets_of(ranked.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), named, docs, text, size)
        found = cut(confirmed(ranked, sets, percent, asked))
        new = found.isEmpty()
        if not new:
            links = found if labels is None else found.unionByName(labels.select(F.col("cid").alias("a"), F.col("label").alias("b")))
            labels = cut(components(links))
            lists = lists.drop("label").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        # only members with a like one in another component in their list can have a link left
        lists = cut(with_alike(lists if r else lists.join(info, "cid"), percent, frequent))
        if new or lists.isEmpty():
            break

    held = lists.groupBy("value").agg(F.count("*").alias("m"), F.min("cid").alias("first"))
    top = lists.groupBy("value", "label").agg(F.count("*").alias("c")).groupBy("value").agg(F.max(F.struct("c", "label")).alias("t"))
    about = held.join(top, "value").select("value", "m", F.when(F.col("t.c") > 1, F.col("t.label")).otherwise(F.col("first")).alias("gid"), F.when(F.col("t.c") > 1, F.col("t.label")).alias("main"))
    lists = cut(spread_join(lists, about, ["value"], ["cid"], hot=frequent))
    short, long = lists.filter(F.col("m") <= short_list), lists.filter(F.col("m") > short_list)
    side = lambda p: short.select(F.col("value").alias(f"{p}_value"), *[F.col(c).alias(f"{p}_{c}") for c in ("cid", "label", *marks)])
    pairs = side("a").join(side("b"), (F.col("a_value") == F.col("b_value")) & (F.col("a_cid") < F.col("b_cid")) & (F.col("a_label") != F.col("b_label")) & _alike("a_", "b_", percent))
    pairs = cut(estimated(pairs.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct(), classes, k, percent).select("a", "b"))
    members = cut(long.groupBy("gid", "cid", "label").agg(F.max(~F.col("label").eqNullSafe(F.col("main"))).alias("outside")))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(members.select("cid")).distinct()
    sets = sets_of(needed, named, docs, text, size)
    more = confirmed(pairs, sets, percent).unionByName(_blocks(members, info.select("cid", "n"), sets, percent))
    if labels is not None:
        more = more.unionByName(labels.select(F.col("cid").alias("a"), F.col("label").alias("b")))
    labels = cut(components(more))

    grouped = cut(named.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    of_component = hot_keys(least, ["label"])
    least = spread_join(grouped.select("label", "cid", "digest"), least.drop("n"), ["label"], ["cid"], hot=of_component).select("digest", "component_id")
    found = spread_join(rows.filter("n > 0").select("doc_id", "cid", "n", "digest"), least, ["digest"], ["cid"], hot=crowds).select("doc_id", "n", "component_id")
    found = found.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    out = cut(found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")))
    drop_path(spark, path)
    return out


def near_dedup(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_groups` keeps, with all their columns and whatever their names.

    Of each group the smallest doc_id stays, of whatever type it is; every row that has it stays if one of them does. Texts without
    words (null, empty, blank) are linked with nothing and all stay, as does a row without doc_id whose group has no other id.
    """
    found = near_groups(docs, text, size, percent)
    (id_,) = unused(docs.columns, "id")
    gone = small(cut(found.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select(F.col("doc_id").alias(id_))))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(id_)), "left_anti")


def op10_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_groups` of all ``documents`` on two-word shingles; what it says of nulls, ties and repeated rows holds."""
    return near_groups(table(spark, sf_dir, "documents"), size=2)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM ov JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a AS x, b AS y FROM ln UNION SELECT b, a FROM ln),
r(id, c) AS (SELECT x, x FROM e UNION SELECT y, c FROM r JOIN e ON x = id),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.c, w.doc_id) AS component_id, w.doc_id = coalesce(k.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.id = w.doc_id
"""
