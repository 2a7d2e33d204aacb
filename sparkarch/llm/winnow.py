"""Benchmark decontamination by winnowing.

Texts are read as words. Of every window of ``window`` hashes of ``k`` consecutive words the smallest is kept (of equal ones the
leftmost), in documents and items alike. Two texts that share ``k + window - 1`` words in a row hence share a kept hash at the
same place of that stretch. Document and item hashes are joined, and each hit is extended to both sides, word by word, to the
whole stretch that the two share. Only DataFrame functions run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, small, spread_join, table, unused, words

K, WINDOW = 5, 6
#: The place of a hash in its text takes the lower bits of a packed value, the hash the 32 above.
PLACE_BITS = 31


def _packed(size: int) -> str:
    """Hash and place of each run of ``size`` words of the array ``w``."""
    args = ", ".join(f"w[i + {j}]" for j in range(size))
    return f"CASE WHEN size(w) >= {size} THEN transform(sequence(0, size(w) - {size}), i -> shiftleft(cast(hash({args}) as bigint) & 4294967295, {PLACE_BITS}) | i) ELSE cast(array() as array<bigint>) END"


def _winnowed(k: int, window: int) -> str:
    """What winnowing keeps of the packed values ``g``; a text with fewer than ``window`` hashes has one window."""
    each = ", ".join(f"g[i + {j}]" for j in range(window))
    least = f"least({each})" if window > 1 else "g[i]"
    return f"CASE WHEN size(g) >= {window} THEN array_distinct(transform(sequence(0, size(g) - {window}), i -> {least})) WHEN size(g) > 0 THEN array(array_min(g)) ELSE g END"


def _hash(packed: str) -> Column:
    return F.shiftright(F.col(packed), PLACE_BITS)


def _place(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


#: Up to so many item hashes stand in the plan itself, as a set; beyond, the documents' hashes are joined.
SET_HASHES = 20_000


def _around(kind: str, p: str, words_: str, reach: int, span: int) -> str:
    """Kind, packed value, and the words that a shared window around the hash can reach, with the place where they begin."""
    place = f"cast({p} & {(1 << PLACE_BITS) - 1} as int)"
    first = f"greatest(0, {place} - {reach})"
    return f"CASE WHEN {kind} = 0 THEN struct({kind} as kind, {p} as p, {first} as begin, slice({words_}, {first} + 1, {place} + {span} - {first}) as s) ELSE struct({kind} as kind, {p} as p, {place} as begin, slice({words_}, {place} + 1, {kind}) as s) END"


def _item_prints(benchmark: DataFrame, span: int, item_text: str, k: int, window: int) -> tuple[DataFrame, list[int]]:
    """Kept hashes of the items, kind 0, and the hash of every whole shorter item, its kind its number of words; those numbers.

    Each has the item's words around it, as many as a document's hash has.
    """
    items = benchmark.select("item_id", words(F.col(item_text)).alias("w")).filter("size(w) > 0")
    n = F.size("w")
    short = sorted(r["n"] for r in items.filter(n < span).select(n.alias("n")).distinct().collect())  # under span numbers
    parts = [items.filter(n >= span).withColumn("g", F.expr(_packed(k))).select("item_id", F.explode(F.expr(f"transform({_winnowed(k, window)}, p -> {_around('0', 'p', 'w', span - k, span)})")).alias("f"))]
    parts += [items.filter(n == size).select("item_id", F.explode(F.expr(f"transform({_packed(size)}, p -> {_around(str(size), 'p', 'w', span - k, span)})")).alias("f")) for size in short]
    prints = reduce(DataFrame.unionByName, [x.select("item_id", F.col("f.kind").alias("item_kind"), _hash("f.p").alias("item_hash"), _place("f.p").alias("item_place"), F.col("f.begin").alias("item_begin"), F.col("f.s").alias("item_s")) for x in parts])
    return cut(prints), short


def _met(docs: DataFrame, benchmark: DataFrame, span: int, text: str, item_text: str, k: int, window: int, set_hashes: int, broadcast_rows: int | None) -> DataFrame:
    """``doc_id``, ``d1``, ``d2``, ``n_words``, ``item_id``, ``shift``, ``start``, ``length``: a row without an item for each document, and one for each hash that it shares with an item."""
    if k + window - 1 > span:
        raise ValueError("k + window - 1 must not be more than span")
    prints, short = _item_prints(benchmark, span, item_text, k, window)
    near = few(prints, broadcast_rows)
    body = F.col(text)
    rows = docs.select("doc_id", F.xxhash64(body, F.lit(1)).alias("d1"), F.xxhash64(body, F.lit(2)).alias("d2"), words(body).alias("w")).withColumn("g", F.expr(_packed(k)))
    key = ["doc_id", "d1", "d2"]
    kinds = [(0, _winnowed(k, window)), *((n, _packed(n)) for n in short)]
    around = lambda kind, p: _around(kind, p, "w", span - k, span)
    none = "struct(-1 as kind, cast(0 as bigint) as p, 0 as begin, cast(array() as array<string>) as s)"  # every document has this one
    items = prints.select(F.col("item_hash").alias("hash"), F.col("item_kind").alias("kind")).distinct()
    if near and items.count() <= set_hashes:
        held: dict[int, list[int]] = {}
        for r in items.collect():  # at most set_hashes
            held.setdefault(r["kind"], []).append(r["hash"])
        for i, (kind, kept) in enumerate(kinds):
            listed = ", ".join(f"{h}L" for h in sorted(held.get(kind, [])))
            rows = rows.withColumn(f"f{i}", F.expr(f"filter({kept}, p -> shiftright(p, {PLACE_BITS}) IN ({listed}))" if listed else "cast(array() as array<bigint>)"))
        found = ", ".join(f"transform(f{i}, p -> {around(str(kind), 'p')})" for i, (kind, _) in enumerate(kinds))
        flat = rows.select(*key, F.size("w").cast("long").alias("n_words"), F.explode(F.expr(f"concat(array({none}), {found})")).alias("f"))
    else:
        parts = ", ".join(f"transform({kept}, p -> struct({kind} as kind, p as p))" for kind, kept in kinds)
        hashes = rows.select(*key, F.explode(F.expr(f"concat({parts})")).alias("f")).select(*key, "f.kind", "f.p").withColumn("hash", _hash("p"))
        common = hashes.join(F.broadcast(items), ["hash", "kind"], "left_semi") if near else spread_join(hashes, items, ["hash", "kind"], [*key, "p"], "left_semi")
        common = cut(common.groupBy(*key).agg(F.collect_set(F.struct("kind", "p")).alias("f")))  # no more than a document's own hashes
        named = small(common.select(*[F.col(c).alias(f"c_{c}") for c in key], "f"), broadcast_rows)
        flat = rows.join(named, F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("d1") == F.col("c_d1")) & (F.col("d2") == F.col("c_d2")), "left")
        found = f"coalesce(transform(f, x -> {around('x.kind', 'x.p')}), cast(array() as array<struct<kind: int, p: bigint, begin: int, s: array<string>>>))"
        flat = flat.select(*key, F.size("w").cast("long").alias("n_words"), F.explode(F.expr(f"concat(array({none}), {found})")).alias("f"))
    flat = flat.select(*key, "n_words", "f.kind", "f.p", "f.begin", "f.s").withColumn("hash", _hash("p"))
    theirs = prints.withColumnsRenamed({"item_hash": "hash", "item_kind": "kind"})
    if near:
        met = flat.join(F.broadcast(theirs), ["hash", "kind"], "left").filter("kind = -1 or item_s is not null")
    else:
        flat = cut(flat)  # a row for each document, and one for each hash that is an item's too
        met = spread_join(flat.filter("kind >= 0"), theirs, ["hash", "kind"], [*key, "p"])
        met = met.unionByName(flat.filter("kind = -1"), allowMissingColumns=True)
    met = met.withColumn("place", _place("p")).withColumn("shift", F.col("place") - F.col("item_place"))
    # the stretch around the hash where document and item agree
    stretch = F.expr(
        """CASE WHEN kind >= 0 THEN named_struct(
          'first', coalesce(array_max(filter(sequence(greatest(begin, item_begin + shift), place), i -> s[i - begin] <> item_s[i - shift - item_begin])), greatest(begin, item_begin + shift) - 1) + 1,
          'last', coalesce(array_min(filter(sequence(place, least(begin + size(s), item_begin + size(item_s) + shift) - 1), i -> s[i - begin] <> item_s[i - shift - item_begin])), least(begin + size(s), item_begin + size(item_s) + shift)) - 1) END"""
    )
    met = met.withColumn("t", stretch).filter(f"kind = -1 or t.last - t.first + 1 >= CASE WHEN kind = 0 THEN {span} ELSE kind END")
    return met.select(*key, "n_words", "kind", "item_id", "shift", F.col("t.first").alias("start"), (F.col("t.last") - F.col("t.first") + 1).alias("length"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, text: str = "text", item_text: str = "text", k: int = K, window: int = WINDOW, set_hashes: int = SET_HASHES, broadcast_rows: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``d1`` and ``d2`` (hashes of its text), ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings).

    A hit word lies inside ``span`` consecutive words that some item holds too, or inside the whole of an item of fewer words;
    :func:`shared_stretches` says where. ``k + window - 1`` is at most ``span``, so no window is missed; shorter items are looked up
    by all their words.

    Where the items' hashes are counted to be few, the documents are read once and each is filtered by the set of hashes where
    it is read: a document sends one row, and one of ``2 * span - k`` words for each hash that an item has too. Beyond that, the
    hashes are joined (items broadcast if few, else by an exchange that splits frequent hashes) and documents with a hash in
    common are read again. What is kept of a document are its distinct stretches, which its own length bounds, and its items' ids.
    Null and empty texts have no words and no hits, items without words match nothing, an item without id marks words but has no
    place among the ids, an empty benchmark leaves every document clean; repeated rows give a row each, and rows that share a doc_id
    but not a text are told apart. Other columns of ``docs`` aren't read.
    """
    met = _met(docs, benchmark, span, text, item_text, k, window, set_hashes, broadcast_rows)
    key = ["doc_id", "d1", "d2"]
    hit = F.when(F.col("kind") >= 0, F.struct("start", "length"))
    one = met.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count_if(F.col("kind") == -1).alias("copies"), F.collect_set(hit).alias("hits"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    hit_words = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    return one.select(*key, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "n_words", hit_words.cast("long").alias("n_hit"), F.array_sort("ids").alias("item_ids")).drop("copy")


def shared_stretches(docs: DataFrame, benchmark: DataFrame, span: int = 10, text: str = "text", item_text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per stretch of words that a document and an item share: ``doc_id``, ``d1``, ``d2``, ``item_id``, ``shift``, ``start``, ``length``.

    Each is extended around a hash as far as a shared window with that hash can reach; ``shift`` is the start in the document less
    that in the item, and stretches of one item and shift that touch are parts of one shared passage. Documents without any have no
    row; what :func:`contamination` says of nulls and short items holds.
    """
    met = _met(docs, benchmark, span, text, item_text, k, window, SET_HASHES, None)
    return met.filter("kind >= 0").drop("kind", "n_words").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have no hit, with all their columns and whatever their names.

    Null and empty texts stay; of rows that share a doc_id, of whatever type, each goes or stays by its own text.
    """
    id_, d1, d2 = unused(docs.columns, "id", "d1", "d2")
    found = contamination(docs, benchmark, text=text).filter("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("d1").alias(d1), F.col("d2").alias(d2))
    gone = small(cut(found.distinct()))
    body = docs[text]
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(body, F.lit(1)) == F.col(d1)) & (F.xxhash64(body, F.lit(2)) == F.col(d2)), "left_anti")


def op4_winnowing_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`contamination` of all ``documents`` by all ``benchmark`` items, its ids as a count and a digest; nulls and repeated rows as there."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
hits AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d
  JOIN win ON win.s = d.s AND win.n = d.n),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per ON per.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
