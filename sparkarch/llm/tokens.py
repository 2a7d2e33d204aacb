"""Encoding of whole texts by a public tokenizer, with a bounded cache of words, and the exact length histogram."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table, worker_cache

#: A worker keeps the ids of so many words, and of as many that it met before those.
CACHE_WORDS = 400_000
#: White space to Python's split() but ordinary characters to the tokenizer; letters whose small form isn't one for one; and
#: what a special token may begin with. Texts with any of these are encoded whole.
_ODD = re.compile(r"[\x1c-\x1f\u03a3\u0130]|<\|")
#: Words of small Latin letters; and punctuation that ends a word of letters: the tokenizer splits there too.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_END = re.compile(r"(?<=[a-zß-öø-ÿ])[!-&(-/:-@\[-^`{-~]+(?!\S)")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(spec: str):
    """The tokenizer of a JSON text. Threads stay off: each Spark task has one core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


class _Recent:
    """A dictionary of at most 2 x size entries that forgets those not asked for lately."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Keys that aren't known; the others are in ``new`` from now on."""
        unknown = keys - self.new.keys()
        if len(self.new) + len(unknown) > self.size:
            self.old, self.new = self.new, {}
            unknown = keys
        back = self.old.keys() & unknown
        self.new.update((k, self.old[k]) for k in back)
        return list(unknown - back)


class WordEncoder:
    """Encodes texts word by word, for tokenizers that take small letters only, drop white space and never join what it separates.

    Texts are put into small letters and closing points and commas set apart, which changes no id, so that case and punctuation
    don't multiply the words. New words of letters are encoded together, as one text: each ends with its only token of an end of
    word. Words are kept as the bytes of their ids (little-endian, 32 bits), and a text is their concatenation.

    Another kind of tokenizer is refused.
    """

    def __init__(self, spec: str, size: int = CACHE_WORDS) -> None:
        kind = json.loads(spec)
        normal = kind["normalizer"] or {}
        if kind["model"].get("end_of_word_suffix") != "</w>" or not any(n["type"] == "Lowercase" for n in normal.get("normalizers", [normal]) if n):
            raise ValueError("only tokenizers that take small letters and mark the ends of words (</w>) can be read word by word")
        self.tokenizer, self.words = load_tokenizer(spec), _Recent(size)
        self.step = max(1 << 16, 15 * size)  # characters whose new words are worked out together
        # plain words need neither normalising nor splitting
        plain = json.loads(spec) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}}
        self.plain = load_tokenizer(json.dumps(plain))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: set[str]) -> None:
        new = self.words.missing(words)
        found, letters = self.words.new, [w for w in new if w.isalpha()]
        plain, other = [], []
        for w in letters:
            (plain if _PLAIN.fullmatch(w) else other).append(w)
        for words, tokenizer in ((plain, self.plain), (other, self.tokenizer)):
            for i in range(0, len(words), 16_000):
                self._learn_letters(words[i : i + 16_000], tokenizer)
        if len(letters) < len(new):
            others = [w for w in new if not w.isalpha()]
            for i in range(0, len(others), 1000):
                some = others[i : i + 1000]
                for word, encoded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    found[word] = np.array(encoded.ids, dtype="<u4").tobytes()

    def _learn_letters(self, words: list[str], tokenizer) -> None:
        ids, found = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4"), self.words.new
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) == len(words) and stops[-1] == 4 * len(ids):
            data, at = ids.tobytes(), 0
            for word, stop in zip(words, stops.tolist(), strict=True):
                found[word] = data[at:stop]
                at = stop
        else:  # a letter that the tokenizer takes for something else
            found.update((w, self._ids(w).tobytes()) for w in words)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        i = 0
        while i < len(texts):
            j, size, split = i, 0, []
            while j < len(texts) and size < self.step:
                size += len(texts[j])
                split.append(None if _ODD.search(texts[j]) else _END.sub(r" \g<0>", texts[j].lower()).split())
                j += 1
            if j == i + 1 and split[0] and size > 2 * self.step:  # a long text, some of its words at a time
                yield self._long(split[0])
            else:
                self._learn(set().union(*filter(None, split)))
                get = self.words.new.__getitem__
                for text, words in zip(texts[i:j], split, strict=True):
                    yield self._ids(text).tobytes() if words is None else b"".join(map(get, words))
            i = j

    def _long(self, words: list[str], step: int = 50_000) -> bytes:
        out = []
        for i in range(0, len(words), step):
            some = words[i : i + step]
            self._learn(set(some))
            out.append(b"".join(map(self.words.new.__getitem__, some)))
        return b"".join(out)


def encoded_batches(batches: Iterator[pa.RecordBatch], spec: str, column: str, words: int = CACHE_WORDS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches with the ids of their texts; a null text is empty. The worker's words outlive the task."""
    own = worker_cache(f"words {hash(spec)} {words}", lambda: WordEncoder(spec, words))
    for batch in slices(batches, max(250, words // 100)):
        yield batch, list(own.encode(["" if t is None else t for t in batch.column(column).to_pylist()]))


def length_histogram(docs: DataFrame, text: str = "text", spec: str | None = None, block: int = 4096) -> DataFrame:
    """The exact histogram of encoded lengths, with what every context limit would keep.

    One row per length L that occurs: ``length``, ``n_docs``; ``n_tokens`` in documents of just that length;
    ``docs_at_most`` and ``share_at_most`` (the quantile that L stands at); ``docs_over`` and ``tokens_over`` in longer
    documents; ``tokens_at_limit``: tokens left if every document were cut at L; ``tokens_lost`` by that.
    :func:`at_limit` answers limits that are not lengths. Null texts count as empty, of length 0; an empty table gives no
    row. Each task counts its own documents, so the exchange holds a row per task and length. Suffix sums run in blocks of
    lengths: one window within each block, one over the blocks' totals, which the longest text bounds, not the corpus.
    """
    spec = spec or open(tokenizer_file()).read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for _, ids in encoded_batches(batches, spec, "text"):
            for x in ids:
                seen[len(x) // 4] = seen.get(len(x) // 4, 0) + 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(seen.keys(), pa.int64()), "n_docs": pa.array(seen.values(), pa.int64())})

    counted = cut(docs.select(F.col(text).alias("text")).mapInArrow(count, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs")))
    counted = counted.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("__block", F.expr(f"length div {block}"))
    later = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("n_tokens").alias("__t"))
    blocks = blocks.select("__block", F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__docs"), F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__tokens"), F.sum("__d").over(Window.partitionBy()).alias("__all"), F.sum("__t").over(Window.partitionBy()).alias("__total"))
    inside = Window.partitionBy("__block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = counted.withColumns({"__d": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "__t": F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))}).join(blocks, "__block")
    over, tokens = F.col("__d") + F.col("__docs"), F.col("__t") + F.col("__tokens")
    kept = F.col("__total") - tokens + over * F.col("length")
    return out.select(
        "length", "n_docs", "n_tokens", (F.col("__all") - over).alias("docs_at_most"), F.round((F.col("__all") - over) / F.col("__all"), 9).alias("share_at_most"),
        over.alias("docs_over"), tokens.alias("tokens_over"), kept.alias("tokens_at_limit"), (F.col("__total") - kept).alias("tokens_lost"),
    )


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Documents, tokens and truncated totals for given context limits: ``context_limit``, ``docs_cut``, ``tokens_kept``, ``tokens_lost``."""
    over = [F.when(F.col("length") > x, F.col("n_docs")).otherwise(0) for x in limits]
    lost = [F.when(F.col("length") > x, F.col("n_docs") * (F.col("length") - x)).otherwise(0) for x in limits]
    one = histogram.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"), F.array(*[F.coalesce(F.sum(x), F.lit(0)) for x in over]).alias("o"), F.array(*[F.coalesce(F.sum(x), F.lit(0)) for x in lost]).alias("l"))
    rows = one.select("total", F.posexplode(F.arrays_zip(F.array(*[F.lit(x).cast("long") for x in limits]).alias("x"), "o", "l")).alias("i", "r"))
    return rows.select(F.col("r.x").alias("context_limit"), F.col("r.o").alias("docs_cut"), (F.col("total") - F.col("r.l")).alias("tokens_kept"), F.col("r.l").alias("tokens_lost"))


def quantile(histogram: DataFrame, q: float | str | Fraction) -> DataFrame:
    """``length``: the smallest that at least a share ``q`` of the documents does not exceed; null for an empty histogram.

    ``q`` is taken as the decimal that it prints as, and compared with whole numbers of documents, so no count is too large.
    """
    share = Fraction(str(q))
    whole = lambda x: x.cast("decimal(38,0)")
    enough = whole(F.col("docs_at_most")) * F.lit(share.denominator) >= whole(F.col("docs_at_most") + F.col("docs_over")) * F.lit(share.numerator)
    return histogram.filter(enough).agg(F.min("length").alias("length"))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`length_histogram` of all ``documents``; a null text has length 0."""
    return length_histogram(table(spark, sf_dir, "documents"))
