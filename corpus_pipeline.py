"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

1. ``quality_classifier``: documents that the classifier rejects go.
2. ``exact_dedup``: of equal texts the row with the largest doc_id stays.
3. ``near_dedup``: of a group that near-duplicate links join (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.
4. ``decontaminate``: documents that share ten words in a row with a benchmark item go.
5. ``pack``: the rest is encoded and packed into sequences of at most 2048 tokens.

All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkarch.llm import bottomk, fingerprints, packing, quality, winnow
from sparkarch.llm.common import new_path, table
from sparkarch.shipping import ship


#: Words whose ids a worker keeps: executors that have run the other stages have less memory to spare.
CACHE_WORDS = 100_000


def _small_steps(spark: SparkSession) -> None:
    """Settings for long chains of stages: small batches to Python, and no shuffle files beyond their query."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7 for quality, with all their columns. Null and empty texts are scored as empty ones; repeated rows share their fate; no rows give no rows."""
    _small_steps(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id (null loses; null and empty texts count as one), with all its columns."""
    _small_steps(spark)
    return fingerprints.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id, with all its columns; texts without words all stay."""
    _small_steps(spark)
    return bottomk.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row, nor a whole shorter item, with the benchmark, with all their columns; null and empty texts stay."""
    _small_steps(spark)
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``; a null text is a piece of one id."""
    _small_steps(spark)
    return packing.pack(docs, cache_words=CACHE_WORDS, keep_words=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: A fitted classifier and a tokenizer decide which rows come out: no SQL can.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
