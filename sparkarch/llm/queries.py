"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bottomk, feistel, fingerprints, licenses, packing, quality, tokens, urls, warc, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        warc.op1_segmented_warc,
        licenses.op2_rare_word_licenses,
        urls.op3_host_words_bayes,
        winnow.op4_winnowing_contamination,
        feistel.op5_feistel_shards,
        packing.op6_sum_of_squares_packing,
        fingerprints.op7_polynomial_exact_dedup,
        quality.op8_fourier_quality,
        tokens.op9_length_histogram,
        bottomk.op10_bottom_k_near_duplicates,
    )
}
SQL: dict[str, str] = {
    "op1_segmented_warc": warc.OP1_SQL,
    "op2_rare_word_licenses": licenses.OP2_SQL,
    "op4_winnowing_contamination": winnow.OP4_SQL,
    "op7_polynomial_exact_dedup": fingerprints.OP7_SQL,
    "op10_bottom_k_near_duplicates": bottomk.OP10_SQL,
}
