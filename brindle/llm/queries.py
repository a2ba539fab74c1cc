"""One query per operator, over its whole table, in the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.tables import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quality import judged

    return judged(table(spark, sf_dir, "documents"), [F.col("doc_id")]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.urls import url_filter

    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.languages import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = predict(docs, train(docs.where(F.coalesce(~held_out, F.lit(False)))))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.pii import pseudonymized

    done = pseudonymized(table(spark, sf_dir, "documents"))
    return done.select("__row.doc_id", F.col("__text").alias("text"), F.col("__n").alias("n_replaced"))


def op11_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.alignment import alignment_digest

    return alignment_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.fingerprints import neighbours

    return neighbours(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_html_extraction, op3_quality_rules, op4_url_filters, op5_token_counts, op6_language_id, op7_packing, op8_suffix_array_dedup, op9_pii,
        op10_ngram_jaccard_join, op11_variant_groups, op12_tokenizer_alignment, op13_document_fingerprints,
    )
}
