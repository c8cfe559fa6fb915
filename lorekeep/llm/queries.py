"""The registered queries of the pipeline's operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.llm import bit_packing, decontaminate, html_text, licenses, lm_scoring, mixing, near_dedup, pii, prefix_trie, quality, suffix_dedup, tokens, whitening
from lorekeep.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select("doc_id", "source", mixing.sizes().alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"), "host_bad",
    )


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main(table(spark, folder, "pages"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents")).drop("spans")


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_bit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = scratch_path(spark, "token-files")
    return bit_packing.token_files(table(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_dedup,
        op2_mixing,
        op3_tokens,
        op4_pii,
        op5_quality,
        op6_html_text,
        op7_decontaminate,
        op8_licenses,
        op9_near_dedup,
        op10_lm_scores,
        op11_prefix_trie,
        op12_whitening,
        op13_bit_packing,
    )
}
