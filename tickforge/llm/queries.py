"""The ``opN_<name>`` queries: each operator, production parameters, whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import (
    conversations,
    decontaminate,
    hilbert,
    line_dedup,
    ngram_join,
    packing,
    quality_knn,
    quality_rules,
    spelling,
    suffix_dedup,
    token_counts,
    url_filter,
    warc,
)
from tickforge.llm.store import scratch, table

TOKENIZER = "piece_bpe_32k.model"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_count(F.col("text")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                        (F.col("n_removed") > 0).alias("has_repeats"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_text(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "fail_bits")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = hilbert.shard_table(table(spark, sf_dir, "documents"))
    return put.select("doc_id", "size", "text_crc32", "law", "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    harmed = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digest(conversations.repair(harmed))


def queries() -> dict:
    found = (op1_benchmark_decontamination, op2_best_fit_packing, op3_url_filter,
             op4_suffix_array_dedup, op5_line_dedup, op6_quality_classifier, op7_ngram_jaccard,
             op8_warc, op9_quality_rules, op10_token_counts, op11_hilbert_sharding, op12_spelling_variants,
             op13_conversation_repair)
    return {f.__name__: f for f in found}
