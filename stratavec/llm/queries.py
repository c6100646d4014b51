"""The queries of this subpackage for the driver's contract, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, tokens, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), 2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=5, held=0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked_by_distance(_read(spark, sf_dir, "documents"), words=3, distance=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_read(spark, sf_dir, "pages"), common.new_path(spark, "warc"), min_bytes=0)
    return index.rows().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judged(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_read(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_read(spark, sf_dir, "documents"), length=100)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_read(spark, sf_dir, "embeddings"), 256)
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=3, held=1)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_simhash_near_dedup, op4_warc, op5_token_counts, op6_quality_rules, op7_byte_bpe,
        op8_suffix_array_dedup, op9_exact_top_k, op10_quality_classifier,
    )
}
SQL: dict[str, str] = {"op4_warc": warc.SQL, "op6_quality_rules": quality_rules.SQL, "op9_exact_top_k": topk.SQL}
