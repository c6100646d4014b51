"""A corpus from raw documents to packed sequences: classify, filter, drop near copies, cut repeats, pack.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavec.llm import common, packing, quality_classifier, quality_rules, simhash, suffix_dedup, tokens


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, accepts."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what they repeat, 100 bytes or more, of earlier ones or themselves."""
    return suffix_dedup.shortened(docs, length=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("simhash near-dedup", distinct),
    ("suffix-array dedup", unrepeated),
    ("best-fit packing", packed),
]

#: Tokenizers, hashes and a trained network aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
