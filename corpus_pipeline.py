"""A training-corpus pipeline over ``documents``: each stage's rows are written as Parquet and read again for the next.

Quality rules drop what they reject; of each component of near-duplicates one document stays; secrets
are redacted; sources are mixed to their targets, so that documents repeat or go; the texts are
encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import jaccard, mixing, rules, secret_scan, tokenizer
from tidewater.llm.shared import remove, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule; null and empty texts go, repeated rows share a fate, columns stay."""
    return rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, and those with null ids that link with none; columns stay."""
    return jaccard.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts redacted; a null text stays null."""
    return secret_scan.redact(docs, secret_scan.learn(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix reads them, in training order; every row is a document of its own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, token counts and digests; a null text has no tokens."""
    import public_tokenizers

    return tokenizer.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: Connected components of near-duplicates and the inferred secret formats are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``. A stage's folder goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
