"""The corpus pipeline: quality, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns pieces.
Extra columns, whatever their names, are passed on. Null and empty texts are scored by the first stage as they are; the others
keep them. Very long texts are read whole, repeated rows are taken each, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import neardup, packing, pii, quality
from tessera.llm.queries import QUALITY_LEAST, pii_key
from tessera.session import materialised, prepare, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is QUALITY_LEAST or more; the classifier learns from the labels of the documents at hand."""
    prepare(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"), QUALITY_LEAST).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that near copies (five words, 0.8) connect."""
    prepare(spark)
    return neardup.keep_one(docs).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for their PII; n_chars follows the new text."""
    prepare(spark)
    changed = pii.pseudonymise(docs, pii_key(spark), replaced=None)
    return changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: SQL can't express the stages; tests/llm/test_queries.py compares run() with plain Python, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
