"""A training corpus from the documents table, one operator after the other.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its
result is written and read again before the next one starts. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, near_dup, quality, substrings
from corvane.llm.common import read_table, tokenizer_path, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality ranking rejects go."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays."""
    return near_dup.deduplicated(docs, near_dup.AT_80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; a text without a word goes, a null one stays."""
    cut = substrings.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document left."""
    ids = bpe.encoded(docs, tokenizer_path())
    return ids.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The first three stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
