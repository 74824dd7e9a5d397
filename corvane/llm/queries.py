"""The registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, decontaminate, html_extract, near_dup, quality, rules, sharding, substrings, url_filter, warc
from corvane.llm.common import read_table, tokenizer_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measurements, failure bits and the verdict of WEB_V1."""
    ledger = rules.ledger(rules.measured(read_table(spark, sf_dir, "documents")))
    out = rules.judged(ledger, rules.WEB_V1)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_exclamations", "failed_bits")


def op2_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of WEB_V1 does to the documents, and what they would be without it."""
    return rules.ablations(rules.ledger(rules.measured(read_table(spark, sf_dir, "documents"))), rules.WEB_V1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates at 0.85."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), near_dup.AT_85)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(read_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut from every document because an earlier one holds it."""
    return substrings.report(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, encoded and decoded."""
    return bpe.report(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark."""
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.sharded(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's url."""
    return url_filter.judged(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_quality_rules,
        op3_warc,
        op4_near_duplicates,
        op5_html_text,
        op6_substring_dedup,
        op7_bpe,
        op8_decontamination,
        op9_sharding,
        op10_url_filter,
        op2_rule_ablations,
    )
}
