"""Queries op1 and op6 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import fingerprints, lines
from gondola.llm.frames import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.describe(table(spark, sf_dir, "documents").select("doc_id", "text"))
