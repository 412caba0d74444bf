"""Queries op2 and op9 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import nearduplicates, suffixes
from gondola.llm.frames import table


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
