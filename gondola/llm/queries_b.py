"""Queries op3, op4 and op7 over the test tables, native operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import mixing, secrets, urls
from gondola.llm.frames import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, F.col("doc_id")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    counts = [secrets.number_of(F.col("secrets"), k).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.described(base), 256).alias("base_sha256"), secrets.described(F.col("secrets")).alias("spans"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")
