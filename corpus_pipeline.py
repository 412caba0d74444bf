"""A training-data pipeline over documents: language ID, near-dedup, secret scans, mixing, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents. Rows with null or wordless texts go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import bpe, langid, mixing, nearduplicates, secrets
from gondola.llm.frames import cut, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language with a smaller posterior is not accepted.
LEAST_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a determined language; fills in a missing lang."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), F.col("doc_id"))
    judged = langid.identify(docs.select(*COLUMNS), model)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, similarity 0.8).

    It is the row with the least doc_id, a null one last; of rows that repeat it, any one.
    Rows are told apart by their number, so that a doc_id may be null, repeated or shared by different texts.
    """
    rows = cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = nearduplicates.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    groups = cut(found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row"), "groups")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least"))
    gone = cut(groups.join(kept, "component_id").where("_row <> least._row").select("_row"), "gone")
    return rows.join(small(gone), "_row", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET]; n_chars follows."""
    found = secrets.scan(docs.select(*COLUMNS))
    masked = found.withColumn("text", secrets.masked(F.col("text"), F.col("secrets")))
    return masked.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source's words meet its target."""
    mixed = mixing.mix(docs.select(*COLUMNS), F.col("doc_id"))
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens, with digests of them and of the decoded text."""
    encoded = bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), ids=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", languages),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", token_ids),
]

#: SQL can't express naive Bayes scores, MinHash and BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
