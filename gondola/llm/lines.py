"""Quality rules: base statistics of each document, and cross-document line frequency within a host.

Lines are normalised and hashed, and the documents that hold each are counted per
host, with partial counts before the shuffle. Lines in more documents than the limit
are removed; a document of which too little remains is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.llm.frames import WORD, cut, small
from gondola.llm.hashing import WHITE_BYTES, mix, slices, word_hashes

#: A line in more documents of its host, and more than this part of them in a thousand, is removed.
MOST_DOCUMENTS, MOST_PER_THOUSAND = 10, 1
#: A document with fewer words fails.
LEAST_WORDS = 20
#: A document is depleted with fewer words left, or a smaller share of its words.
LEAST_LEFT, LEAST_SHARE = 5, 0.3
SYMBOLS = "#*$%&|<>"
#: Words of the windows whose repeats within a text count.
WINDOW = 8
LINE_PARTS = {"from": "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "to": "abcdefghijklmnopqrstuvwxyz000000000"}


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of WINDOW words that the text has twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j])
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE_BYTES.decode())]
    return len(lines) - len(set(lines))


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null texts have none of anything, and fail. Columns of clashing names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = df.drop(*names, "base_failed")
    schema = T.StructType([*df.schema, *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for part, raw in slices(batch, text):
                raw = [t or b"" for t in raw]
                hashes, first = word_hashes(raw)
                texts = [t.decode("utf-8", "replace") for t in raw]
                n = np.diff(first)
                chars = np.array([len(t) - sum(t.count(chr(c)) for c in WHITE_BYTES) for t in texts], np.int64)
                symbols = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)
                lines = np.array([repeated_lines(t) for t in texts], np.int64)
                again = np.array([repeated_words(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
                failed = (n < LEAST_WORDS) | (100 * again > 30 * n)
                cols = [pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, again)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols, pa.array(failed)], [*part.schema.names, *names, "base_failed"])

    return df.mapInArrow(run, schema)


def normalised(line: Column) -> Column:
    """Words joined by one space, A-Z lower-cased, digits as 0."""
    return F.translate(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), LINE_PARTS["from"], LINE_PARTS["to"])


def hashed_lines(text: Column) -> Column:
    """Array of (place, hash, words) of the text's lines that have a word; null: empty."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("place"), F.xxhash64(normalised(x)).alias("hash"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    return F.filter(lines, lambda x: x["words"] > 0)


def frequent_lines(lines: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """host, hash of the lines in more than most rows of a host and MOST_PER_THOUSAND of them; lines: host, lines (hashed_lines)."""
    sizes = cut(lines.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("rows")), "hosts")
    each = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    often = each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return often.join(small(sizes), F.col("host") == F.col("_host")).where(1000 * F.col("n") > MOST_PER_THOUSAND * F.col("rows")).select("host", "hash")


def judge(df: DataFrame, host: str = "source", text: str = "text", most: int = MOST_DOCUMENTS) -> DataFrame:
    """All rows and columns but the text, with the base statistics, words_removed, removed (places of removed lines) and kept.

    A row counts as a document, so repeated rows count each. The null host is a host of its
    own. kept is false for base_failed and for depleted documents. Columns of clashing names
    are replaced.
    """
    df = df.drop("words_removed", "removed", "kept")
    with_lines = base_statistics(df.withColumn("_host", F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))), text)
    rows = cut(with_lines.withColumn("_lines", hashed_lines(F.col(text))).drop(text).withColumn("_row", F.monotonically_increasing_id()), "lines")
    frequent = cut(frequent_lines(rows.select(F.col("_host").alias("host"), F.col("_lines").alias("lines")), most), "frequent")
    each = rows.select("_row", F.col("_host").alias("host"), F.explode("_lines").alias("x")).select("_row", "host", "x.*")
    removed = each.join(small(frequent), ["host", "hash"]).groupBy("_row").agg(F.sum("words").alias("words_removed"), F.array_sort(F.collect_list("place")).alias("removed"))
    out = rows.drop("_lines").join(removed, "_row", "left")
    out = out.withColumn("words_removed", F.coalesce("words_removed", F.lit(0))).withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.col("n_words") - F.col("words_removed")
    depleted = (left < LEAST_LEFT) | (left < LEAST_SHARE * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_row", "_host")


def cleaned(text: Column, removed: Column) -> Column:
    """The text without the lines at the removed places."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i)), "\n")
