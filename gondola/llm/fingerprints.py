"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Shingle hashes are binned once; the least of each bin is kept. An empty bin takes the
value of the first filled bin along its own fixed random order of all bins (optimal
densification).
Of each value only the low bits are stored; equal bits by chance are corrected for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.hashing import SLICE_BYTES, mix, shingle_hashes, word_hashes, worker_value

BINS, BITS, WORDS = 256, 4, 5


def _sequences() -> np.ndarray:
    """A random order of all bins for each bin."""
    return worker_value("densify", lambda: np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)).reshape(BINS, BINS), axis=1))


def _sources(empty: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """For each empty bin the first filled one in its order; looked for in ever longer parts of the orders."""
    out = np.full(len(empty), -1)
    at, width = 0, 8
    while (open_ones := np.flatnonzero(out < 0)).size:
        part = _sequences()[empty[open_ones], at : at + width]
        hit = filled[part]
        done = hit.any(axis=1)
        out[open_ones[done]] = part[done, hit[done].argmax(axis=1)]
        at, width = at + width, 2 * width
    return out


def fingerprint(words: np.ndarray) -> np.ndarray:
    """Low-order bits of each bin for one text's word hashes; no words: an empty array."""
    h = shingle_hashes(words, WORDS)
    if not len(h):
        return np.empty(0, np.uint8)
    shift = np.uint64(64 - int(np.log2(BINS)))
    first = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << shift)
    filled = np.append(first[1:], len(h)) > first
    if not filled.all():
        empty = np.flatnonzero(~filled)
        first[empty] = first[_sources(empty, filled)]
    return (mix(h[first]) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(bits: np.ndarray) -> str:
    """Hexadecimal digits, one a bin."""
    return ((bits[0::2] << 4) | bits[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; equal bits by chance (one in 2**BITS) taken off. Two empty ones are alike, one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 1 / (1 << BITS)
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def of_texts(texts: list[str]) -> list[np.ndarray]:
    hashes, first = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    return [fingerprint(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _described(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for _, t, after in pairs]
    own = of_texts([t for _, t, _ in pairs] + [pairs[-1][2]])
    # pairs follow one another mostly, so that the next text's fingerprint is there already
    following = [own[i + 1] if i + 1 == len(pairs) or pairs[i + 1][1] is after else of_texts([after])[0] for i, (_, _, after) in enumerate(pairs)]
    changed = of_texts(edited)
    cols = [
        pa.array([d for d, _, _ in pairs], pa.int64()),
        pa.array([len(t) for _, t, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array([packed(x) for x in own[:-1]], pa.string()),
        pa.array([packed(x) for x in changed], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, following, strict=False)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt into ranges of the id, in order: _dest, _extra, doc_id, text; the first row of the following range stands at each range's end as an extra.

    Null ids come first; rows of one id go by a hash of the text. Cut points are quantiles
    of the ids; an id that is several cut points has its rows dealt by that hash into as
    many ranges. Cut points and the ranges' first rows (id and hash) go through the
    driver: both as many as there are ranges. Rows that are alike in id and text meet in one range.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_k"), F.xxhash64(text).alias("_order"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = rows.select("_k").approxQuantile("_k", [i / (4 * parts) for i in range(1, 4 * parts)], 0.1 / (4 * parts)) or [0]
    cuts, times = np.unique(np.array(points).astype(np.int64), return_counts=True)
    # the ranges before, and at each cut: its own id's rows, then the ids up to the next one
    first = np.concatenate([[0], 1 + np.cumsum(np.where(times > 1, times + 1, 1))])

    def ranges(k: np.ndarray, order: np.ndarray) -> np.ndarray:
        at = np.searchsorted(cuts, k, side="right")
        n = np.where(at > 0, times[at - 1], 1)
        own = (at > 0) & (n > 1) & (cuts[at - 1] == k)
        share = ((order.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * n >> 32
        base = np.where(at > 0, first[at - 1], 0)
        return np.where(own, base + share, base + np.where((at > 0) & (n > 1), n, 0)).astype(np.int32)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series(ranges(k.to_numpy(), order.to_numpy()))

    heads = sorted((r["_r"], tuple(r["_least"])) for r in rows.groupBy(range_of("_k", "_order").alias("_r")).agg(F.min(F.struct("_k", "_order")).alias("_least")).collect())
    before = {least: heads[i - 1][0] for i, (_, least) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def destinations(k: pd.Series, order: pd.Series) -> pd.Series:
        own = ranges(k.to_numpy(), order.to_numpy()).tolist()
        return pd.Series([[r, -1 - before[x]] if x in before else [r] for r, x in zip(own, zip(k.tolist(), order.tolist(), strict=True), strict=True)])

    dealt = rows.withColumn("_to", F.explode(destinations("_k", "_order")))
    dealt = dealt.withColumn("_dest", F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to"))).withColumn("_extra", F.col("_to") < 0).drop("_to")
    return dealt.repartition(parts, "_dest").sortWithinPartitions("_dest", "_extra", "_k", "_order", "text").select("_dest", "_extra", "doc_id", "text")


def describe(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has its last quarter replaced by as many characters from the beginning
    of the next document (after the last: the first; a lone document follows itself). Null
    texts are empty; texts without words have the empty fingerprint. Rows with null ids come
    first, and rows that repeat an id follow one another by a hash of the text; each has a row.
    """

    def run(batches):
        last, pairs, size = None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for dest, extra, d, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    t = t or ""
                    if last is not None and last[0] == dest:
                        pairs.append((last[1], last[2], t))
                        size += len(t)
                    last = None if extra else (dest, d, t)
                    if size >= SLICE_BYTES:
                        yield _described(pairs)
                        pairs, size = [], 0
        if pairs:
            yield _described(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, doc_id, text).mapInArrow(run, schema)
