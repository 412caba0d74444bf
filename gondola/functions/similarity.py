"""The two vectorised helpers: token-set string similarity and the perceptual image hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the letters of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _common_letters(left: pd.Series, right: pd.Series) -> pd.Series:
    """_common of each two strings, once for equal ones of a batch."""
    seen: dict[tuple[str, str], int] = {}
    for pair in zip(left, right, strict=True):
        if pair not in seen:
            seen[pair] = _common(*pair)
    return pd.Series([seen[pair] for pair in zip(left, right, strict=True)], dtype="int32")


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best likeness among the common words and the common words with either rest; an empty side: 0.

    The common words are the beginning of both longer strings, so only the rests go to the helper, and the
    lengths give the likenesses.
    """
    x, y = _words(a), _words(b)
    text = lambda v: F.array_join(F.array_sort(v), " ")
    left, right = text(F.array_except(x, y)), text(F.array_except(y, x))
    i, p, q, common = F.length(text(F.array_intersect(x, y))), F.length(left), F.length(right), _common_letters(left, right)
    alike = lambda k, n: F.lit(100.0) * 2 * k / n
    joined = F.greatest(alike(i, i + i + 1 + p), alike(i, i + i + 1 + q), alike(i + 1 + common, 2 * i + 2 + p + q))
    score = F.when((i > 0) & ((p == 0) | (q == 0)), 100.0).when(i > 0, joined).when(p + q == 0, 100.0).otherwise(alike(common, p + q))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(score)


#: The letters that are counted one by one; all others together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789%./"


def _words(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, " "), lambda w: w != ""))


def letters(s: Column) -> Column:
    """How often each of LETTERS, and any other, is in the distinct words of s."""
    text = F.array_join(_words(s), "")
    counts = F.transform(F.array(*[F.lit(c) for c in LETTERS]), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.concat(counts, F.array(F.length(F.translate(text, LETTERS, ""))))


def token_set_bound(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """An upper bound of token_set_ratio(a, b) from the words and letters of both (see letters), all built in.

    A common subsequence has no letter oftener than either side. The two other comparisons
    are of a string with its own beginning, or with common words alone, and are exact or
    covered by that bound.
    """
    x, y = _words(a), _words(b)
    same = F.array_intersect(x, y)
    size = lambda v: F.length(F.array_join(v, " "))
    left, right = F.array_except(x, y), F.array_except(y, x)
    shared = F.aggregate(F.zip_with(a_letters, b_letters, lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    common = F.array_join(same, "")
    rest = shared - F.length(common) + F.greatest(F.least(F.size(left), F.size(right)) - 1, F.lit(0))
    i, n, m = size(same), size(x), size(y)
    alike = lambda k, total: F.lit(100.0) * 2 * k / total
    both = F.greatest(alike(i, i + n), alike(i, i + m), alike(i + 1 + rest, n + m))
    bound = F.when(F.size(same) == 0, alike(rest, n + m)).when((F.size(left) == 0) | (F.size(right) == 0), 100.0).otherwise(both)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(F.coalesce(bound, F.lit(100.0)))


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


@F.pandas_udf(T.LongType())
def image_hash(pixels: pd.Series) -> pd.Series:
    """64 bits of a 32 x 32 grey image (1024 numbers, by row): which of its 8 x 8 lowest frequencies exceed their median. Anything else: null."""
    c, out = _cosines(32), []
    for p in pixels:
        if p is None or len(p) != 1024 or any(v is None for v in p):
            out.append(None)
            continue
        low = (c @ np.asarray(p, float).reshape(32, 32) @ c.T)[:8, :8].ravel()
        bits = 0
        for hot in low > np.median(low):
            bits = bits << 1 | int(hot)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return pd.Series(out, dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; null if either is null, of another length or all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))
