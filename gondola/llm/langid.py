"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, hash-chosen sample of labelled documents on
the executors; the log-probability matrix (languages x buckets) is broadcast, and
documents are scored in numpy batches: their n-gram counts, as (document, bucket,
count), are multiplied with the matrix and summed per document, language by language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.llm.hashing import slices, worker_value

#: Label for texts without letters.
UNDETERMINED = "und"
#: Expected number of documents per language to learn from, at most (a documented bound of the fit).
SAMPLE_PER_LANGUAGE = 5000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters of a text handled at once; n-grams go on over the joints.
PIECE = 1 << 18


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, log P(bucket | language) as buckets x languages, log priors."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray


def _letters() -> np.ndarray:
    return worker_value("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, each once, and how often; runs of other characters than letters count as one blank."""
    letters, text = _letters(), text.lower()
    total, found = None, []
    tail = np.array([32], np.uint64)  # the last characters before the part at hand
    for at in range(0, len(text) + 1, PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.append(np.where(letters[code], code, 32), 32) if at + PIECE > len(text) else np.where(letters[code], code, 32)
        code = np.concatenate([tail, code.astype(np.uint64)])
        fresh = np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])
        fresh[: len(tail)] = True
        code = code[fresh]
        gram, found = np.zeros(len(code), np.uint64), []
        for n in range(1, max(ORDERS) + 1):
            if n > len(code):
                break
            gram = gram[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
            if n in ORDERS:
                kept = gram[max(0, len(tail) - n + 1) :]  # those that end in this part
                kept = kept[kept != 32] if n == 1 else kept
                found.append(((kept + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(BUCKETS))))
        tail = code[-(max(ORDERS) - 1) :]
        if len(text) >= PIECE:
            total = (0 if total is None else total) + np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
    if total is not None:
        at = np.flatnonzero(total)
        buckets, counts = at, total[at]
    else:
        buckets, counts = np.unique(np.concatenate(found).astype(np.int64), return_counts=True)
    return (buckets, counts) if len(text) and _has_letter(text) else (np.empty(0, np.int64), np.empty(0, np.int64))


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(1).to_pylist()
        at = 0
        for _, texts in slices(batch, "_text"):
            for text in texts:
                buckets, counts = ngram_counts(text.decode("utf-8", "replace"))
                name, at = names[at], at + 1
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name][buckets] += counts
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit the model on labelled rows; rows with null text or language are left out.

    Of a language with more rows than per_language, the rows whose hashed key falls
    under per_language / rows are taken. The rows that reach the driver are at most
    languages x BUCKETS. No labelled rows give a model without languages.
    """
    rows = labelled.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), key.alias("_key")).where("_text is not null and _lang is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(sizes))
    if not names:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per_language / sizes[n]))])
    unit = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit < share[F.col("_lang")]).select("_text", "_lang")
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.ones((BUCKETS, len(names)))
    place = {n: i for i, n in enumerate(names)}
    matrix[counts["bucket"].to_numpy(), [place[n] for n in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
    total = sum(sizes.values())
    return Model(names, np.asfortranarray(np.log(matrix / matrix.sum(axis=0))), np.log([sizes[n] / total for n in names]))


def log_scores(model: Model, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log prior and likelihood of each document and language: the sparse counts times the matrix, a language at a time."""
    document = np.repeat(np.arange(len(counts)), [len(b) for b, _ in counts])
    buckets, times = (np.concatenate([c[k] for c in counts]) for k in (0, 1))
    each = [np.bincount(document, times * weights[buckets], len(counts)) for weights in model.weights.T]
    return np.stack(each, axis=1) + model.priors


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with lang_pred and score (of clashing names, the new columns replace the old).

    score is the posterior probability of lang_pred. Null texts, texts without a letter
    and models without languages give 'und' and 0. Ties go to the first language.
    """
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, texts in slices(batch, text):
                found = [ngram_counts(t.decode("utf-8", "replace")) if t else (np.empty(0, np.int64),) * 2 for t in texts]
                names, scores = [UNDETERMINED] * len(found), np.zeros(len(found))
                has = [i for i, (x, _) in enumerate(found) if len(x)] if m.languages else []
                if has:
                    logs = log_scores(m, [found[i] for i in has])
                    best = logs.argmax(axis=1)
                    scores[has] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, b in zip(has, best, strict=True):
                        names[i] = m.languages[b]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One document in five, by the crc32 of its id as text; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
