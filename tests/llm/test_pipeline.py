"""The pipeline's stages on the smallest table, each against plain Python on its own input."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from fixtures import words
from test_operators import ASSIGN, brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from gondola.llm.frames import cut, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").limit(150)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    source, spoken, single, masked, mixed, ids = (x.collect() for x in out)
    assert all(x.columns == list(corpus_pipeline.COLUMNS) for x in out[1:5])
    assert {r["doc_id"] for r in source} - {r["doc_id"] for r in spoken} <= {r["doc_id"] for r in source if not re.search(r"[^\W\d_]", r["text"] or "")}
    expect = brute_components([(r["doc_id"], r["text"]) for r in spoken], 5, 80)
    assert {r["doc_id"] for r in single} == {d for d, (_, c) in expect.items() if d == c}
    assert len(masked) == len(single)
    assert not [r for r in masked if any(len(m[1]) >= 8 for m in ASSIGN.finditer(r["text"])) or re.search("[0-9a-f]{32}", r["text"])]
    size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in masked)
    assert abs(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed) - size) < 0.15 * size
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(ids) == len(mixed)
    for r in ids:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_keeps_clean_documents(spark):
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.languages(spark, docs, SF)
    assert kept.count() >= 0.95 * docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_near_dedup_with_odd_ids(spark):
    one, two, three, four = (words(i, 90) for i in (21, 22, 23, 24))
    rows = [(1, one), (None, one + " tail"), (2, two), (2, two), (2, two + " tail"), (3, one + " end"), (3, three), (None, four), (None, four), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(kept) == 5
    assert {(1, one), (3, three), (None, four), (None, None)} < set(kept)
    assert sum(i == 2 for i, _ in kept) == 1
