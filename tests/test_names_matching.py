from decimal import Decimal

import pytest
from pairs import BLOCK, MATCH
from pyspark.sql import functions as F

from gondola.functions import names
from gondola.functions.similarity import hamming, image_hash, letters, token_set_bound, token_set_ratio
from gondola.operators import matching
from gondola.plans import match_queries
from gondola.plans.offerview import table

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "text", "dose", "form", "count", "size"),
    [
        ("Paracetamol 500 mg Tabletas - Caja 100 UN", "paracetamol 500mg tableta caja 100 un", "500mg", "tableta", 100, (100.0, "un")),
        ("Desloratadina 2.5mg/5 ml Jarabe Frasco 60 ML", "desloratadina 2.5mg/5ml jarabe frasco 60ml", "2.5mg/5ml", "jarabe", None, (60.0, "ml")),
        ("Supracalm 1 Gr Comprimido", "supracalm 1 gr tableta", "1g", "tableta", None, (1.0, "g")),
        ("Pediasure Polvo Lata 1.6 KG", "pediasure polvo lata 1.6 kg", None, "polvo", None, (1600.0, "g")),
        ("Jarabe 2,5mg", "jarabe 2 5mg", "5mg", "jarabe", None, None),
        (None, "", None, None, None, None),
        ("", "", None, None, None, None),
        ("Extra max 500", "extra max 500", None, None, 500, None),
    ],
)
def test_specs(spark, name, text, dose, form, count, size):
    df = spark.createDataFrame([(name,)], "nombre_origen string")
    r = names.features(df).first()
    assert (r["texto_norm"], r["concentracion"], r["forma"], r["cantidad"]) == (text, dose, form, count)
    assert (tuple(r["tamano"]) if r["tamano"] else None) == size


def test_tokens(spark):
    r = names.features(spark.createDataFrame([("Vitamina C y Vitamina D3 Forte Niños Gomitas x 30",)], "nombre_origen string")).first()
    assert r["vitaminas"] == ["c", "d"] and r["variante"] == ["forte"] and r["infantil"] and r["gomita"]
    assert r["clave"] == ["gomitas", "ninos"]


def test_token_set_ratio(spark):
    pairs = [("a b", "b a", 100.0), ("abc", "abc def", 100.0), ("", "a", 0.0), ("abcd", "abxd", 75.0), ("uno dos", "uno tres", 2 * 100 * len("uno s") / (7 + 8))]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("*", token_set_ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 9 and (r["want"] not in (0.0, 100.0, 75.0) or r["got"] == r["want"])


def offers(spark, rows):
    return spark.createDataFrame(rows, "id string, sku string, ean string, nombre_origen string")


def decided(spark, pairs):
    a = names.features(offers(spark, [(str(i), f"A:{x[:24]}", None, x) for i, (x, _) in enumerate(pairs)]))
    b = names.features(offers(spark, [(str(i), f"B:{y[:24]}", None, y) for i, (_, y) in enumerate(pairs)]))
    same = spark.createDataFrame([(str(i), str(i)) for i in range(len(pairs))], "l_id string, r_id string")
    out = matching.with_decision(matching.with_score(matching.with_rules(same, a, b)))
    return {pairs[int(r["l_id"])]: (r["motivo"], r["score"]) for r in out.collect()}


def test_control_pairs(spark):
    blocked = decided(spark, BLOCK)
    assert [p for p, (rule, score) in blocked.items() if rule is None and score >= matching.REVIEW] == []
    matched = decided(spark, MATCH)
    assert [(p, x) for p, x in matched.items() if x[0] is not None or x[1] < matching.REVIEW] == []


def test_blocking_loses_nothing(spark):
    rows = [n for p in BLOCK + MATCH for n in p]
    df = names.features(offers(spark, [(str(i), str(i), None, n) for i, n in enumerate(rows)])).withColumn("q", matching.quantity(F.col("tamano"), F.col("cantidad")))
    every = df.select(F.col("id").alias("l_id")).crossJoin(df.select(F.col("id").alias("r_id")))
    ok = {(r["l_id"], r["r_id"]) for r in matching.with_rules(every, df, df).where("motivo is null").select("l_id", "r_id").collect()}
    found = {(r["l_id"], r["r_id"]) for r in matching.candidate_pairs(df, df).collect()}
    assert ok <= found
    near = {(r["l_id"], r["r_id"]) for r in matching.with_rules(every, df, df).where("motivo is null").where(matching.quantities_agree(F.col("l_q"), F.col("r_q"))).select("l_id", "r_id").collect()}
    assert near <= {(r["l_id"], r["r_id"]) for r in matching.candidate_pairs(df, df, True).collect()}


def test_a_token_in_half_the_names_is_no_hot_key(spark, monkeypatch):
    """Each pair once, also if it shares several tokens, and no cell of the join has more than about BLOCK_SIDE rows a side."""
    monkeypatch.setattr(matching, "BLOCK_PAIRS", 2000)
    monkeypatch.setattr(matching, "BLOCK_SIDE", 40)
    words = lambda i, p: sorted({*(["comun"] if i % 2 else []), f"{p}{i % 97}", *([f"raro{i % 50}"] if i % 3 else [])} if i % 10 else [])
    make = lambda p: spark.createDataFrame([(f"{p}{i}", words(i, p), ["forte"] if i % 7 == 0 else [], False) for i in range(600)], "id string, clave array<string>, variante array<string>, infantil boolean")
    left, right = make("a"), make("b")
    sides = [[(r["id"], set(r["clave"]), r["variante"]) for r in df.collect()] for df in (left, right)]
    want = sorted((x, y) for x, k, v in sides[0] for y, m, w in sides[1] if v == w and (k & m or not k or not m))
    assert sorted((r["l_id"], r["r_id"]) for r in matching.candidate_pairs(left, right).collect()) == want
    ranked = matching.ranked_tokens(left, right)
    a, b = (df.select(F.col("id").alias(f"{p}_id"), F.explode("tokens").alias("_t")) for p, df in zip("lr", ranked, strict=True))
    for dealt in matching.spread(a, b, ["_t"], "l_id", "r_id"):
        assert dealt.groupBy("_t", "_i", "_j").count().agg(F.max("count")).first()[0] < 2 * matching.BLOCK_SIDE
    tokens = {r["id"]: r["tokens"] for r in ranked[0].collect()}
    assert tokens["a1"][-1] == "comun" and tokens["a10"] == []


def test_bound_of_likeness(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcde1é") for _ in range(r.randint(1, 6)))
    some = lambda: " ".join(r.choice(pool) for _ in range(r.randint(0, 5)))
    pool = [word() for _ in range(25)]
    df = spark.createDataFrame([(some(), some()) for _ in range(1500)], "a string, b string")
    bound = token_set_bound(F.col("a"), F.col("b"), letters(F.col("a")), letters(F.col("b")))
    rows = df.select(token_set_ratio(F.col("a"), F.col("b")).alias("score"), bound.alias("bound")).collect()
    assert all(x["score"] <= x["bound"] <= 100 for x in rows) and sum(x["bound"] < 70 for x in rows) > 200


def test_few_pairs_are_scored_for_the_best(spark, monkeypatch):
    """Forty names a side with two words in common: the best of each is that of all pairs scored, from under a third of them."""
    import random

    r = random.Random(4)
    name = lambda: "Champu brillante " + " ".join(r.choice(["lavanda", "manzanilla", "romero", "coco", "argan", "jengibre", "citricos", "almendra"]) for _ in range(3))
    side = lambda p: names.features(offers(spark, [(f"{p}{i:02}", f"{p}{i:02}", None, name()) for i in range(40)]))
    a, b = side("a"), side("b")
    scored = []
    score = matching.with_score
    monkeypatch.setattr(matching, "with_score", lambda df: scored.append(df.count()) or score(df))
    best = {tuple(x) for x in matching.best_matches(a, b, "sku").select("l_id", "r_id", "score").collect()}
    partly = sum(scored)
    every = matching.match_offers(a, b).join(b.select(F.col("id").alias("r_id"), F.col("sku").alias("r_sku")), "r_id")
    assert best == {tuple(x) for x in matching.best_candidate(every, "r_sku").select("l_id", "r_id", "score").collect()} and best
    assert scored[-1] == 1600 and 3 * partly < 1600, partly


def test_quantity_edges(spark):
    rows = [(str(i), v) for i, v in enumerate([0.0, 1.0, 9.0, 10.0, 100.0, 90.0, 89.9, 1e6, 0.9e6, None])]
    df = spark.createDataFrame(rows, "id string, v double").withColumn("q", F.when(F.col("v").isNotNull(), F.struct(F.col("v").alias("valor"), F.lit("un").alias("clase"))))
    got = {(r["l_id"], r["r_id"]) for r in matching.quantity_join(df, df).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if x and y and abs(x - y) <= 0.1 * max(x, y)}


def test_identifiers_and_best(spark):
    a = offers(spark, [("1", "007", "775", "x"), ("2", "8", " ", "y"), ("3", None, None, "z")])
    b = offers(spark, [("1", "007", "775", "x"), ("2", "7", "775", "y"), ("3", None, None, "z")])
    got = {tuple(r) for r in matching.match_by_identifier(a, b).collect()}
    assert got == {("1", "1", "id"), ("1", "2", "ean")}
    assert {tuple(r) for r in matching.match_by_identifier(a, b, shared_namespace=False).collect()} == {("1", "1", "ean"), ("1", "2", "ean")}
    scored = spark.createDataFrame([("1", "a", 80.0, 2), ("1", "b", 80.0, 1), ("1", "c", 69.9, 0), ("2", "a", 60.0, 1)], "l_id string, r_id string, score double, r_orden int")
    assert [r["r_id"] for r in matching.best_candidate(scored).collect()] == ["b"]


def test_best_candidate_by_identifier(spark):
    rows = table(spark, SF, "part").select("p_partkey").count()
    a, b = match_queries._sides(spark, SF)
    every = matching.with_decision(matching.with_score(matching.with_rules(a.select(F.col("id").alias("l_id")).crossJoin(b.select(F.col("id").alias("r_id"))), a, b)))
    every = every.where(matching.quantities_agree(F.col("l_q"), F.col("r_q"))).select("l_id", "r_id", "l_sku", "r_sku", "l_ean", "r_ean", "score", "metodo", "es_match", "motivo")
    best, want = {}, {}
    for r in every.collect():
        by = "id" if r["l_sku"] == r["r_sku"] else "ean" if r["l_ean"] and r["l_ean"] == r["r_ean"] else None
        want[r["l_id"], r["r_id"]] = (100.0, by, True, None) if by else (r["score"], r["metodo"], r["es_match"], r["motivo"])
        score, method = want[r["l_id"], r["r_id"]][:2]
        if score >= matching.REVIEW:
            best.setdefault(r["l_id"], []).append((-score, r["r_sku"], r["r_id"], method))
    got = {(r["l_id"], r["r_id"]): (r["score"], r["metodo"], r["es_match"], r["motivo"]) for r in match_queries.d18_match_offers(spark, SF).collect()}
    assert got.items() <= want.items()
    assert all(x[3] is not None for p, x in want.items() if p not in got)
    chosen = {r["l_id"]: (-r["score"], r["r_id"], r["metodo"]) for r in match_queries.d12_best_candidate(spark, SF).collect()}
    assert chosen == {k: (x[0], *x[2:]) for k, x in ((k, min(v)) for k, v in best.items())}
    assert 0 < sum(x[2] == "ean" for x in chosen.values()) < rows
    bands = {r["banda"]: r["n"] for r in match_queries.d08_scores(spark, SF).collect()}
    assert bands["match"] == sum(x[2] for x in got.values())


def test_grey_band_by_image(spark):
    rows = [(75.0, 0, 0), (75.0, 0, -1), (75.0, None, 1), (90.0, 0, -1), (60.0, 0, 0)]
    df = spark.createDataFrame([(s, None, a, b) for s, a, b in rows], "score double, motivo string, a long, b long")
    got = [(r["es_match"], r["metodo"], r["revisar"], r["score"]) for r in matching.with_decision(df, "a", "b").collect()]
    assert got == [(True, "imagen", False, 85.0), (False, "imagen", False, 75.0), (False, "fuzzy", True, 75.0), (True, "fuzzy", False, 90.0), (False, "fuzzy", False, 60.0)]


def test_image_hash(spark):
    import numpy as np

    base = np.random.default_rng(0).random(1024)
    df = spark.createDataFrame([(1, base.tolist()), (2, (base * 0.9 + 0.05).tolist()), (3, np.random.default_rng(9).random(1024).tolist()), (4, [1.0]), (5, None)], "id int, p array<double>")
    h = {r["id"]: r["h"] for r in df.select("id", image_hash("p").alias("h")).collect()}
    assert h[4] is None and h[5] is None
    bits = lambda a, b: one(spark, hamming(F.lit(a), F.lit(b)))
    assert bits(h[1], h[2]) <= 4 < 10 < bits(h[1], h[3])


def test_audit_and_coverage(spark):
    m = spark.createDataFrame([(str(i), str(i), float(i)) for i in range(10)], "l_id string, r_id string, score double")
    assert sorted(r["score"] for r in matching.audit_sample(m, 5).collect()) == [0.0, 1.0, 7.0, 8.0, 9.0]
    assert matching.audit_sample(m, 50).count() == 10
    c = matching.coverage(spark.createDataFrame([(str(i),) for i in range(3)], "id string"), m).first()
    assert (c["total"], c["con"], c["sin"], c["pct"]) == (3, 3, 0, 100)
    assert one(spark, matching.plausible_price(F.lit(Decimal("10")), F.lit(Decimal("16.5")))) is True
    assert abs(one(spark, matching.weighted_score(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0))) - 0.7) < 1e-9
