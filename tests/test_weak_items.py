"""Decomposed letters, quarantine of broken parts, stored image hashes, places, seeds, CSV and annotated documents."""

import random
import unicodedata
import uuid
from decimal import Decimal
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from gondola.functions import names
from gondola.operators import compare, history, matching
from gondola.operators.ranking import first_rows, with_place
from gondola.sources import offers as io


def test_letters_are_taken_apart_as_nfkd_does(spark):
    r = random.Random(5)
    words = ["niños", "niños", "½ tableta", "ő č", "ﬁbra 50㎎", "Ⅳ™ №", "𝐀𝐛c", "ª º ñÑ", "é̀a", "plain", "", None]
    words += ["".join(chr(r.choice([r.randint(0x20, 0x17F), r.randint(0x2000, 0x24FF), r.randint(0x3200, 0x33FF), r.randint(0xFB00, 0xFB06), r.randint(0x300, 0x36F)])) for _ in range(r.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string")
    got = {x["i"]: x["t"] for x in df.select("i", names.normal_text(F.col("s")).alias("t")).collect()}
    plain = ["".join(c for c in unicodedata.normalize("NFKD", w or "") if not unicodedata.combining(c)) for w in words]
    want = {x["i"]: x["t"] for x in spark.createDataFrame(list(enumerate(plain)), "i int, s string").select("i", names.normal_text(F.col("s")).alias("t")).collect()}
    assert [(words[i], got[i], want[i]) for i in got if got[i] != want[i]] == [] and got[0] == got[1] == "ninos" and got[2] == "1 2 tableta"


def test_broken_parts_are_reported_and_their_run_left_out(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    rows = spark.createDataFrame([("2024-01-01T10:00", "a", Decimal(1)), ("2024-01-02T10:00", "a", Decimal(2)), ("2024-01-03T10:00", "a", Decimal(3))], "run string, id string, precio decimal(12,2)")
    io.append_snapshot(rows, path)
    broken = next(f for f in Path(path).rglob("*.parquet") if "2024-01-03" in str(f))
    broken.write_bytes(b"PAR1 not a file")
    broken.with_name(f".{broken.name}.crc").unlink(missing_ok=True)
    found = io.read_history(spark, path, "id string, precio decimal(12,2), run string")
    assert [r["run"] for r in io.unreadable_parts(found).collect()] == ["2024-01-03T10:00"]
    assert [r["run"] for r in history.latest_before(io.sound_history(found), "2024-01-04").collect()] == ["2024-01-02T10:00"]


def test_images_are_hashed_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    pixels = lambda seed: np.random.default_rng(seed).random(1024).tolist()
    rows = [("a", pixels(1)), ("a", pixels(1)), ("b", pixels(2)), ("bad", [1.0]), (None, pixels(3))]
    images = spark.createDataFrame(rows, "url string, pixels array<double>")
    assert sorted(r["url"] for r in matching.hash_images(images, path).collect()) == ["a", "b", "bad"]
    assert matching.hash_images(images, path).count() == 0
    assert matching.hash_images(images.unionByName(spark.createDataFrame([("c", pixels(4))], images.schema)), path).count() == 1
    got = {r["url"]: r["hash"] for r in matching.stored_hashes(spark, path).collect()}
    assert set(got) == {"a", "b", "bad", "c"} and got["bad"] is None and got["a"] is not None


def test_places_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["x", "x", "x", "y", None]), r.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(7)
    for x in with_place(df, [F.col("v"), F.col("id")]).collect():
        assert x["puesto"] == 1 + sum((v, i) < (x["v"], x["id"]) for i, _, v in rows)
    within = {x["id"]: x["puesto"] for x in with_place(df, [F.col("v"), F.col("id")], within=["g"]).collect()}
    assert within == {i: 1 + sum(h == g and (w, j) < (v, i) for j, h, w in rows) for i, g, v in rows}
    few = {x["id"]: x["puesto"] for x in first_rows(df, ["g"], [F.col("v"), F.col("id")], 5, "id").collect()}
    assert few == {i: p for i, p in within.items() if p <= 5}
    assert with_place(df.limit(0), [F.col("id")]).count() == 0


def test_order_by_name(spark):
    df = spark.createDataFrame([("1", "Zinc"), ("2", "ácido"), ("3", "acido B"), ("4", None), ("5", "ñame"), ("6", "nuez"), ("7", "zinc")], "id string, nombre string")
    assert [r["id"] for r in compare.by_name(df).orderBy("puesto").collect()] == ["2", "3", "5", "6", "1", "7", "4"]


def test_seeds_come_on_top(spark):
    base = spark.createDataFrame([("1", 1, "t", "uno")], "sku string, orden int, termino string, nombre_norm string")
    catalogue = spark.createDataFrame([("1", "s", "uno", 1.0), ("2", "s", "dos", 1.0), ("3", "s", "tres", None), ("4", "u", "cuatro", 2.0), ("5", "v", "cinco", 2.0)], "sku string, subcategoria string, nombre_norm string, precio double")
    seeds = spark.createDataFrame([(1, "s", "A"), (2, "u", "B"), (3, "s", "C")], "orden int, subcategoria string, categoria string")
    assert {(r["sku"], r["categoria"]) for r in compare.with_seeds(base, catalogue, seeds).collect()} == {("1", None), ("2", "A"), ("4", "B")}


def test_csv_files_follow_one_another(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    df = spark.createDataFrame([(i * 37 % 200, None if i % 3 else f"x{i}") for i in range(200)], "k int, t string")
    io.write_csv(df.repartition(5), path, order=["k"])
    files = sorted(Path(path).glob("*.csv"))
    assert [int(x.split(",")[0]) for f in files for x in f.read_text().splitlines()[1:]] == list(range(200))
    assert sorted(map(str, io.read_csv(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))


def test_annotated_document(spark):
    facts = "id string, cadena string, precio decimal(12,2), en_promocion boolean"
    before = spark.createDataFrame([("a", "x", Decimal(10), False), ("a", "y", Decimal(5), True)], facts)
    now = spark.createDataFrame([("a", "x", Decimal(8), True), ("a", "y", Decimal(5), False), ("a", "z", Decimal(1), None), ("b", "x", Decimal(2), False)], facts)
    document = now.select("id").distinct()
    got = {r["id"]: r for r in io.annotated_document(document, history.with_trend(history.with_previous(now, before))).collect()}
    assert {c: tuple(t) for c, t in got["a"]["tendencia"].items()} == {"x": ("baja", Decimal("10.00"), -20.0), "y": ("igual", Decimal("5.00"), 0.0), "z": ("nuevo", None, None)}
    assert got["a"]["promo_cambio"] == {"x": "inicia", "y": "fin"} and got["a"]["nuevo"] is None
    assert got["b"]["nuevo"] is True and got["b"]["promo_cambio"] is None
