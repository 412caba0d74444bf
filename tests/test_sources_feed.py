import json
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from gondola.sources import mappers
from gondola.sources import offers as io
from gondola.streaming.feed import SNAPSHOT, change_feed, use_rocksdb


def test_offers_round_trip(spark, tmp_path):
    lines = [json.dumps({"cadena": "a", "sku": "017987", "nombre_origen": "x", "precio": 1.5, "raw": {"z": 1}}), "not json", json.dumps({"cadena": "a", "sku": None, "nombre_origen": "x"}), json.dumps({"cadena": "b", "sku": "12313-BLISTER", "nombre_origen": "y", "en_promocion": True, "stock": False})]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    got = io.read_offers(spark, str(tmp_path / "in.jsonl"))
    assert [(r["sku"], r["precio"], r["en_promocion"], r["stock"]) for r in got.orderBy("sku").collect()] == [("017987", Decimal("1.50"), False, None), ("12313-BLISTER", None, True, False)]
    io.write_offers(got, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_history_appends(spark, tmp_path):
    path = str(tmp_path / "h")
    for run in ("20260101", "20260102"):
        io.append_snapshot(spark.createDataFrame([("a", 1)], "id string, precio int").withColumn("run", F.lit(run)), path)
    assert [r["run"] for r in io.read_history(spark, path).orderBy("run").collect()] == ["20260101", "20260102"]


def test_basket(spark):
    rows = [("c", "p", {"asia": "1", "x": " "}, "9"), ("c", "q", None, "7"), ("c", "r", {"x": "5"}, None)]
    got = {tuple(r)[3:] + (r["match_id"],) for r in io.basket_rows(spark.createDataFrame(rows, "categoria string, nombre string, skus map<string,string>, sku string"), "asia", ["asia", "europe"]).collect()}
    assert got == {("asia", "1", "1"), ("europe", "9", "1"), ("asia", "7", "7"), ("europe", "7", "7"), ("x", "5", "5")}


def test_tiles_and_audit(spark):
    page = '<p><div class="product" data-pid="p1"><a href="/x">Name</a><span class="sales">S/ 1,234.50</span></div><div class="product" data-pid=""></div>'
    got = mappers.from_tiles(spark.createDataFrame([(page,), (None,), ("",)], "html string"), "c", "https://e.com").collect()
    assert [(r["sku"], r["nombre_origen"], r["precio"], r["url"]) for r in got] == [("p1", "Name", 1234.5, "https://e.com/x")]
    rows = [("http://e.com/A b", 403, "text/html", {"CF-Ray": "1"}, "x JUST A MOMENT"), (" ", 403, None, None, None), ("u", 200, "application/json", None, "incapsula")]
    seen = mappers.audit_pages(spark.createDataFrame(rows, "url string, status int, content_type string, headers map<string,string>, body string")).collect()
    assert [(r["senales"], r["reto"], r["extension"], r["slug"]) for r in seen] == [(["cf-ray=1", "body:just a moment"], True, "html", "http_e.com_a_b"), ([], False, "bin", "x"), (["body:incapsula"], False, "json", "u")]


def test_feed(spark, tmp_path):
    """Runs in parts, replays and a missed run give the events of whole runs, without reading a history."""
    base = f"{tmp_path}/{uuid.uuid4().hex}"
    add = lambda rows: spark.createDataFrame([(r, i, c, Decimal(p), f) for r, i, c, p, f in rows], "run string, id string, cadena string, precio decimal(12,2), en_promocion boolean").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{base}/in")
    use_rocksdb(spark)

    def go(run):
        stream = spark.readStream.schema(SNAPSHOT).parquet(f"{base}/in")
        change_feed(stream, f"{base}/r", f"{base}/e", f"{base}/c").awaitTermination()
        return sorted((r["tipo_evento"], r["id"], r["cadena"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/e").where(F.col("run") == run).collect())

    add([("1", "a", "x", "10", False), ("1", "a", "x", "10", False), ("1", "a", "y", "10", False), ("1", "d", "x", "5", False)])
    assert go("1") == []
    add([("2", "a", "x", "9", True), ("2", "b", "x", "1", False), ("2", "c", "x", "1", False)])
    first = [("baja_precio", "a", "x"), ("inicia_promo", "a", "x"), ("nuevo", "b", ""), ("nuevo", "c", "")]
    assert go("2") == first
    add([("2", "a", "x", "9", True), ("2", "a", "y", "12", False), ("2", "b", "y", "1", False)])  # a replay, and the run's other part
    want = sorted([*first, ("sube_precio", "a", "y")])
    assert go("2") == want
    add([("3", "a", "x", "9", False), ("3", "d", "x", "4", False), ("3", "c", "x", "1", False)])  # d missed run 2
    assert go("3") == [("fin_promo", "a", "x"), ("nuevo", "d", "")] and go("2") == want
