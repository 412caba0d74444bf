from decimal import Decimal

import pytest
from pairs import BASKET
from pyspark.sql import functions as F

from gondola.operators import compare, history, tree

PRICES = "id string, cadena string, precio decimal(12,2), precio_regular decimal(12,2), en_promocion boolean"
HISTORY = "run string, id string, cadena string, precio decimal(12,2), en_promocion boolean, stock boolean, categoria string"


@pytest.fixture(scope="module")
def basket(spark):
    rows = [(name, f"c{i}", Decimal(p[0]), None, p[1]) for _, name, *ps, _ in BASKET for i, p in enumerate(ps, 1) if p[0]]
    return spark.createDataFrame(rows, PRICES)


def test_basket(basket):
    compared = compare.cheapest(basket, ["id"])
    gaps = {r["id"]: float(r["brecha_pct"]) for r in compared.collect()}
    assert gaps == {name: gap for _, name, *_, gap in BASKET}
    k = compare.kpis(compared).first()
    assert (k["comparables"], k["empates"], k["brecha_media"], k["brecha_max"]) == (34, 18, 14.4, 38.1)
    wins = {r["cadena"]: (r["ganados"], r["pct_piso"]) for r in compare.win_share(compared).collect()}
    assert wins == {"c1": (9, 26), "c2": (4, 11), "c3": (3, 8)}
    assert [float(r["brecha_pct"]) for r in compare.gap_alerts(compared, ["id"]).collect()] == sorted(gaps.values(), reverse=True)[:5]


def test_cheapest_edges(spark):
    rows = [("a", "x", 0), ("a", "y", 5), ("b", "x", 3), ("c", "x", None), ("c", "y", 2), ("c", "z", 2), ("d", "x", 4), ("d", "y", 1), ("d", "z", 1)]
    df = spark.createDataFrame([(i, c, None if p is None else Decimal(p), None, None) for i, c, p in rows], PRICES)
    got = {r["id"]: (r["n"], r["mas_barato"], r["mas_caro"], r["brecha_pct"] and float(r["brecha_pct"])) for r in compare.cheapest(df, ["id"]).collect()}
    assert got == {"a": (2, "x", "y", None), "b": (1, None, None, None), "c": (2, "empate", "empate", 0.0), "d": (3, "empate", "x", 300.0)}
    assert compare.cheapest(df.limit(0), ["id"]).count() == 0


def test_twins_filters_order(spark):
    rows = [("1", "n", {"a": 1, "b": 2}), ("2", "n", {"b": 2, "a": 1}), ("3", None, {"a": 1}), ("4", None, {"a": 1}), ("5", "n", None)]
    df = spark.createDataFrame(rows, "id string, nombre string, precios map<string,int>")
    assert sorted(r["id"] for r in compare.without_twins(df, ["nombre", "precios"], "id").collect()) == ["1", "3", "5"]
    p = spark.createDataFrame([("1", "Gel", "M", "c", {"a": 1}, "a", "b", 12.0), ("2", None, None, "c", {"a": 1, "b": 2}, "empate", "b", None)], "id string, nombre string, marca string, categoria string, precios map<string,int>, mas_barato string, mas_caro string, brecha_pct double")
    ids = lambda f: [r["id"] for r in compare.filtered(p, f).collect()]
    assert ids(compare.Filter(text=" gEL ")) == ["1"] and ids(compare.Filter(chains=["b"])) == ["2"] and ids(compare.Filter(least_gap=0.0)) == ["1"]
    assert ids(compare.Filter(chains=["a"], target="a", position="barato")) == ["1"] and ids(compare.Filter(chains=["a"], target="z", position="barato")) == ["1", "2"]
    assert [r["id"] for r in compare.ordered(p, F.col("brecha_pct")).collect()] == ["1", "2"] == [r["id"] for r in compare.ordered(p, F.col("brecha_pct"), True).collect()]


def rows_of(spark, run, cells):
    return spark.createDataFrame([(run, i, c, None if p is None else Decimal(p), promo, None, "k") for i, c, p, promo in cells], HISTORY)


def test_diff(spark):
    before = rows_of(spark, "1", [("a", "x", "10", False), ("a", "y", "10", True), ("b", "x", "0", None), ("gone", "x", "1", False)])
    now = rows_of(spark, "2", [("a", "x", "8", True), ("a", "y", "10", False), ("a", "z", "3", True), ("b", "x", "5", True), ("new", "x", "1", True), ("new", "y", "1", True)])
    trended = history.with_trend(history.with_previous(now, before))
    dirs = {(r["id"], r["cadena"]): (r["dir"], r["delta_pct"] and float(r["delta_pct"])) for r in trended.collect()}
    assert dirs == {("a", "x"): ("baja", -20.0), ("a", "y"): ("igual", 0), ("a", "z"): ("nuevo", None), ("b", "x"): ("sube", None), ("new", "x"): ("nuevo", None), ("new", "y"): ("nuevo", None)}
    got = {(r["tipo_evento"], r["id"], r["cadena"]) for r in history.events(trended).collect()}
    assert got == {("nuevo", "new", ""), ("baja_precio", "a", "x"), ("sube_precio", "b", "x"), ("inicia_promo", "a", "x"), ("fin_promo", "a", "y")}
    first = history.events(history.with_trend(history.with_previous(now, before.limit(0))))
    assert first.count() == 0


def test_runs_compare_with_the_run_before(spark):
    h = rows_of(spark, "1", [("a", "x", "10", None)]).union(rows_of(spark, "2", [("b", "x", "1", None)])).union(rows_of(spark, "3", [("a", "x", "9", None), ("b", "x", "1", None)]))
    got = {(r["run"], r["id"]): (r["dir"], r["es_nuevo"]) for r in history.history_trends(h).collect()}
    assert got == {("2", "b"): ("nuevo", True), ("3", "a"): ("nuevo", True), ("3", "b"): ("igual", False)}
    assert {(r["run"], r["id"]) for r in history.first_seen(h).collect()} == {("2", "b")}
    assert [r["run"] for r in history.latest_before(h, "3").collect()] == ["2"] and history.latest_before(h, "1").count() == 0


def test_tree(spark):
    items = spark.createDataFrame([("1", ["A", "B"], ["s"]), ("2", ["A"], ["s", "t"]), ("3", ["C"], []), ("3", ["C"], None), ("4", None, ["s"])], "sku string, categorias array<string>, subcategorias array<string>")
    got = {tuple(r) for r in tree.facet_counts(items).collect()}
    assert got == {("A", "s", 2, 2), ("A", "t", 1, 2), ("B", "s", 1, 1), ("C", tree.NO_SUBCATEGORY, 1, 1)}
    nodes = spark.createDataFrame([("b", "b-1", None, False, 1), ("b", "b-2", "L", False, 2), ("b", "b-3", None, True, 3), ("b", "b-4", "M", True, 4), ("b", "b-5", "N", True, 5)], "base string, slug string, etiqueta string, directo boolean, pos int")
    assert tree.merge_nodes(nodes).first()["slug"] == "b-4"


def test_basket_of_the_whole_run(spark):
    from gondola.plans import compare_queries, offerview

    sf = "/root/testdata/sf0.001"
    rows = offerview.offers(spark, sf).where(f"run = '{offerview.LAST}' and presentacion_kind = 'pack'")
    skus = {r[0] for r in rows.select("sku").distinct().collect()}
    got = [(r["sku"], r["cadena"]) for r in compare_queries.e03_run_fetch(spark, sf).select("sku", "cadena").collect()]
    assert sorted(got) == sorted((s, c) for s in skus for c in offerview.CHAINS)
