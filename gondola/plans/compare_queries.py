"""Comparison tables, KPIs and user queries (E) and category trees (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.operators import compare, tree
from gondola.operators.ranking import with_place
from gondola.plans.offerview import BEFORE, CHAINS, GROUPS, LAST, OFFERS, offers, table

GAP = "CASE WHEN n >= 2 THEN round(hi - lo, 2) END AS brecha_abs, CASE WHEN n >= 2 AND lo <> 0 THEN round((100 * (hi - lo))::DOUBLE / lo::DOUBLE, 1) END AS brecha_pct"


def compared_sql(keys: str, source: str = "offers", price: str = "precio", where: str = "true") -> str:
    return f"""
  SELECT {keys}, n, lo AS minimo, hi AS maximo, CASE WHEN n >= 2 THEN CASE WHEN nlo > 1 THEN 'empate' ELSE clo END END AS mas_barato,
    CASE WHEN n >= 2 THEN CASE WHEN nhi > 1 THEN 'empate' ELSE chi END END AS mas_caro, {GAP}
  FROM (
    SELECT {keys}, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (p = lo) AS nlo, count(*) FILTER (p = hi) AS nhi,
      min(cadena) FILTER (p = lo) AS clo, min(cadena) FILTER (p = hi) AS chi
    FROM (SELECT *, {price} AS p, min({price}) OVER w AS lo, max({price}) OVER w AS hi FROM {source} WHERE {where} AND {price} IS NOT NULL WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}
  )"""


def groups(spark):
    return spark.createDataFrame(list(GROUPS.items()), "cadena string, grupo string")


GROUPED = "grouped AS (SELECT run, id, CASE WHEN cadena IN ('america', 'europe') THEN 'grupo 1' ELSE cadena END AS cadena, min(precio) AS precio FROM offers GROUP BY ALL)"
COMPARED = f"{OFFERS}, compared AS ({compared_sql('run, id')})"


def _compared(spark, d):
    return compare.cheapest(offers(spark, d), ["run", "id"])


def e04_wide(spark, d):
    rows = compare.wide(offers(spark, d), ["run", "id"], CHAINS)
    return rows.select("run", "id", *[F.col(f"`{c}_{x}`").alias(f"{c.replace(' ', '_')}_{x}") for c in CHAINS for x in ("precio", "regular", "promo")])


E04 = f"""WITH {OFFERS} SELECT run, id, {", ".join(f"any_value({x}) FILTER (cadena = '{c}') AS {c.replace(' ', '_')}_{y}" for c in CHAINS for x, y in (("precio", "precio"), ("precio_regular", "regular"), ("en_promocion", "promo")))} FROM offers GROUP BY run, id"""


def e05_cheapest_gap(spark, d):
    return _compared(spark, d)


def e05_coarse_prices(spark, d):
    coarse = offers(spark, d).withColumn("precio", (F.floor(F.col("precio") / 5000) * 5000).cast("decimal(12,2)"))
    return compare.cheapest(coarse, ["run", "id"])


COARSE = f"WITH {OFFERS}, coarse AS (SELECT run, id, cadena, (floor(precio / 5000) * 5000)::DECIMAL(12,2) AS precio FROM offers) {compared_sql('run, id', 'coarse')}"


def e06_active_chains(spark, d):
    return compare.cheapest(offers(spark, d), ["run", "id"], ["asia", "america", "europe"])


def e07_unit_price(spark, d):
    return offers(spark, d).select("run", "id", "cadena", compare.unit_price(F.col("precio"), F.col("cantidad").cast("decimal(12,2)")).cast("double").alias("ppu"))


def e08_twins(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST)
    one = rows.groupBy("id", "nombre", "categoria").agg(F.map_from_entries(F.collect_list(F.struct("cadena", (F.floor(F.col("precio") / 20000)).alias("p")))).alias("precios"))
    return compare.without_twins(one, ["nombre", "categoria", "precios"], "id").select("id", "nombre", "categoria", F.size("precios").cast("long").alias("n"))


E08 = f"""WITH {OFFERS}, one AS (
  SELECT id, nombre, categoria, list({{'c': cadena, 'p': floor(precio / 20000)}} ORDER BY cadena) AS precios FROM offers WHERE run = '{LAST}' GROUP BY ALL
) SELECT min(id) AS id, nombre, categoria, len(precios)::BIGINT AS n FROM one GROUP BY nombre, categoria, precios"""


def e09_kpis(spark, d):
    return compare.kpis(_compared(spark, d))


E09 = f"""WITH {COMPARED} SELECT count(*) AS comparables, count(*) FILTER (mas_barato = 'empate') AS empates,
  coalesce(round(avg(brecha_pct) FILTER (brecha_pct <> 0), 1), 0) AS brecha_media, coalesce(max(brecha_pct) FILTER (brecha_pct <> 0), 0) AS brecha_max FROM compared WHERE n >= 2"""


def e10_win_share(spark, d):
    return compare.win_share(_compared(spark, d))


E10 = f"""WITH {COMPARED} SELECT mas_barato AS cadena, count(*) AS ganados, round(100 * count(*) / (SELECT greatest(count(*), 1) FROM compared WHERE n >= 2))::BIGINT AS pct,
  floor(100 * count(*) / (SELECT greatest(count(*), 1) FROM compared WHERE n >= 2))::BIGINT AS pct_piso FROM compared WHERE mas_barato <> 'empate' GROUP BY mas_barato"""


def e11_gap_alerts(spark, d):
    return compare.gap_alerts(_compared(spark, d), ["run", "id"]).select("run", "id", "mas_barato", "mas_caro", "minimo", "maximo", "brecha_pct")


def e12_coverage(spark, d):
    return compare.coverage(offers(spark, d).where(F.col("run") == LAST))


E12 = f"""WITH {OFFERS}, one AS (SELECT * FROM offers WHERE run = '{LAST}') SELECT cadena, count(DISTINCT id) AS con, floor(100 * count(DISTINCT id) / (SELECT count(DISTINCT id) FROM one))::BIGINT AS pct FROM one GROUP BY cadena"""


def e13_sorted_catalogue(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST).select("categoria", "nombre", "presentacion_kind", "id").distinct()
    return rows.orderBy("categoria", "nombre", F.coalesce("presentacion_kind", F.lit("")), "id")


def e14_filtered(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST)
    facts = rows.groupBy("id", "nombre", "marca", "categoria").agg(F.map_from_entries(F.collect_list(F.struct("cadena", "precio"))).alias("precios"))
    both = facts.join(compare.cheapest(rows, ["id"]), "id")
    f = compare.Filter(text="RED", chains=["asia"], least_gap=50.0, target="asia", position="barato")
    return compare.filtered(both, f).select("id", "nombre", "mas_barato", "brecha_pct")


E14 = f"""WITH {OFFERS}, one AS (SELECT * FROM offers WHERE run = '{LAST}'), c AS ({compared_sql('id', 'one')})
SELECT DISTINCT id, nombre, mas_barato, brecha_pct FROM c JOIN one USING (id) WHERE contains(lower(nombre || ' ' || marca || ' ' || categoria), 'red')
  AND id IN (SELECT id FROM one WHERE cadena = 'asia') AND brecha_pct >= 50 AND mas_barato = 'asia'"""


def e15_ordered(spark, d):
    rows = _compared(spark, d).where(F.col("run") == LAST)
    out = compare.ordered(rows, F.col("brecha_pct"), descending=True)
    return out.select("id", "brecha_pct")


def e16_groups(spark, d):
    return compare.with_group(offers(spark, d), groups(spark)).groupBy("run", "grupo").agg(F.count("*").alias("ofertas"), F.count_distinct("id").alias("productos"))


E16 = f"WITH {OFFERS} SELECT run, CASE WHEN cadena IN ('america', 'europe') THEN 'grupo 1' ELSE cadena END AS grupo, count(*) AS ofertas, count(DISTINCT id) AS productos FROM offers GROUP BY ALL"


def e17_group_competitor(spark, d):
    return compare.cheapest_group(offers(spark, d), groups(spark), ["run", "id"])


def e18_positioning(spark, d):
    return compare.positioning(offers(spark, d), "asia", ["run", "id"])


E18 = f"""WITH {OFFERS}, r AS (SELECT *, count(*) OVER w AS n, min(precio) OVER w AS lo, max(precio) OVER w AS hi, rank() OVER (PARTITION BY run, id ORDER BY precio) AS pos FROM offers WINDOW w AS (PARTITION BY run, id))
SELECT count(*) AS comparables, round(100 * avg((precio = lo)::INT), 1) AS pct_barato, round(100 * avg((precio = hi)::INT), 1) AS pct_caro,
  round(avg(CASE WHEN lo <> 0 THEN (100 * (precio - lo))::DOUBLE / lo::DOUBLE END), 1) AS brecha_media, round(avg(pos), 2) AS puesto_medio FROM r WHERE cadena = 'asia' AND n >= 2"""


def e19_above_market(spark, d):
    return compare.above_market(offers(spark, d), "asia", ["run", "id"], 10.0)


E19 = f"""WITH {OFFERS} SELECT a.run, a.id, a.precio, m.mercado, round((100 * (a.precio - mercado))::DOUBLE / mercado::DOUBLE, 1) AS exceso_pct FROM offers a
JOIN (SELECT run, id, min(precio) AS mercado FROM offers WHERE cadena <> 'asia' GROUP BY run, id) m USING (run, id) WHERE cadena = 'asia' AND 100 * (a.precio - mercado) > 10 * mercado"""


def e20_promotions(spark, d):
    return compare.promotions(offers(spark, d))


def e20_competitiveness(spark, d):
    return compare.competitiveness(offers(spark, d), ["run", "id"])


E20 = f"""WITH {OFFERS}, r AS (SELECT *, count(*) OVER w AS n, min(precio) OVER w AS lo FROM offers WINDOW w AS (PARTITION BY run, id))
SELECT categoria, cadena, count(*) AS comparables, round(100 * avg((precio = lo)::INT), 1) AS indice FROM r WHERE n >= 2 GROUP BY CUBE (categoria, cadena)"""


def e21_real_discount(spark, d):
    return offers(spark, d).select("run", "id", "cadena", compare.real_discount(F.col("precio_regular"), F.col("precio")).alias("descuento"))


def e01_base_selection(spark, d):
    catalogue = table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS sku", "concat(p_name, ' ', lower(p_type), ' ', p_size) AS nombre_norm", "p_retailprice AS precio")
    terms = spark.createDataFrame([(1, "red widget"), (2, "small"), (3, "promo"), (4, "blue bolt"), (5, "widget"), (6, "ring economy")], "orden int, termino string")
    return compare.select_base(catalogue, terms, per_term=3, most=10).select("orden", "termino", "sku", "nombre_norm")


E01 = """WITH terms(orden, termino) AS (VALUES (1, 'red widget'), (2, 'small'), (3, 'promo'), (4, 'blue bolt'), (5, 'widget'), (6, 'ring economy')),
c AS (SELECT p_partkey::VARCHAR AS sku, p_name || ' ' || lower(p_type) || ' ' || p_size AS nombre_norm FROM part WHERE p_retailprice IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY orden ORDER BY length(nombre_norm), sku) AS r FROM c JOIN terms ON list_has_all(string_split(nombre_norm, ' '), string_split(termino, ' '))),
f AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY orden, r) AS s FROM h WHERE r <= 3),
n AS (SELECT orden, coalesce(sum(count(*)) OVER (ORDER BY orden ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE s = 1 GROUP BY orden)
SELECT f.orden, termino, sku, nombre_norm FROM f JOIN n USING (orden) WHERE s = 1 AND before < 10"""


def e01_seeds(spark, d):
    """The capped selection, and two whole subcategories on top of it."""
    catalogue = table(spark, d, "part").selectExpr(
        "CAST(p_partkey AS string) AS sku", "concat(p_name, ' ', lower(p_type), ' ', p_size) AS nombre_norm", "CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END AS precio", "concat(p_type, ' ', p_size) AS subcategoria"
    )
    terms = spark.createDataFrame([(1, "red widget"), (2, "small"), (3, "promo"), (4, "blue bolt")], "orden int, termino string")
    seeds = spark.createDataFrame([(1, "PROMO 7", "a"), (2, "SMALL 3", "b"), (3, "PROMO 7", "c")], "orden int, subcategoria string, categoria string")
    return compare.with_seeds(compare.select_base(catalogue, terms, per_term=3, most=5), catalogue, seeds)


E01_SEEDS = """WITH terms(orden, termino) AS (VALUES (1, 'red widget'), (2, 'small'), (3, 'promo'), (4, 'blue bolt')),
c AS (SELECT p_partkey::VARCHAR AS sku, p_name || ' ' || lower(p_type) || ' ' || p_size AS nombre_norm, p_type || ' ' || p_size AS sub FROM part WHERE p_retailprice IS NOT NULL AND p_partkey % 9 > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY orden ORDER BY length(nombre_norm), sku) AS r FROM c JOIN terms ON list_has_all(string_split(nombre_norm, ' '), string_split(termino, ' '))),
f AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY orden, r) AS s FROM h WHERE r <= 3),
n AS (SELECT orden, coalesce(sum(count(*)) OVER (ORDER BY orden ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE s = 1 GROUP BY orden),
base AS (SELECT sku, f.orden, termino, nombre_norm FROM f JOIN n USING (orden) WHERE s = 1 AND before < 5)
SELECT sku, orden, termino, nombre_norm, NULL::VARCHAR AS categoria FROM base
UNION ALL SELECT sku, CASE sub WHEN 'PROMO 7' THEN 1 ELSE 2 END, NULL, nombre_norm, CASE sub WHEN 'PROMO 7' THEN 'a' ELSE 'b' END FROM c WHERE sub IN ('PROMO 7', 'SMALL 3') AND sku NOT IN (SELECT sku FROM base)"""


def e02_common_term(spark, d):
    """A term that every name holds, ranked over range partitions, beside a rare one."""
    catalogue = table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS sku", "concat('producto ', p_name) AS nombre_norm", "p_retailprice AS precio")
    terms = spark.createDataFrame([(1, "producto"), (2, "red widget")], "orden int, termino string")
    return compare.search_terms(catalogue, terms).select("orden", "sku", "puesto")


E02_COMMON = """WITH terms(orden, termino) AS (VALUES (1, 'producto'), (2, 'red widget')), c AS (SELECT p_partkey::VARCHAR AS sku, 'producto ' || p_name AS n FROM part)
SELECT orden, sku, row_number() OVER (PARTITION BY orden ORDER BY length(n), sku)::INT AS puesto FROM c JOIN terms ON list_has_all(string_split(n, ' '), string_split(termino, ' '))"""


def e13_places(spark, d):
    """The sorted catalogue of the last run with each row's place."""
    rows = offers(spark, d).where(F.col("run") == LAST).select("categoria", "nombre", "presentacion_kind", "id").distinct()
    return with_place(rows, [F.col("categoria"), F.col("nombre"), F.coalesce("presentacion_kind", F.lit("")), F.col("id")])


def e15_by_name(spark, d):
    """Products of the last run by name, every eleventh without one."""
    rows = offers(spark, d).where(F.col("run") == LAST).select("id", F.when(F.col("sku").cast("long") % 11 > 0, F.col("nombre")).alias("nombre")).distinct()
    return compare.by_name(rows)


def e02_basket_search(spark, d):
    """All hits of each term, a term's own list each."""
    catalogue = table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS sku", "concat(p_name, ' ', lower(p_type)) AS nombre_norm", "p_retailprice AS precio")
    terms = spark.createDataFrame([(1, "red widget"), (2, "promo ring"), (3, "nothing")], "orden int, termino string")
    return compare.search_terms(catalogue, terms).select("orden", "sku", "puesto")


E02 = """WITH terms(orden, termino) AS (VALUES (1, 'red widget'), (2, 'promo ring'), (3, 'nothing')), c AS (SELECT p_partkey::VARCHAR AS sku, p_name || ' ' || lower(p_type) AS n FROM part)
SELECT orden, sku, row_number() OVER (PARTITION BY orden ORDER BY length(n), sku)::INT AS puesto FROM c JOIN terms ON list_has_all(string_split(n, ' '), string_split(termino, ' '))"""


def e03_basket_fetch(spark, d):
    """Every fifth product of the last run as a basket over all chains, with the offers there are."""
    rows = offers(spark, d).where((F.col("run") == LAST) & (F.col("presentacion_kind") == "pack"))
    basket = rows.where(F.col("sku").cast("long") % 5 == 0).select("sku").distinct().select("sku", F.explode(F.array(*[F.lit(c) for c in CHAINS])).alias("cadena"))
    return compare.basket_offers(basket, rows.select("cadena", "sku", "precio", "en_promocion"))


E03 = f"""WITH {OFFERS}, one AS (SELECT * FROM offers WHERE run = '{LAST}' AND presentacion_kind = 'pack'), b AS (SELECT DISTINCT sku FROM one WHERE sku::BIGINT % 5 = 0)
SELECT c.cadena, b.sku, one.precio, one.en_promocion FROM b CROSS JOIN (SELECT unnest({CHAINS}) AS cadena) c LEFT JOIN one ON one.sku = b.sku AND one.cadena = c.cadena"""


def e03_run_fetch(spark, d):
    """All products of the last run as a basket over all chains, with the offers there are."""
    rows = offers(spark, d).where((F.col("run") == LAST) & (F.col("presentacion_kind") == "pack"))
    basket = rows.select("sku").distinct().select("sku", F.explode(F.array(*[F.lit(c) for c in CHAINS])).alias("cadena"))
    return compare.basket_offers(basket, rows.select("cadena", "sku", "precio", "en_promocion"))


E03_RUN = f"""WITH {OFFERS}, one AS (SELECT * FROM offers WHERE run = '{LAST}' AND presentacion_kind = 'pack'), b AS (SELECT DISTINCT sku FROM one)
SELECT c.cadena, b.sku, one.precio, one.en_promocion FROM b CROSS JOIN (SELECT unnest({CHAINS}) AS cadena) c LEFT JOIN one ON one.sku = b.sku AND one.cadena = c.cadena"""


def f01_facets(spark, d):
    return tree.facet_counts(_items(spark, d))


def _items(spark, d):
    rows = table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS sku", "p_type", "p_brand", "p_size")
    return rows.selectExpr("sku", "array(p_type, CASE WHEN p_size % 2 = 0 THEN 'PAR' END) AS categorias", "CASE WHEN p_size > 10 AND p_type <> 'PROMO' THEN array(p_brand) ELSE array() END AS subcategorias")


ITEMS = """cats AS (SELECT DISTINCT p_partkey AS sku, c, CASE WHEN p_size > 10 AND p_type <> 'PROMO' THEN p_brand END AS sub FROM (SELECT *, unnest([p_type, CASE WHEN p_size % 2 = 0 THEN 'PAR' END]) AS c FROM part) WHERE c IS NOT NULL),
tree AS (SELECT k.c AS categoria, coalesce(s.sub, '(sin subcategoría)') AS subcategoria, coalesce(s.n, k.n) AS n_sub, k.n AS n_cat
  FROM (SELECT c, count(DISTINCT sku) AS n FROM cats GROUP BY c) k LEFT JOIN (SELECT c, sub, count(DISTINCT sku) AS n FROM cats WHERE sub IS NOT NULL GROUP BY c, sub) s ON k.c = s.c)"""


def f01_rollup(spark, d):
    return tree.rollup_counts(table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS sku", "p_type AS categoria", "p_brand AS subcategoria"))


def f02_tree_summary(spark, d):
    return tree.tree_summary(tree.facet_counts(_items(spark, d)).withColumn("cadena", F.lit("asia")), ["cadena"])


def f03_merge_nodes(spark, d):
    nodes = table(spark, d, "part").selectExpr("concat(p_brand, p_size % 7) AS base", "CAST(p_partkey AS string) AS slug", "CASE WHEN p_partkey % 3 = 0 THEN p_name END AS etiqueta", "p_partkey % 5 = 0 AS directo", "p_partkey AS pos")
    return tree.merge_nodes(nodes)


F03 = """WITH n AS (SELECT p_brand || (p_size % 7) AS base, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS etiqueta, p_partkey % 5 = 0 AS directo FROM part)
SELECT base, arg_max(p_partkey, (directo, etiqueta IS NOT NULL, -p_partkey))::VARCHAR AS slug, arg_max({'e': etiqueta}, (directo, etiqueta IS NOT NULL, -p_partkey)).e AS etiqueta, max(directo) AS directo FROM n GROUP BY base"""

ALL = {
    "e01_base_selection": (e01_base_selection, E01),
    "e01_seeds": (e01_seeds, E01_SEEDS),
    "e02_basket_search": (e02_basket_search, E02),
    "e02_common_term": (e02_common_term, E02_COMMON),
    "e03_basket_fetch": (e03_basket_fetch, E03),
    "e03_run_fetch": (e03_run_fetch, E03_RUN),
    "e04_wide": (e04_wide, E04),
    "e05_cheapest_gap": (e05_cheapest_gap, f"WITH {OFFERS} {compared_sql('run, id')}"),
    "e05_coarse_prices": (e05_coarse_prices, COARSE),
    "e06_active_chains": (e06_active_chains, f"""WITH {OFFERS} {compared_sql("run, id", where="cadena IN ('asia', 'america', 'europe')")}"""),
    "e07_unit_price": (e07_unit_price, f"WITH {OFFERS} SELECT run, id, cadena, ((2 * (precio * 10000)::BIGINT + cantidad::BIGINT) // (2 * cantidad::BIGINT)) / 10000.0::DOUBLE AS ppu FROM offers"),
    "e08_twins": (e08_twins, E08),
    "e09_kpis": (e09_kpis, E09),
    "e10_win_share": (e10_win_share, E10),
    "e11_gap_alerts": (e11_gap_alerts, f"WITH {COMPARED} SELECT run, id, mas_barato, mas_caro, minimo, maximo, brecha_pct FROM compared WHERE brecha_pct > 0 ORDER BY brecha_pct DESC, run, id LIMIT 5"),
    "e12_coverage": (e12_coverage, E12),
    "e13_sorted_catalogue": (e13_sorted_catalogue, f"WITH {OFFERS} SELECT DISTINCT categoria, nombre, presentacion_kind, id FROM offers WHERE run = '{LAST}'"),
    "e13_places": (e13_places, f"WITH {OFFERS}, r AS (SELECT DISTINCT categoria, nombre, presentacion_kind, id FROM offers WHERE run = '{LAST}') SELECT *, row_number() OVER (ORDER BY categoria, nombre, presentacion_kind, id) AS puesto FROM r"),
    "e14_filtered": (e14_filtered, E14),
    "e15_by_name": (e15_by_name, f"WITH {OFFERS}, r AS (SELECT DISTINCT id, CASE WHEN sku::BIGINT % 11 > 0 THEN nombre END AS nombre FROM offers WHERE run = '{LAST}') SELECT *, row_number() OVER (ORDER BY nombre IS NULL, lower(nombre), id) AS puesto FROM r"),
    "e15_ordered": (e15_ordered, f"WITH {COMPARED} SELECT id, brecha_pct FROM compared WHERE run = '{LAST}'"),
    "e16_groups": (e16_groups, E16),
    "e17_group_competitor": (e17_group_competitor, f"WITH {OFFERS}, {GROUPED} {compared_sql('run, id', 'grouped')}"),
    "e18_positioning": (e18_positioning, E18),
    "e19_above_market": (e19_above_market, E19),
    "e20_promotions": (e20_promotions, f"WITH {OFFERS} SELECT cadena, count(*) AS ofertas, count(*) FILTER (en_promocion) AS promos, round(100 * count(*) FILTER (en_promocion) / count(*), 1) AS pct FROM offers GROUP BY cadena"),
    "e20_competitiveness": (e20_competitiveness, E20),
    "e21_real_discount": (e21_real_discount, f"WITH {OFFERS} SELECT run, id, cadena, round((100 * (precio_regular - precio))::DOUBLE / precio_regular::DOUBLE, 1) AS descuento FROM offers"),
    "f01_facets": (f01_facets, f"WITH {ITEMS} SELECT * FROM tree"),
    "f01_rollup": (f01_rollup, "SELECT p_type AS categoria, p_brand AS subcategoria, count(DISTINCT p_partkey) AS n, grouping_id(p_type, p_brand) AS nivel FROM part GROUP BY ROLLUP (p_type, p_brand)"),
    "f02_tree_summary": (f02_tree_summary, f"WITH {ITEMS} SELECT 'asia' AS cadena, count(DISTINCT categoria) AS n_categorias, count(DISTINCT subcategoria) AS n_subcategorias, count(*) AS n_pares, sum(n_sub)::BIGINT AS total FROM tree"),
    "f03_merge_nodes": (f03_merge_nodes, F03),
}
assert BEFORE < LAST
