"""Tables for output (A) and raw records to offers (B), over records that Spark composes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.operators import compare, history
from gondola.plans.history_queries import TREND
from gondola.plans.offerview import CHAINS, LAST, OFFERS, offers, table
from gondola.sources import mappers
from gondola.sources import offers as io
from gondola.sources.folders import new_folder


def a01_jsonl(spark, d):
    """The last run's offers as JSON lines in folders by chain, read back."""
    rows = offers(spark, d).where(F.col("run") == LAST)
    path = new_folder(spark, "offers")
    io.write_offers(rows.select("cadena", "sku", F.col("nombre").alias("nombre_origen"), "precio", "precio_regular", "en_promocion", "presentacion_kind", "marca", "categoria", "stock"), path)
    return io.read_offers(spark, path).select("cadena", "sku", "nombre_origen", "precio", "en_promocion", "presentacion_kind", "stock")


def a02_basket(spark, d):
    rows = offers(spark, d).where((F.col("run") == LAST) & (F.col("presentacion_kind") == "pack"))
    basket = rows.groupBy("sku", "nombre", "categoria").agg(F.map_from_entries(F.collect_list(F.struct("cadena", "sku"))).alias("skus"))
    short = basket.withColumn("skus", F.map_filter("skus", lambda k, v: ~k.isin("america", "europe")))
    return io.basket_rows(short, "asia", ["america", "europe"]).select("match_id", "categoria", "nombre", "cadena", "sku")


A02 = f"""WITH {OFFERS}, b AS (SELECT DISTINCT sku, nombre, categoria FROM offers WHERE run = '{LAST}' AND presentacion_kind = 'pack')
SELECT sku AS match_id, categoria, nombre, cadena, sku FROM b JOIN (SELECT DISTINCT sku, cadena FROM offers WHERE run = '{LAST}' AND presentacion_kind = 'pack' AND cadena NOT IN ('america', 'europe')
UNION SELECT sku, unnest(['america', 'europe']) FROM b) USING (sku)"""


def _csv(df, name, order):
    """Written as CSV in order, and read back."""
    path = new_folder(df.sparkSession, name)
    io.write_csv(df, path, order=order)
    return io.read_csv(df.sparkSession, path, df.schema)


def a05_comparison_csv(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST).withColumn("capturado_en", F.col("run"))
    back = _csv(io.comparison_csv(rows, ["id"], CHAINS), "comparison", ["id"])
    return back.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in back.columns])


_CELLS = ", ".join(f"any_value({v}) FILTER (cadena = '{c}') AS {c.replace(' ', '_')}_{n}" for c in CHAINS for v, n in (("precio", "precio"), ("precio_regular", "regular"), ("en_promocion", "promo")))
A05 = f"""WITH {OFFERS}, one AS (SELECT * FROM offers WHERE run = '{LAST}'), w AS (
  SELECT id, {_CELLS}, min(precio) AS lo, max(precio) AS hi, count(*) AS n, arg_min(cadena, precio) AS best FROM one GROUP BY id
) SELECT * EXCLUDE (lo, hi, n, best), CASE WHEN n >= 2 THEN CASE WHEN (SELECT count(*) FROM one o WHERE o.id = w.id AND o.precio = w.lo) > 1 THEN 'empate' ELSE best END END AS mas_barato,
  CASE WHEN n >= 2 THEN hi - lo END AS brecha_abs, CASE WHEN n >= 2 THEN round((100 * (hi - lo))::DOUBLE / lo::DOUBLE, 1) END AS brecha_pct, '{LAST}' AS capturado_en FROM w"""


def a06_history_csv(spark, d):
    return _csv(io.history_csv(offers(spark, d), ["run", "id"]), "history-csv", ["run", "id", "cadena"]).withColumn("promo", F.coalesce("promo", F.lit("")))


def _document(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST).withColumn("precio_por_unidad", compare.unit_price(F.col("precio"), F.col("cantidad").cast("decimal(12,0)"))).withColumn("url", F.when(F.col("cadena") == "asia", F.concat(F.lit("/"), "id")))
    return io.snapshot_document(rows, rows.select("id", "nombre", "categoria").distinct())


def a08_snapshot_document(spark, d):
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias(c)
    return _document(spark, d).select("id", "nombre", "categoria", flat("precios"), flat("promos"), flat("urls"))


A08 = f"""WITH {OFFERS} SELECT id, nombre, categoria, string_agg(cadena || '=' || precio::VARCHAR, ';' ORDER BY cadena) AS precios, string_agg(cadena || '=' || en_promocion::VARCHAR, ';' ORDER BY cadena) AS promos,
coalesce(string_agg('asia=/' || id, ';') FILTER (cadena = 'asia'), '') AS urls FROM offers WHERE run = '{LAST}' GROUP BY id, nombre, categoria"""


def a08_annotated_document(spark, d):
    """The last run's document with trends, promotion changes and the new flag, written as JSON and read back."""
    rows = offers(spark, d)
    trended = history.with_trend(history.with_previous(rows.where(F.col("run") == LAST), history.latest_before(rows, LAST)))
    document, path = io.annotated_document(_document(spark, d), trended), new_folder(spark, "document")
    io.write_document(document, path)
    back = spark.read.schema(document.schema).json(path)
    number = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    flat = lambda c, value: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], value(e["value"]))), ";").alias(c)
    return back.select(
        "id", "nombre", "nuevo", flat("precios", number), flat("precio_unidad", lambda x: number(x.cast("decimal(20,4)"))),
        flat("tendencia", lambda t: F.concat_ws(":", t["dir"], number(t["antes"]), number(t["delta_pct"].cast("decimal(12,1)")))), flat("promo_cambio", lambda x: x),
    )


A08A = f"""WITH {TREND}, t AS (SELECT * FROM trend WHERE run = '{LAST}') SELECT id, nombre, CASE WHEN bool_or(es_nuevo) THEN true END AS nuevo, string_agg(cadena || '=' || precio::VARCHAR, ';' ORDER BY cadena) AS precios,
  string_agg(cadena || '=' || (((2 * (precio * 10000)::BIGINT + cantidad::BIGINT) // (2 * cantidad::BIGINT))::DECIMAL(20,4) / 10000)::DECIMAL(20,4)::VARCHAR, ';' ORDER BY cadena) AS precio_unidad,
  string_agg(cadena || '=' || dir || ':' || coalesce(p_precio::VARCHAR, '-') || ':' || coalesce(delta_pct::DECIMAL(12,1)::VARCHAR, '-'), ';' ORDER BY cadena) AS tendencia,
  string_agg(cadena || '=' || CASE promo_cambio WHEN 'inicia' THEN 'inicia' ELSE 'fin' END, ';' ORDER BY cadena) FILTER (promo_cambio IS NOT NULL) AS promo_cambio FROM t GROUP BY id, nombre"""


def a08_snapshot_header(spark, d):
    head = io.snapshot_header(_document(spark, d), CHAINS)
    return head.withColumn("categorias", F.array_join("categorias", ","))


A08H = f"""WITH {OFFERS}, one AS (SELECT * FROM offers WHERE run = '{LAST}') SELECT count(DISTINCT id) AS total, {", ".join(f"count(DISTINCT id) FILTER (cadena = '{c}') AS con_{c.replace(' ', '_')}" for c in CHAINS)}, string_agg(DISTINCT categoria, ',' ORDER BY categoria) AS categorias FROM one"""


def b01_search_hits(spark, d):
    hits = table(spark, d, "part").selectExpr(
        "CAST(p_partkey AS string) AS objectID", "p_name AS name", "CASE WHEN p_size % 4 > 0 THEN replace(p_name, ' ', '-') END AS uri", "p_retailprice AS priceList",
        "CASE WHEN p_size % 3 = 0 THEN 0.0D WHEN p_size % 3 = 1 THEN p_retailprice - 1 END AS pricePromo", "CAST(p_size % 2 AS double) AS priceWithCard", "p_size % 5 = 0 AS withPromotion", "p_brand AS brand",
        "' ' AS laboratory", "p_brand AS lab", "CAST(NULL AS string) AS activePrinciples", "'' AS presentation", "array(' ', p_type) AS category", "array(CAST(NULL AS string)) AS subCategory",
        "CAST(NULL AS string) AS prescription", "CAST(NULL AS string) AS image", "'' AS gtin", "CAST(NULL AS string) AS skuMifarma", "CAST(NULL AS string) AS skuSap",
    )
    return mappers.from_search_hits(hits, "asia", "https://example.com").select("cadena", "sku", "precio", "precio_tarjeta", "en_promocion", "laboratorio", "categoria", "subcategoria", "url", "ean")


B01 = """SELECT 'asia' AS cadena, p_partkey::VARCHAR AS sku, CASE WHEN p_size % 3 = 1 THEN p_retailprice - 1 ELSE p_retailprice END AS precio, CASE WHEN p_size % 2 = 1 THEN 1.0::DOUBLE END AS precio_tarjeta,
p_size % 5 = 0 OR p_size % 3 = 1 AS en_promocion, p_brand AS laboratorio, p_type AS categoria, NULL::VARCHAR AS subcategoria,
CASE WHEN p_size % 4 > 0 THEN 'https://example.com/producto/' || replace(p_name, ' ', '-') || '/' || p_partkey END AS url, NULL::VARCHAR AS ean FROM part"""


def b02_details(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "CAST(p_partkey AS string) AS id", "p_name AS slug", "p_name AS name", "p_brand AS brand", "CAST(NULL AS string) AS prescription", "array(named_struct('url', p_name)) AS imageList", "'' AS eanCode",
        "CAST(p_partkey + 77500000 AS string) AS gtin", "CAST(NULL AS string) AS skuMifarma", "CAST(NULL AS string) AS sapCode", "CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS pricePack", "p_retailprice / 2 AS price",
        "CASE WHEN p_size % 10 > 0 THEN concat('Caja ', p_size, ' UN') END AS noFractionatedText", "CASE WHEN p_size % 4 = 0 THEN p_retailprice END AS crossOutPL", "p_size % 3 = 0 AS fractionalMode",
        "p_retailprice / 8 AS fractionatedPrice", "concat('Frasco ', p_size, ' ml') AS fractionatedText", "CAST(NULL AS double) AS crossOutFractionatedPL",
    )
    return mappers.from_details(rows, "asia").select("sku", "presentacion_kind", "precio", "en_promocion", "cantidad_envase", "unidad_envase", "precio_por_unidad", "ean", "imagen")


B02 = """WITH r AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_retailprice / 2 END AS pp FROM part)
SELECT p_partkey::VARCHAR AS sku, 'pack' AS presentacion_kind, pp AS precio, p_size % 4 = 0 AS en_promocion, p_size::DOUBLE AS cantidad_envase, 'un' AS unidad_envase, CASE WHEN p_size <> 0 THEN round(pp / p_size, 4) END AS precio_por_unidad,
(p_partkey + 77500000)::VARCHAR AS ean, p_name AS imagen FROM r WHERE p_size % 10 > 0
UNION ALL SELECT p_partkey::VARCHAR, 'fraccion', p_retailprice / 8, false, p_size::DOUBLE, 'ml', CASE WHEN p_size <> 0 THEN round(p_retailprice / 8 / p_size, 4) END, (p_partkey + 77500000)::VARCHAR, p_name FROM r WHERE p_size % 3 = 0"""


def b03_quick_views(spark, d):
    raw = table(spark, d, "part").selectExpr(
        "to_json(named_struct('product', named_struct('id', CAST(p_partkey AS string), 'productName', p_name, 'brand', p_brand, 'price', named_struct('sales', named_struct('value', p_retailprice), 'list',"
        " CASE WHEN p_size % 2 = 0 THEN named_struct('value', p_retailprice + 1) END), 'pricebookPrices', named_struct('listPrice', CASE WHEN p_size % 3 = 0 THEN named_struct('value', p_retailprice + 2) END),"
        " 'custom', named_struct('medicalPrescription', CASE WHEN p_size % 4 > 0 THEN p_size % 4 = 1 END, 'healthRegistrationNumber', concat('R', p_partkey)), 'available', CASE WHEN p_size % 5 > 0 THEN p_size % 5 = 1 END))) AS json"
    )
    return mappers.from_quick_views(raw, "europe").select("sku", "precio", "precio_regular", "en_promocion", "prescripcion", "stock", "ean")


B03 = """SELECT p_partkey::VARCHAR AS sku, p_retailprice AS precio, CASE WHEN p_size % 2 = 0 THEN p_retailprice + 1 WHEN p_size % 3 = 0 THEN p_retailprice + 2 ELSE p_retailprice END AS precio_regular,
p_size % 2 = 0 OR p_size % 3 = 0 AS en_promocion, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'con receta' ELSE 'sin receta' END AS prescripcion, CASE WHEN p_size % 5 > 0 THEN p_size % 5 = 1 END AS stock, 'R' || p_partkey AS ean FROM part"""


def b04_store_products(spark, d):
    seller = "named_struct('commertialOffer', named_struct('Price', p_retailprice, 'ListPrice', p_retailprice + p_size % 2, 'PriceWithoutDiscount', p_retailprice, 'Teasers', CAST(array() AS array<string>), 'PromotionTeasers', CAST(NULL AS array<string>), 'DiscountHighLight', CAST(NULL AS array<string>), 'AvailableQuantity', CAST(p_size % 3 AS double), 'IsAvailable', CAST(NULL AS boolean)))"
    item = f"named_struct('itemId', concat(p_partkey, '-', i), 'nameComplete', ' ', 'name', p_name, 'ean', concat('7750', p_partkey * 1000, CASE WHEN i = 1 THEN 'x' ELSE '' END), 'images', CAST(array() AS array<struct<imageUrl:string>>), 'sellers', array({seller}))"
    rows = table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS productId", "p_name AS productName", "p_brand AS brand", "'/l' AS link", "array(p_type) AS `Presentación`", "CAST(NULL AS array<string>) AS `Requiere receta médica`", f"transform(array(0, 1), i -> {item}) AS items")
    return mappers.from_store_products(rows, "africa").select("sku", "nombre_origen", "precio", "precio_regular", "en_promocion", "stock", "presentacion", "ean")


B04 = """SELECT p_partkey || '-' || i AS sku, p_name AS nombre_origen, p_retailprice AS precio, p_retailprice + p_size % 2 AS precio_regular, p_size % 2 = 1 AS en_promocion, p_size % 3 > 0 AS stock, p_type AS presentacion,
CASE WHEN i = 0 AND length('7750' || (p_partkey * 1000)) BETWEEN 8 AND 14 THEN '7750' || (p_partkey * 1000) END AS ean FROM part, (VALUES (0), (1)) t(i)"""


def b06_tiles(spark, d):
    tile = "concat('<div class=\"col\"><div class=\"product\" data-pid=\"', p_partkey, '\"><a href=\"/p/', p_partkey, '\">', p_name, '</a><img class=\"tile-image\" alt=\"', CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, '\" src=\"/i.png\"><span class=\"sales\">', CASE WHEN p_size % 3 = 0 THEN concat('<span class=\"value\" content=\"', p_size, '.5\">') ELSE '' END, 'S/ 1,2', p_size, '.50</span></div></div>')"
    pages = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(F.expr(tile)), "").alias("html"))
    return mappers.from_tiles(pages, "europe", "https://example.com").select("sku", "nombre_origen", "precio", "url", "imagen")


B06 = "SELECT p_partkey::VARCHAR AS sku, p_name AS nombre_origen, CASE WHEN p_size % 3 = 0 THEN p_size + 0.5 ELSE ('12' || p_size || '.50')::DOUBLE END AS precio, 'https://example.com/p/' || p_partkey AS url, '/i.png' AS imagen FROM part"


def b07_declared_paths(spark, d):
    return mappers.from_paths(table(spark, d, "events").withColumn("json", F.col("props")), {"k": ("q[0].z | k", "int"), "texto": ("k", "string"), "nada": ("no.hay", "double")}).groupBy("k", "texto", "nada").agg(F.count("*").alias("n"))


def b08_first_seen(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sku"), F.struct("l_shipdate", "l_orderkey", "l_extendedprice", "l_linenumber", "l_suppkey").alias("arrival"), F.array("l_returnflag").alias("channels"), F.col("l_extendedprice").alias("precio"))
    return mappers.first_seen(rows, channel="A", priced=True).select("sku", "precio")


B08 = "SELECT l_partkey AS sku, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice, l_linenumber, l_suppkey)) AS precio FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey"


def b09_page_audit(spark, d):
    pages = table(spark, d, "pages").select(
        "page_id", "url", F.when(F.col("page_id") % 3 == 0, 403).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.create_map(F.lit("Server"), F.when(F.col("page_id") % 5 == 0, "CloudFlare").otherwise("x")).alias("headers"),
        F.concat(F.when(F.col("page_id") % 2 == 0, "Just a Moment ").otherwise(""), "html").alias("body"),
    )
    return mappers.audit_pages(pages).select("page_id", F.array_join("senales", ";").alias("senales"), "reto", "extension", "slug")


_SIGNS = "[" + ", ".join(f"'{s}'" for s in mappers.CHALLENGE_SIGNS) + "]"
B09 = f"""WITH s AS (SELECT page_id, url, list_filter({_SIGNS}, lambda s: contains(lower(substr(CASE WHEN page_id % 2 = 0 THEN 'Just a Moment ' ELSE '' END || html, 1, 8192)), s)) AS l FROM pages)
SELECT page_id, concat_ws(';', CASE WHEN page_id % 5 = 0 THEN 'server=CloudFlare' END, CASE WHEN len(l) > 0 THEN 'body:' || array_to_string(l, ',') END) AS senales,
page_id % 3 = 0 AND (len(l) > 0 OR page_id % 5 = 0) AS reto, 'html' AS extension, substr(trim(regexp_replace(lower(url), '[^a-z0-9._-]+', '_', 'g'), '_'), 1, 60) AS slug FROM s"""

ALL = {
    "a01_jsonl": (a01_jsonl, f"WITH {OFFERS} SELECT cadena, sku, nombre AS nombre_origen, precio, en_promocion, presentacion_kind, stock FROM offers WHERE run = '{LAST}'"),
    "a02_basket": (a02_basket, A02),
    "a05_comparison_csv": (a05_comparison_csv, A05),
    "a06_history_csv": (a06_history_csv, f"WITH {OFFERS} SELECT run, id, cadena, precio, precio_regular, CASE WHEN en_promocion THEN 'si' ELSE '' END AS promo FROM offers"),
    "a08_snapshot_document": (a08_snapshot_document, A08),
    "a08_annotated_document": (a08_annotated_document, A08A),
    "a08_snapshot_header": (a08_snapshot_header, A08H),
    "b01_search_hits": (b01_search_hits, B01),
    "b02_details": (b02_details, B02),
    "b03_quick_views": (b03_quick_views, B03),
    "b04_store_products": (b04_store_products, B04),
    "b06_tiles": (b06_tiles, B06),
    "b07_declared_paths": (b07_declared_paths, "SELECT (props->>'k')::INT AS k, props->>'k' AS texto, NULL::DOUBLE AS nada, count(*) AS n FROM events GROUP BY ALL"),
    "b08_first_seen": (b08_first_seen, B08),
    "b09_page_audit": (b09_page_audit, B09),
}
