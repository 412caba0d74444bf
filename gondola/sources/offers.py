"""Reading and writing of offers, baskets, snapshots, comparison tables and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.operators.compare import gap_columns, wide

#: The offer: one chain's offer of one product at one instant.
TEXTS = (
    "etiqueta_promo", "marca", "laboratorio", "principio_activo", "presentacion", "presentacion_kind", "unidad_envase", "categoria", "subcategoria",
    "prescripcion", "url", "imagen", "ean", "sku_mifarma", "sku_sap",
)
OFFER = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("cadena", "sku", "nombre_origen")]
    + [T.StructField(n, T.DecimalType(12, 2)) for n in ("precio", "precio_regular", "precio_tarjeta")]
    + [T.StructField(n, T.BooleanType()) for n in ("en_promocion", "stock")]
    + [T.StructField(n, T.DoubleType()) for n in ("cantidad_envase", "precio_por_unidad")]
    + [T.StructField(n, T.StringType()) for n in TEXTS]
    + [T.StructField("capturado_en", T.TimestampType())]
)
EVENT_COLUMNS = ["fecha", "tipo_evento", "cadena", "producto", "valor_anterior", "valor_nuevo", "delta_pct"]


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offers from JSON lines, one an offer; lines that aren't JSON, or lack a required field, are left out."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in OFFER), T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where("_bad is null and cadena is not null and sku is not null and nombre_origen is not null").drop("_bad")
    return good.withColumn("en_promocion", F.coalesce("en_promocion", F.lit(False)))


def write_offers(offers: DataFrame, path: str, kind: str = "json") -> None:
    """One JSON line (or Parquet row) an offer, in folders by chain."""
    offers.write.mode("overwrite").partitionBy("cadena").format(kind).save(path)


def basket_rows(basket: DataFrame, lead: str, group: list[str]) -> DataFrame:
    """(match_id, categoria, nombre, cadena, sku) of a basket (categoria, nombre, skus map, sku).

    The short form sku fills in chains of the group that skus doesn't name; blank skus drop
    out; match_id is the lead chain's sku, else the first of the map.
    """
    own = F.coalesce("skus", F.create_map().cast("map<string,string>"))
    short = F.map_from_arrays(F.array(*[F.lit(c) for c in group]), F.array_repeat("sku", len(group))) if group else F.create_map().cast("map<string,string>")
    extra = F.map_filter(F.when(F.col("sku").isNotNull(), short).otherwise(F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    whole = F.map_filter(F.map_concat(own, extra), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    rows = basket.withColumn("_skus", whole)
    match = F.coalesce(F.try_element_at("_skus", F.lit(lead)), F.get(F.map_values("_skus"), F.lit(0)))
    return rows.withColumn("match_id", match).select("match_id", "categoria", "nombre", F.explode("_skus").alias("cadena", "sku"))


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Add the run's rows to the history; nothing is overwritten."""
    snapshot.write.mode("append").partitionBy("run").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The history; runs stay text, as stamps sort by time. A part that can't be read gives no rows: see unreadable_parts."""
    kept = T.StructType.fromDDL(schema) if schema else spark.read.option("ignoreCorruptFiles", "true").parquet(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "run" else f.dataType) for f in kept])
    return spark.read.schema(text).option("ignoreCorruptFiles", "true").parquet(path)


def unreadable_parts(history: DataFrame) -> DataFrame:
    """run, file of the parts of read_history() that gave no rows: broken ones (and ones written without rows). Only footers are read."""
    spark = history.sparkSession
    # who lists files escapes their names once or twice, and writes file: with one slash or three
    plain = F.regexp_replace(F.url_decode(F.url_decode("file")), "^([^/]*):/+", "$1:/")
    seen = history.select(F.col("_metadata.file_path").alias("file")).distinct().select(plain.alias("_plain"))
    listed = spark.createDataFrame([(f,) for f in history.inputFiles()], "file string").withColumn("_plain", plain)
    missing = listed.join(seen, "_plain", "left_anti")
    return missing.select(F.regexp_extract("_plain", "/run=([^/]*)/", 1).alias("run"), "file")


def sound_history(history: DataFrame) -> DataFrame:
    """The history without the runs that have a part which can't be read, so that the run before is compared with instead of half a run."""
    broken = unreadable_parts(history).select("run").distinct()
    return history.join(F.broadcast(broken), "run", "left_anti")  # a row a run


def comparison_csv(prices: DataFrame, keys: list[str], chains: list[str]) -> DataFrame:
    """The wide table: three columns a chain, then mas_barato, brecha_abs, brecha_pct, capturado_en."""
    table = wide(prices, keys, chains, stamp="capturado_en")
    cells = [F.col(f"{c}_precio") for c in chains]
    known = F.filter(F.array(*cells), lambda x: x.isNotNull())
    low, high, n = F.array_min(known), F.array_max(known), F.size(known)
    best: Column = F.lit(None).cast("string")
    for c in reversed(chains):
        best = F.when(F.col(f"{c}_precio") == low, c).otherwise(best)
    ties = F.size(F.filter(known, lambda x: x == low))
    return table.withColumns({"mas_barato": F.when(n >= 2, F.when(ties > 1, "empate").otherwise(best)), **gap_columns(low, high, n)})


def history_csv(prices: DataFrame, keys: list[str]) -> DataFrame:
    """One row a (product, chain) with an offer; promo as 'si' or ''."""
    return prices.where("precio is not null").select(*keys, "cadena", "precio", "precio_regular", F.when(F.col("en_promocion"), "si").otherwise("").alias("promo"))


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """CSV with a header, empty fields for nulls, in folders if asked; with an order, its files follow one another in it (ranges of rows, sorted)."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_csv() wrote; empty fields are null."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def snapshot_document(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Nested product rows: maps by chain of precios, precio_unidad, promos, urls; null unit prices and urls are left out of their maps.

    prices: id, cadena, precio, precio_por_unidad, en_promocion, url; products: id and what describes it.
    """
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct("cadena", c))
    by_chain = lambda c, name: F.map_from_entries(F.array_sort(F.collect_list(entry(c)))).alias(name)
    maps = prices.where("precio is not null").groupBy("id").agg(by_chain("precio", "precios"), by_chain("precio_por_unidad", "precio_unidad"), by_chain("en_promocion", "promos"), by_chain("url", "urls"))
    return products.join(maps, "id")


def annotated_document(document: DataFrame, trended: DataFrame) -> DataFrame:
    """snapshot_document() with tendencia (map by chain of dir, antes, delta_pct), promo_cambio (map by chain of 'inicia', 'fin') and nuevo (true or null) of with_trend() rows; without changes the maps are null."""
    way = F.struct("cadena", F.struct("dir", F.col("p_precio").alias("antes"), "delta_pct").alias("t"))
    promo = F.struct("cadena", F.when(F.col("promo_cambio") == "inicia", "inicia").otherwise("fin").alias("p"))
    some = lambda kept, what: F.array_sort(F.collect_list(F.when(kept, what)))
    maps = trended.groupBy("id").agg(some(F.col("dir").isNotNull(), way).alias("w"), some(F.col("promo_cambio").isNotNull(), promo).alias("p"), F.max("es_nuevo").alias("n"))
    filled = lambda c: F.when(F.size(c) > 0, F.map_from_entries(c))
    maps = maps.select("id", filled("w").alias("tendencia"), filled("p").alias("promo_cambio"), F.when(F.col("n"), True).alias("nuevo"))
    return document.join(maps, "id", "left")


def write_document(document: DataFrame, path: str) -> None:
    """One JSON object a product; what is null is left out."""
    document.write.mode("overwrite").json(path)


def snapshot_header(document: DataFrame, chains: list[str]) -> DataFrame:
    """One row: total, con_<chain> counts, sorted categorias."""
    counts = [F.count_if(F.map_contains_key("precios", c)).alias(f"con_{c.replace(' ', '_')}") for c in chains]
    return document.agg(F.count("*").alias("total"), *counts, F.array_sort(F.collect_set("categoria")).alias("categorias"))
