"""The offer view over the test tables, in DataFrames and in SQL, and names composed from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAINS = ["africa", "america", "asia", "europe", "middle east"]
GROUPS = {"america": "grupo 1", "europe": "grupo 1"}
LAST, BEFORE = "2001", "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer a (run, id, cadena): the least of its lines by price, regular price, promotion, quantity, flag."""
    t = lambda n: table(spark, sf_dir, n)
    regular, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    chains = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    chains = chains.select("s_suppkey", F.lower("r_name").alias("cadena"))
    lines = t("lineitem").join(chains, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.year("l_shipdate").cast("string").alias("run"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.when(F.col("l_linestatus") == "O", "pack").otherwise("fraccion").alias("presentacion_kind"),
        "cadena",
        (regular * (1 - discount)).cast("decimal(12,2)").alias("precio"),
        regular.alias("precio_regular"),
        (discount >= 0.05).alias("en_promocion"),
        F.col("l_quantity").alias("cantidad"),
        F.col("l_returnflag").alias("bandera"),
    )
    least = lines.groupBy("run", "sku", "presentacion_kind", "cadena").agg(F.min(F.struct("precio", "precio_regular", "en_promocion", "cantidad", "bandera")).alias("o"))
    parts = t("part").select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("nombre"), F.col("p_brand").alias("marca"), F.col("p_type").alias("categoria"))
    stock = F.when(F.col("bandera") == "A", True).when(F.col("bandera") == "R", False)
    return least.select("run", "sku", "presentacion_kind", "cadena", "o.*").join(parts, "sku").withColumn("id", F.concat_ws(":", "sku", "presentacion_kind")).withColumn("stock", stock)


OFFERS = """
lines AS (
  SELECT year(l_shipdate)::VARCHAR AS run, l_partkey::VARCHAR AS sku, CASE WHEN l_linestatus = 'O' THEN 'pack' ELSE 'fraccion' END AS presentacion_kind,
    lower(r_name) AS cadena, (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(12,2) AS precio, l_extendedprice::DECIMAL(12,2) AS precio_regular,
    l_discount::DECIMAL(4,2) >= 0.05 AS en_promocion, l_quantity AS cantidad, l_returnflag AS bandera
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY run, sku, presentacion_kind, cadena ORDER BY precio, precio_regular, en_promocion, cantidad, bandera) AS rn FROM lines
), offers AS (
  SELECT run, sku, presentacion_kind, cadena, precio, precio_regular, en_promocion, cantidad, bandera, p_name AS nombre, p_brand AS marca, p_type AS categoria,
    sku || ':' || presentacion_kind AS id, CASE bandera WHEN 'A' THEN true WHEN 'R' THEN false END AS stock
  FROM picked JOIN part ON sku = p_partkey::VARCHAR WHERE rn = 1
)"""

NAME_A = """replace(p_name, ' ', '') || CASE WHEN p_partkey % 7 = 0 THEN ' Forte' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ' Niños' ELSE '' END
  || CASE WHEN p_partkey % 13 = 0 THEN ' Vitamina C' ELSE '' END || ' ' || p_size || CASE WHEN p_partkey % 5 = 0 THEN ' g ' WHEN p_partkey % 3 = 0 THEN '0mg/5 ml ' ELSE '0 mg ' END
  || CASE p_type WHEN 'ECONOMY' THEN 'Tabletas' WHEN 'STANDARD' THEN 'Jarabe' WHEN 'MEDIUM' THEN 'Cápsulas' WHEN 'PROMO' THEN 'Polvo Efervescente' WHEN 'LARGE' THEN 'Gomitas' ELSE 'Solución' END
  || ' - ' || CASE WHEN p_type = 'STANDARD' THEN 'Frasco ' || (p_size * 10) || ' ML' WHEN p_type = 'LARGE' THEN 'Lata ' || p_size || ' KG' ELSE 'Caja ' || p_size || ' UN' END"""
NAME_B = """replace(p_name, ' ', '') || CASE WHEN p_partkey % 14 = 0 THEN ' Forte' ELSE '' END || CASE WHEN p_partkey % 22 = 0 THEN ' infantil' ELSE '' END
  || CASE WHEN p_partkey % 26 = 0 THEN ' Vitamina D' WHEN p_partkey % 13 = 0 THEN ' Vitamina C' ELSE '' END || ' ' || p_size || '0mg '
  || CASE p_type WHEN 'ECONOMY' THEN 'Comprimido' WHEN 'STANDARD' THEN 'Jarabe' WHEN 'MEDIUM' THEN 'Capsula' WHEN 'PROMO' THEN 'Efervescente' WHEN 'LARGE' THEN 'Tableta' ELSE 'Gotas' END
  || CASE WHEN p_type = 'STANDARD' THEN ' ' || (p_size * 10) || 'ml' WHEN p_type = 'LARGE' THEN ' ' || p_size || ' kg' ELSE ' x ' || p_size END"""


def named(spark: SparkSession, sf_dir: str, wording: str) -> DataFrame:
    """id, sku, ean, nombre_origen of all parts in one chain's wording; every third part's sku differs, and every fifth has an ean."""
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS string) AS id",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('X', p_partkey) ELSE CAST(p_partkey AS string) END AS sku" if wording == NAME_B else "CAST(p_partkey AS string) AS sku",
        "CASE WHEN p_partkey % 5 = 0 THEN concat('77500', p_partkey) END AS ean",
        f"{wording} AS nombre_origen",
    )
