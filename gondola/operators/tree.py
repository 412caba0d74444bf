"""Category trees: facet counts, summaries, merging of menu nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_SUBCATEGORY = "(sin subcategoría)"


def facet_counts(items: DataFrame) -> DataFrame:
    """categoria, subcategoria, n_sub, n_cat. Inputs: sku, categorias, subcategorias (arrays); an item counts in each of its categories.

    A category without any subcategory gives one row of NO_SUBCATEGORY with n_sub = n_cat.
    """
    each = items.select("sku", F.explode(F.array_distinct("categorias")).alias("categoria"), "subcategorias").where("categoria is not null")
    by_cat = each.groupBy("categoria").agg(F.count_distinct("sku").alias("n_cat"))
    pairs = each.select("sku", "categoria", F.explode("subcategorias").alias("subcategoria")).where("subcategoria is not null").distinct()
    by_sub = pairs.groupBy("categoria", "subcategoria").agg(F.count("*").alias("n_sub"))
    out = by_cat.join(by_sub, "categoria", "left")
    return out.select("categoria", F.coalesce("subcategoria", F.lit(NO_SUBCATEGORY)).alias("subcategoria"), F.coalesce("n_sub", "n_cat").alias("n_sub"), "n_cat")


def rollup_counts(items: DataFrame) -> DataFrame:
    """Distinct skus per (categoria, subcategoria) with subtotals and the total; nivel is the grouping id. Input: flat sku, categoria, subcategoria."""
    return items.distinct().rollup("categoria", "subcategoria").agg(F.count_distinct("sku").alias("n"), F.grouping_id().alias("nivel"))


def tree_summary(tree: DataFrame, by: list[str]) -> DataFrame:
    """Per group: categories, distinct subcategories, pairs, and the sum of n_sub."""
    return tree.groupBy(*by).agg(
        F.count_distinct("categoria").alias("n_categorias"), F.count_distinct("subcategoria").alias("n_subcategorias"), F.count("*").alias("n_pares"), F.sum("n_sub").alias("total")
    )


def merge_nodes(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """One node for each base slug, by a fold in the given order: a later node replaces the held one if it links directly and that one doesn't,
    or if both agree on that and only it has a label. Inputs: base, slug, etiqueta, directo, pos. A base's nodes are a menu's few."""
    row = F.struct(F.col(order).alias("pos"), "slug", "etiqueta", F.coalesce("directo", F.lit(False)).alias("directo"))
    held = nodes.groupBy("base").agg(F.array_sort(F.collect_list(row)).alias("_all"))

    def better(x, y):
        same = y["directo"] == x["directo"]
        take = (y["directo"] & ~x["directo"]) | (same & x["etiqueta"].isNull() & y["etiqueta"].isNotNull())
        return F.when(take, y).otherwise(x)

    return held.withColumn("_w", F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.get("_all", F.lit(0)), better)).select("base", "_w.slug", "_w.etiqueta", "_w.directo")
