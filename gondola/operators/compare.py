"""Product x chain comparison: cheapest and dearest chain, gaps, KPIs, user queries. Facts are long rows (id, cadena, precio, ...)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.operators.ranking import first_rows, with_place

TIE = "empate"


def rank_of(chain: Column, order: list[str]) -> Column:
    """Place of a chain in the fixed order; others come last."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), chain)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def gap_columns(low: Column, high: Column, n: Column) -> dict[str, Column]:
    """brecha_abs (2 places) and brecha_pct (1 place; null where the least is 0), null under two prices."""
    gap = F.when(n >= 2, F.round(high - low, 2))
    return {"brecha_abs": gap, "brecha_pct": F.when(n >= 2, F.round(F.try_divide(100 * (high - low), low), 1)).cast("double")}


def cheapest(prices: DataFrame, keys: list[str], chains: list[str] | None = None, price: str = "precio") -> DataFrame:
    """Per product: n, minimo, maximo, mas_barato, mas_caro (chain, or 'empate'), brecha_abs, brecha_pct. With fewer than two prices the last four are null.

    Null prices count as absent. chains limits the comparison to active chains. One pass with
    partial aggregation: how many chains stand at the least price is found by counting per price.
    """
    rows = prices.where(F.col(price).isNotNull())
    if chains is not None:
        rows = rows.where(F.col("cadena").isin(chains))
    per_price = rows.groupBy(*keys, F.col(price).alias("_p")).agg(F.count("*").alias("_n"), F.min("cadena").alias("_c"))
    one = F.struct(F.col("_p"), F.col("_n"), F.col("_c"))
    out = per_price.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min(one).alias("_lo"), F.max(one).alias("_hi"))
    name = lambda x: F.when(F.col("n") >= 2, F.when(x["_n"] > 1, TIE).otherwise(x["_c"]))
    out = out.withColumns({"minimo": F.col("_lo._p"), "maximo": F.col("_hi._p"), "mas_barato": name(F.col("_lo")), "mas_caro": name(F.col("_hi"))})
    return out.withColumns(gap_columns(F.col("minimo"), F.col("maximo"), F.col("n"))).drop("_lo", "_hi")


def wide(prices: DataFrame, keys: list[str], chains: list[str], stamp: str | None = None) -> DataFrame:
    """One row a product, three columns a chain: _precio, _regular, _promo (the chain list is given, so no extra job looks for it), and the greatest of a stamp column if one is named."""
    cell = lambda chain, c: F.first(F.when(F.col("cadena") == chain, F.col(c)), ignorenulls=True)
    cells = [cell(chain, c).alias(f"{chain}_{name}") for chain in chains for c, name in (("precio", "precio"), ("precio_regular", "regular"), ("en_promocion", "promo"))]
    last = [F.max(stamp).alias(stamp)] if stamp else []
    return prices.groupBy(*keys).agg(*cells, *last)


def nested(prices: DataFrame, keys: list[str]) -> DataFrame:
    """Maps by chain: precios, promos, regulares; chains without a price are absent."""
    some = F.when(F.col("precio").isNotNull(), F.struct("cadena", "precio"))
    promo = F.when(F.col("en_promocion").isNotNull(), F.struct("cadena", "en_promocion"))
    return prices.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(some))).alias("precios"), F.map_from_entries(F.array_sort(F.collect_list(promo))).alias("promos"))


def unit_price(price: Column, quantity: Column) -> Column:
    """Rounded to 4 places; null where either is null or the quantity is 0."""
    return F.round(F.try_divide(price, F.nullif(quantity, F.lit(0))), 4)


def without_twins(products: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row (by order) of rows equal in columns (null-safe; maps compared as sorted entries)."""
    kinds = dict(products.dtypes)
    parts = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map") else F.col(c) for c in columns]
    keyed = products.withColumn("_sig", F.struct(*parts)).withColumn("_h", F.xxhash64(F.to_json("_sig")))
    first = W.partitionBy("_h", "_sig").orderBy(order)
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_sig", "_h", "_n")


def kpis(compared: DataFrame) -> DataFrame:
    """comparables, empates, brecha_media (zero gaps left out, 1 place, 0.0 if none), brecha_max over cheapest() rows."""
    gap = F.when(F.col("brecha_pct") != 0, F.col("brecha_pct"))
    return compared.where("n >= 2").agg(
        F.count("*").alias("comparables"),
        F.count_if(F.col("mas_barato") == TIE).alias("empates"),
        F.coalesce(F.round(F.avg(gap), 1).cast("double"), F.lit(0.0)).alias("brecha_media"),
        F.coalesce(F.max(gap).cast("double"), F.lit(0.0)).alias("brecha_max"),
    )


def win_share(compared: DataFrame) -> DataFrame:
    """Per chain: ganados, and its share of comparable products, rounded and floored."""
    totals = compared.where("n >= 2").agg(F.greatest(F.count("*"), F.lit(1)).alias("_t"))
    wins = compared.where(F.col("mas_barato") != TIE).groupBy(F.col("mas_barato").alias("cadena")).agg(F.count("*").alias("ganados"))
    share = 100 * F.col("ganados") / F.col("_t")
    return wins.crossJoin(F.broadcast(totals)).select("cadena", "ganados", F.round(share).cast("long").alias("pct"), F.floor(share).alias("pct_piso"))


def gap_alerts(compared: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The top products by gap (none of zero), ties by key: a report of fixed length."""
    return compared.where("brecha_pct > 0").orderBy(F.col("brecha_pct").desc(), *keys).limit(top)


def coverage(prices: DataFrame, key: str = "id") -> DataFrame:
    """Per chain: products with a price, and the floor of its percentage of all products."""
    total = prices.agg(F.count_distinct(key).alias("_t"))
    have = prices.where("precio is not null").groupBy("cadena").agg(F.count_distinct(key).alias("con"))
    return have.crossJoin(F.broadcast(total)).select("cadena", "con", F.floor(100 * F.col("con") / F.col("_t")).alias("pct"))


def search_terms(catalogue: DataFrame, terms: DataFrame, per_term: int | None = None) -> DataFrame:
    """Hits of each term with puesto, its place in the term's list (by name length, then sku), at most per_term.

    catalogue: sku, nombre_norm (normal text), precio; terms: orden, termino (one word or
    several, all must be in the name). Names without a price are skipped. Terms meet names by an
    equi-join on the term's first word; a term that all names hold is ranked over range partitions. Both
    sides are shuffled: a catalogue's file says nothing of its size as words, which a broadcast would hold in the driver.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    t = terms.withColumn("_words", words(F.col("termino"))).where(F.size("_words") > 0).withColumn("_w", F.get("_words", F.lit(0)))
    c = catalogue.where("precio is not null").withColumn("_have", words(F.col("nombre_norm"))).withColumn("_w", F.explode("_have"))
    hits = c.join(t.hint("merge"), "_w").where(F.size(F.array_except("_words", "_have")) == 0)
    hits, order = hits.drop("_w", "_have", "_words"), [F.length("nombre_norm"), F.col("sku")]
    hits = with_place(hits, order, within=["orden"]) if per_term is None else first_rows(hits, ["orden"], order, per_term, "sku")
    return hits.withColumn("puesto", F.col("puesto").cast("int"))


def select_base(catalogue: DataFrame, terms: DataFrame, per_term: int = 3, most: int | None = None) -> DataFrame:
    """Ordered terms x their best hits (search_terms); each sku counts for the first term that finds it.

    A term is still taken while fewer than most skus were found before it.
    """
    hits = search_terms(catalogue, terms, per_term)
    first = hits.withColumn("_s", F.row_number().over(W.partitionBy("sku").orderBy("orden", "puesto"))).where("_s = 1").drop("_s")
    if most is not None:  # rows here are at most terms x per_term
        news = first.groupBy("orden").agg(F.count("*").alias("_new"))
        before = news.withColumn("_before", F.coalesce(F.sum("_new").over(W.orderBy("orden").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        first = first.join(before.where(F.col("_before") < most).select("orden"), "orden", "left_semi")
    return first


def with_seeds(base: DataFrame, catalogue: DataFrame, seeds: DataFrame) -> DataFrame:
    """base (sku, orden, termino, nombre_norm) with categoria null, and on top of it, whatever its cap, the products of whole subcategories.

    catalogue: sku, subcategoria, nombre_norm, precio; seeds: orden, subcategoria, categoria. A product without a
    price is left out, one that base has stays base's, and of several seeds the first counts.
    """
    rows = catalogue.where("precio is not null").join(seeds, "subcategoria").join(base.select("sku"), "sku", "left_anti")
    first = rows.groupBy("sku").agg(F.min(F.struct("orden", "categoria", "nombre_norm")).alias("s"))
    named = first.select("sku", "s.orden", F.lit(None).cast("string").alias("termino"), "s.nombre_norm", "s.categoria")
    return base.select("sku", "orden", "termino", "nombre_norm", F.lit(None).cast("string").alias("categoria")).unionByName(named)


def by_name(products: DataFrame, name: str = "nombre", tie: str = "id") -> DataFrame:
    """products with puesto, the place by name as a reader expects it: letters before case and accents, null names last, then by tie."""
    text = F.collate(F.lower(name), "UNICODE")
    return with_place(products, [F.col(name).isNull(), text, F.col(tie)])


def basket_offers(basket: DataFrame, offers: DataFrame) -> DataFrame:
    """Each (match_id, cadena, sku) of the basket with its offer; none: nulls."""
    return basket.join(offers, ["cadena", "sku"], "left")


@dataclass
class Filter:
    """What a user picks: text, categoria, active chains, least gap, and a chain that must be 'barato' or 'caro'."""

    text: str = ""
    categoria: str | None = None
    chains: list[str] = field(default_factory=list)
    least_gap: float | None = None
    target: str | None = None
    position: str | None = None


def filtered(compared: DataFrame, f: Filter) -> DataFrame:
    """Rows of products (nombre, marca, categoria, precios map, mas_barato, mas_caro, brecha_pct) that pass. A null gap fails a least gap; a target chain that isn't active is ignored; ties don't qualify."""
    out = compared
    if f.text.strip():
        hay = F.lower(F.concat_ws(" ", F.coalesce("nombre", F.lit("")), F.coalesce("marca", F.lit("")), F.coalesce("categoria", F.lit(""))))
        out = out.where(F.contains(hay, F.lit(f.text.strip().lower())))
    if f.categoria is not None:
        out = out.where(F.col("categoria") == f.categoria)
    for chain in f.chains:
        out = out.where(F.col("precios")[chain].isNotNull())
    if f.least_gap is not None:
        out = out.where(F.col("brecha_pct") >= f.least_gap)
    if f.target in f.chains and f.position in ("barato", "caro"):
        out = out.where(F.col(f"mas_{f.position}") == f.target)
    return out


def ordered(products: DataFrame, key: Column, descending: bool = False, tie: str = "id") -> DataFrame:
    """By key, nulls last in both directions, then by tie."""
    return products.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def with_group(prices: DataFrame, groups: DataFrame) -> DataFrame:
    """prices with grupo of its chain (dimension cadena, grupo: one row a chain); a chain without one is its own group."""
    return prices.join(F.broadcast(groups), "cadena", "left").withColumn("grupo", F.coalesce("grupo", "cadena"))


def cheapest_group(prices: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """cheapest() with each group as one competitor at its least price."""
    least = with_group(prices, groups).groupBy(*keys, "grupo").agg(F.min("precio").alias("precio"))
    return cheapest(least.withColumnRenamed("grupo", "cadena"), keys)


def positioning(prices: DataFrame, client: str, keys: list[str]) -> DataFrame:
    """For one chain, over products it shares with others: comparables, share cheapest and dearest, mean gap to the cheapest (%), mean rank."""
    w = W.partitionBy(*keys)
    rows = prices.where("precio is not null").withColumns(
        {"_n": F.count("*").over(w), "_lo": F.min("precio").over(w), "_hi": F.max("precio").over(w), "_r": F.rank().over(w.orderBy("precio"))}
    )
    mine = rows.where((F.col("cadena") == client) & (F.col("_n") >= 2))
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 1)
    gap = F.try_divide(100 * (F.col("precio") - F.col("_lo")), F.col("_lo")).cast("double")
    return mine.agg(
        F.count("*").alias("comparables"),
        share(F.col("precio") == F.col("_lo")).alias("pct_barato"),
        share(F.col("precio") == F.col("_hi")).alias("pct_caro"),
        F.round(F.avg(gap), 1).alias("brecha_media"),
        F.round(F.avg("_r"), 2).alias("puesto_medio"),
    )


def above_market(prices: DataFrame, client: str, keys: list[str], percent: float) -> DataFrame:
    """The client's products over percent above the least price of the others: precio, mercado, exceso_pct."""
    known = prices.where("precio is not null")
    market = known.where(F.col("cadena") != client).groupBy(*keys).agg(F.min("precio").alias("mercado"))
    mine = known.where(F.col("cadena") == client).select(*keys, "precio")
    excess = F.try_divide(100 * (F.col("precio") - F.col("mercado")), F.col("mercado"))
    return mine.join(market, keys).withColumn("exceso_pct", F.round(excess, 1).cast("double")).where(excess > percent)


def promotions(prices: DataFrame) -> DataFrame:
    """Per chain: offers, active promotions and their share (1 place)."""
    return prices.groupBy("cadena").agg(
        F.count("*").alias("ofertas"), F.count_if("en_promocion").alias("promos"), F.round(100 * F.count_if("en_promocion") / F.count("*"), 1).alias("pct")
    )


def competitiveness(prices: DataFrame, key: list[str]) -> DataFrame:
    """Per (categoria, cadena) with subtotals (null: all): products at the least price out of those compared, in percent."""
    w = W.partitionBy(*key)
    rows = prices.where("precio is not null").withColumns({"_n": F.count("*").over(w), "_lo": F.min("precio").over(w)}).where("_n >= 2")
    return rows.cube("categoria", "cadena").agg(F.count("*").alias("comparables"), F.round(100 * F.avg((F.col("precio") == F.col("_lo")).cast("int")), 1).alias("indice"))


def real_discount(regular: Column, price: Column) -> Column:
    """(regular - price) / regular in percent (1 place); null without a regular price."""
    return F.round(F.try_divide(100 * (regular - price), regular), 1).cast("double")
