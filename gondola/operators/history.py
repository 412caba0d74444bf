"""Snapshots over time: what changed between runs. Facts are long rows (run, id, cadena, precio, en_promocion, stock)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEW, DOWN, UP, PROMO_ON, PROMO_OFF = "nuevo", "baja_precio", "sube_precio", "inicia_promo", "fin_promo"
OUT, BACK = "quiebre_stock", "vuelve_stock"


def delta(now: Column, before: Column) -> Column:
    """Change in percent (1 place); null if there was no price or it was 0."""
    return F.round(F.try_divide(100 * (now - before), before), 1).cast("double")


def with_previous(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with p_precio, p_promo, p_stock of the same (id, cadena), and es_nuevo: the id wasn't there at all.

    Without previous rows nothing is new: there is nothing to compare with.
    """
    stock = [F.col("stock").alias("p_stock")] if "stock" in previous.columns else []
    p = previous.select("id", "cadena", F.col("precio").alias("p_precio"), F.col("en_promocion").alias("p_promo"), *stock)
    ids = previous.select("id").distinct().withColumn("_known", F.lit(True))
    any_before = F.broadcast(previous.limit(1).agg(F.count("*").alias("_any")))
    out = current.join(p, ["id", "cadena"], "left").join(ids, "id", "left").crossJoin(any_before)
    return out.withColumn("es_nuevo", F.col("_known").isNull() & (F.col("_any") > 0)).withColumn("hay_previo", F.col("_any") > 0).drop("_known", "_any")


def with_trend(joined: DataFrame) -> DataFrame:
    """dir ('nuevo' without a former price, baja, sube, igual), delta_pct and promo_cambio ('inicia', 'termina') of with_previous() rows."""
    now, before = F.col("precio"), F.col("p_precio")
    way = F.when(now.isNull(), None).when(before.isNull(), "nuevo").when(now < before, "baja").when(now > before, "sube").otherwise("igual")
    promo = F.when(F.col("en_promocion") & ~F.col("p_promo"), "inicia").when(~F.col("en_promocion") & F.col("p_promo"), "termina")
    return joined.withColumns({"dir": F.when(F.col("hay_previo"), way), "delta_pct": F.when(now.isNotNull(), delta(now, before)), "promo_cambio": promo})


def events(trended: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Rows tipo_evento, id, cadena, valor_anterior, valor_nuevo, delta_pct: one 'nuevo' a new product (cadena ''), price moves, promotions that start or end.

    Products and chains that are gone give no event.
    """
    keep = [F.col(c) for c in extra]
    event = lambda kind, chain, old, new, d: F.struct(F.lit(kind).alias("tipo_evento"), chain.alias("cadena"), old.cast("string").alias("valor_anterior"), new.cast("string").alias("valor_nuevo"), d.cast("double").alias("delta_pct"))
    none, chain = F.lit(None), F.col("cadena")
    moves = F.array(
        F.when(~F.col("es_nuevo") & (F.col("dir") == "baja"), event(DOWN, chain, F.col("p_precio"), F.col("precio"), F.col("delta_pct"))),
        F.when(~F.col("es_nuevo") & (F.col("dir") == "sube"), event(UP, chain, F.col("p_precio"), F.col("precio"), F.col("delta_pct"))),
        F.when(F.col("promo_cambio") == "inicia", event(PROMO_ON, chain, F.lit("no"), F.lit("sí"), none)),
        F.when(F.col("promo_cambio") == "termina", event(PROMO_OFF, chain, F.lit("sí"), F.lit("no"), none)),
    )
    cells = trended.select(*keep, "id", F.explode(F.filter(moves, lambda e: e.isNotNull())).alias("e")).select(*keep, "id", "e.*")
    new = trended.where("es_nuevo").select(*keep, "id").distinct().select(*keep, "id", F.explode(F.array(event(NEW, F.lit(""), none, none, none))).alias("e")).select(*keep, "id", "e.*")
    return new.unionByName(cells)


def event_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tipo_evento").agg(F.count("*").alias("n"))


def latest_before(history: DataFrame, run) -> DataFrame:
    """Rows of the last run before the given one (partition-pruned); none: no rows."""
    last = history.where(F.col("run") < F.lit(run)).agg(F.max("run").alias("m")).first()["m"]
    return history.where(F.col("run") == F.lit(last)) if last is not None else history.limit(0)


def run_numbers(history: DataFrame) -> DataFrame:
    """run, seq: runs numbered in order (one row a run)."""
    return history.select("run").distinct().withColumn("seq", F.row_number().over(W.orderBy("run")))


def history_trends(history: DataFrame) -> DataFrame:
    """with_trend() for every run after the first against the run before it (not the last sighting: a cell that missed a run is new again)."""
    rows = history.join(F.broadcast(run_numbers(history)), "run")  # a row a run
    # both windows share the partitioning by id
    known = F.count("*").over(W.partitionBy("id").orderBy("seq").rangeBetween(-1, -1)) > 0
    cell = W.partitionBy("id", "cadena").orderBy("seq")
    before = lambda c: F.when(F.lag("seq").over(cell) == F.col("seq") - 1, F.lag(c).over(cell))
    columns = {"precio": "p_precio", "en_promocion": "p_promo", **({"stock": "p_stock"} if "stock" in history.columns else {})}
    out = rows.withColumn("es_nuevo", ~known).withColumns({p: before(c) for c, p in columns.items()}).where("seq > 1")
    return with_trend(out.withColumn("hay_previo", F.lit(True)))


def stock_events(trended: DataFrame) -> DataFrame:
    """run, id, cadena, tipo_evento where stock turned false (break) or true (return); unknown states give none."""
    kind = F.when(F.col("p_stock") & ~F.col("stock"), OUT).when(~F.col("p_stock") & F.col("stock"), BACK)
    return trended.select("run", "id", "cadena", kind.alias("tipo_evento")).where("tipo_evento is not null")


def campaigns(trended: DataFrame, least: int) -> DataFrame:
    """(run, cadena, categoria) in which at least so many products fell in price: bajas, delta_medio (1 place)."""
    falls = trended.where((F.col("dir") == "baja") & ~F.col("es_nuevo"))
    return falls.groupBy("run", "cadena", "categoria").agg(F.count_distinct("id").alias("bajas"), F.round(F.avg(F.col("delta_pct").cast("double")), 1).alias("delta_medio")).where(F.col("bajas") >= least)


def price_series(history: DataFrame) -> DataFrame:
    """Each (id, cadena) over runs: anterior, cambio, desde_inicio, minimo, maximo to date."""
    w = W.partitionBy("id", "cadena").orderBy("run")
    to_date = w.rowsBetween(W.unboundedPreceding, 0)
    out = history.withColumns({"anterior": F.lag("precio").over(w), "_first": F.first("precio").over(to_date), "minimo": F.min("precio").over(to_date), "maximo": F.max("precio").over(to_date)})
    return out.withColumns({"cambio": F.col("precio") - F.col("anterior"), "desde_inicio": F.col("precio") - F.col("_first")}).drop("_first")


def first_seen(history: DataFrame) -> DataFrame:
    """run, id of products never seen in any run before, from the second run on."""
    first = history.groupBy("id").agg(F.min("run").alias("run"))
    start = F.broadcast(history.agg(F.min("run").alias("_start")))
    return first.crossJoin(start).where("run > _start").select("run", "id")
