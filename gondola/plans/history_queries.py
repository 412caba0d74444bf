"""Change detection over runs (G) and the streaming feed (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.operators import history
from gondola.plans.offerview import BEFORE, LAST, OFFERS, offers
from gondola.sources.folders import new_folder
from gondola.sources.offers import EVENT_COLUMNS, append_snapshot, read_history, write_csv
from gondola.streaming.feed import SNAPSHOT, change_feed, use_rocksdb

TREND = f"""{OFFERS}, runs AS (SELECT run, row_number() OVER (ORDER BY run) AS seq FROM (SELECT DISTINCT run FROM offers)), seqd AS (SELECT offers.*, seq FROM offers JOIN runs USING (run)),
trend AS (
  SELECT c.*, p.precio AS p_precio, p.en_promocion AS p_promo, p.stock AS p_stock, k.id IS NULL AS es_nuevo,
    CASE WHEN p.precio IS NULL THEN 'nuevo' WHEN c.precio < p.precio THEN 'baja' WHEN c.precio > p.precio THEN 'sube' ELSE 'igual' END AS dir,
    CASE WHEN p.precio <> 0 THEN round((100 * (c.precio - p.precio))::DOUBLE / p.precio::DOUBLE, 1) + 0.0 END AS delta_pct,
    CASE WHEN c.en_promocion AND NOT p.en_promocion THEN 'inicia' WHEN NOT c.en_promocion AND p.en_promocion THEN 'termina' END AS promo_cambio
  FROM seqd c LEFT JOIN seqd p ON p.seq = c.seq - 1 AND p.id = c.id AND p.cadena = c.cadena LEFT JOIN (SELECT DISTINCT seq, id FROM seqd) k ON k.seq = c.seq - 1 AND k.id = c.id
  WHERE c.seq > 1
), events AS (
  SELECT DISTINCT run, id, 'nuevo' AS tipo_evento, '' AS cadena, NULL AS valor_anterior, NULL AS valor_nuevo, NULL::DOUBLE AS delta_pct FROM trend WHERE es_nuevo
  UNION ALL SELECT run, id, CASE dir WHEN 'baja' THEN 'baja_precio' ELSE 'sube_precio' END, cadena, p_precio::VARCHAR, precio::VARCHAR, delta_pct FROM trend WHERE dir IN ('baja', 'sube') AND NOT es_nuevo
  UNION ALL SELECT run, id, CASE promo_cambio WHEN 'inicia' THEN 'inicia_promo' ELSE 'fin_promo' END, cadena, CASE promo_cambio WHEN 'inicia' THEN 'no' ELSE 'sí' END,
    CASE promo_cambio WHEN 'inicia' THEN 'sí' ELSE 'no' END, NULL FROM trend WHERE promo_cambio IS NOT NULL
)"""


def _last(spark, d):
    rows = offers(spark, d)
    return history.with_trend(history.with_previous(rows.where(F.col("run") == LAST), history.latest_before(rows, LAST)))


def g01_diff_events(spark, d):
    return history.events(_last(spark, d))


def g02_new_products(spark, d):
    return _last(spark, d).where("es_nuevo").select("id").distinct()


def g03_trends(spark, d):
    return _last(spark, d).select("id", "cadena", "dir", "delta_pct", "promo_cambio", "es_nuevo")


def g06_event_counts(spark, d):
    return history.event_counts(history.events(_last(spark, d)))


def g07_history_events(spark, d):
    return history.events(history.history_trends(offers(spark, d)), ["run"])


def g08_stock_events(spark, d):
    return history.stock_events(history.history_trends(offers(spark, d)))


def g09_campaigns(spark, d):
    return history.campaigns(history.history_trends(offers(spark, d)), 3)


def g10_price_series(spark, d):
    return history.price_series(offers(spark, d)).select("run", "id", "cadena", "precio", "anterior", "cambio", "desde_inicio", "minimo", "maximo")


def g11_first_seen(spark, d):
    return history.first_seen(offers(spark, d))


def a04_latest_previous(spark, d):
    return history.latest_before(offers(spark, d), LAST).select("run", "id", "cadena", "precio")


def h01_change_feed(spark, d):
    """Runs arrive in two halves, one after the other; the feed's events over all of them. Files lie in the shared folder."""
    base = new_folder(spark, "feed")
    rows = offers(spark, d).select("run", "id", "cadena", "precio", "en_promocion", F.to_timestamp(F.concat("run", F.lit("-01-01"))).alias("ts")).persist()
    runs = sorted(x["run"] for x in rows.select("run").distinct().collect())  # a row a run
    use_rocksdb(spark)
    for some in (runs[: len(runs) // 2], runs[len(runs) // 2 :]):
        rows.where(F.col("run").isin(some)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SNAPSHOT).parquet(f"{base}/in")
        change_feed(stream, f"{base}/runs", f"{base}/events", f"{base}/check", 3650).awaitTermination()
    rows.unpersist()
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/events")
    return found.select("run", "id", "tipo_evento", "cadena", "valor_anterior", "valor_nuevo", "delta_pct")


def a03_append_history(spark, d):
    """Two runs appended one after the other, and read back."""
    rows, path = offers(spark, d).select("run", "id", "cadena", "precio"), new_folder(spark, "history")
    for run in (BEFORE, LAST):
        append_snapshot(rows.where(F.col("run") == run), path)
    return read_history(spark, path).select("run", "id", "cadena", "precio")


def a07_events_csv(spark, d):
    """The last run's events as CSV in folders by date, read back."""
    path = new_folder(spark, "events")
    found = history.events(_last(spark, d)).select(F.lit(LAST).alias("fecha"), "tipo_evento", "cadena", F.col("id").alias("producto"), "valor_anterior", "valor_nuevo", "delta_pct")
    write_csv(found, path, ["fecha"])
    back = spark.read.option("header", "true").schema(found.schema).csv(path)
    return back.select(*EVENT_COLUMNS[1:]).withColumn("cadena", F.coalesce("cadena", F.lit("")))


SERIES = f"""WITH {OFFERS} SELECT run, id, cadena, precio, lag(precio) OVER w AS anterior, precio - lag(precio) OVER w AS cambio, precio - first(precio) OVER w AS desde_inicio,
  min(precio) OVER w AS minimo, max(precio) OVER w AS maximo FROM offers WINDOW w AS (PARTITION BY id, cadena ORDER BY run)"""

ALL = {
    "a03_append_history": (a03_append_history, f"WITH {OFFERS} SELECT run, id, cadena, precio FROM offers WHERE run IN ('{BEFORE}', '{LAST}')"),
    "a07_events_csv": (a07_events_csv, f"WITH {TREND} SELECT tipo_evento, cadena, id AS producto, valor_anterior, valor_nuevo, delta_pct FROM events WHERE run = '{LAST}'"),
    "a04_latest_previous": (a04_latest_previous, f"WITH {OFFERS} SELECT run, id, cadena, precio FROM offers WHERE run = '{BEFORE}'"),
    "g01_diff_events": (g01_diff_events, f"WITH {TREND} SELECT id, tipo_evento, cadena, valor_anterior, valor_nuevo, delta_pct FROM events WHERE run = '{LAST}'"),
    "g02_new_products": (g02_new_products, f"WITH {TREND} SELECT DISTINCT id FROM trend WHERE run = '{LAST}' AND es_nuevo"),
    "g03_trends": (g03_trends, f"WITH {TREND} SELECT id, cadena, dir, delta_pct, promo_cambio, es_nuevo FROM trend WHERE run = '{LAST}'"),
    "g06_event_counts": (g06_event_counts, f"WITH {TREND} SELECT tipo_evento, count(*) AS n FROM events WHERE run = '{LAST}' GROUP BY tipo_evento"),
    "g07_history_events": (g07_history_events, f"WITH {TREND} SELECT run, id, tipo_evento, cadena, valor_anterior, valor_nuevo, delta_pct FROM events"),
    "g08_stock_events": (g08_stock_events, f"WITH {TREND} SELECT run, id, cadena, CASE WHEN p_stock THEN 'quiebre_stock' ELSE 'vuelve_stock' END AS tipo_evento FROM trend WHERE p_stock <> stock"),
    "g09_campaigns": (g09_campaigns, f"WITH {TREND} SELECT run, cadena, categoria, count(DISTINCT id) AS bajas, round(avg(delta_pct), 1) AS delta_medio FROM trend WHERE dir = 'baja' AND NOT es_nuevo GROUP BY ALL HAVING count(DISTINCT id) >= 3"),
    "g10_price_series": (g10_price_series, SERIES),
    "g11_first_seen": (g11_first_seen, f"WITH {OFFERS} SELECT min(run) AS run, id FROM offers GROUP BY id HAVING min(run) > (SELECT min(run) FROM offers)"),
    "h01_change_feed": (h01_change_feed, f"WITH {TREND} SELECT run, id, tipo_evento, cadena, valor_anterior, valor_nuevo, delta_pct FROM events"),
}
