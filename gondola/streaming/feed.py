"""An incremental feed of changes: each product's last prices are a table that every batch replaces, so no history is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gondola.operators.history import events, with_trend
from gondola.sources.folders import exists

SNAPSHOT = "run string, id string, cadena string, precio decimal(12,2), en_promocion boolean, ts timestamp"
RUNS = "run string"
#: A row a cell (id, cadena) and run; ts: when the product was last seen.
STATE = "id string, cadena string, run string, precio decimal(12,2), en_promocion boolean, ts timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Runs of a cell that the state keeps, and with them so many of a product.
KEPT = 2


def with_states(batch: DataFrame, state: DataFrame, delay_days: int) -> DataFrame:
    """The cells of the state and the batch's new ones (_new) with what was known of them: p_run, p_precio, p_promo, the chain's last run
    before and its price and flag, id_run, the product's last run before, and primera, whether it is the product's first cell of the run.

    A cell that was there already is a replay and left out, and so are rows that come more than the delay after the last
    time seen. Everything of a product is in one partition, and each of its rows is sorted there.
    """
    late = F.broadcast(state.agg((F.max("ts") - F.make_dt_interval(F.lit(delay_days))).alias("_mark")))  # one row
    rows = batch.crossJoin(late).where(F.col("_mark").isNull() | (F.col("ts") >= F.col("_mark")))
    cell = F.struct(F.col("precio").isNull(), "precio", F.col("en_promocion").isNull(), F.col("en_promocion"))
    new = rows.groupBy("id", "cadena", "run").agg(F.min(cell).alias("c"), F.max("ts").alias("ts")).select("id", "cadena", "run", "c.precio", "c.en_promocion", "ts", F.lit(True).alias("_new"))
    both = state.withColumn("_new", F.lit(False)).unionByName(new).repartition("id")
    both = both.withColumn("_again", F.lag("run").over(W.partitionBy("id", "cadena").orderBy("run", "_new")).eqNullSafe(F.col("run"))).where("not _again").drop("_again")
    order = W.partitionBy("id", "cadena").orderBy("run")
    both = both.withColumns({p: F.lag(c).over(order) for p, c in (("p_run", "run"), ("p_precio", "precio"), ("p_promo", "en_promocion"))})
    product, run = W.partitionBy("id"), W.partitionBy("id", "run")
    both = both.withColumns({"_runs": F.collect_set("run").over(product), "_seen": F.max(F.when(F.col("_new"), F.col("ts"))).over(product)})
    both = both.withColumns({"_old": F.max(~F.col("_new")).over(run), "_first": F.min("cadena").over(run)})
    before = F.array_max(F.filter("_runs", lambda r: r < F.col("run")))
    out = both.withColumns({"id_run": before, "primera": F.col("_new") & ~F.col("_old") & F.col("cadena").eqNullSafe(F.col("_first")), "ts": F.coalesce("_seen", "ts")})
    return out.drop("_runs", "_seen", "_old", "_first")


def next_state(seen: DataFrame, delay_days: int) -> DataFrame:
    """The last runs of each cell of with_states rows, without products that weren't seen for twice the delay (the watermark's and their own)."""
    last = F.row_number().over(W.partitionBy("id", "cadena").orderBy(F.col("run").desc()))
    mark = F.broadcast(seen.agg((F.max("ts") - F.make_dt_interval(F.lit(2 * delay_days))).alias("_mark")))  # one row
    kept = seen.withColumn("_n", last).where(F.col("_n") <= KEPT).crossJoin(mark).where("ts > _mark")
    return kept.select("id", "cadena", "run", "precio", "en_promocion", "ts")


def state_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The state that the last batch before this one left; none: no rows. Older states are deleted, that one stays if this batch is repeated."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATE)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((int(f.getPath().getName().rsplit("=", 1)[1]), f.getPath()) for f in files.listStatus(folder) if "=" in f.getPath().getName())
    done = [(n, at) for n, at in found if n < number and files.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))]
    for _, at in done[:-1]:
        files.delete(at, True)
    return spark.read.schema(STATE).parquet(done[-1][1].toString()) if done else spark.createDataFrame([], STATE)


def changed(seen: DataFrame, runs: DataFrame) -> DataFrame:
    """run and events() of the new rows of with_states; runs: all runs so far (a row each), of which the last one before counts as a run's previous.

    A cell that missed the previous run has no former price, and a product that missed it is new. The first run has no events.
    """
    pairs = runs.select("run").distinct().alias("x").join(runs.select(F.col("run").alias("r")).distinct(), F.col("r") < F.col("run"), "left").groupBy("run").agg(F.max("r").alias("anterior"))
    rows = seen.join(F.broadcast(pairs), "run")  # a row a run
    there = F.coalesce(F.col("p_run") == F.col("anterior"), F.lit(False))
    new = F.col("anterior").isNotNull() & ~F.coalesce(F.col("id_run") == F.col("anterior"), F.lit(False))
    rows = rows.withColumns({"p_precio": F.when(there, F.col("p_precio")), "p_promo": F.when(there, F.col("p_promo")), "hay_previo": F.col("anterior").isNotNull()})
    trended = with_trend(rows.withColumn("_nuevo", new).withColumn("es_nuevo", new))
    # of a product's cells of one run only the first one to arrive says that it is new
    moves = events(trended, ["run"]).where("tipo_evento <> 'nuevo'")
    once = events(trended.where("primera"), ["run"]).where("tipo_evento = 'nuevo'")
    return once.unionByName(moves)


def known_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs that the feed has met (a row a batch and run)."""
    return spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(path)


def change_feed(stream: DataFrame, runs_path: str, events_path: str, checkpoint: str, delay_days: int = 7) -> StreamingQuery:
    """Start the feed. stream: rows of SNAPSHOT, read with readStream.

    Events of a batch go to a folder of its number, overwritten if the batch is repeated, and so do the
    runs that it met: a list of a row a run. The last prices, a table beside the checkpoint, are
    joined with the batch by product and written anew, all by Spark's own functions. Replayed cells give nothing, and a run may
    arrive in parts. The delay has to be longer than the time between two runs.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, states = batch.sparkSession, f"{checkpoint.rstrip('/')}-state"
        batch.select("run").distinct().coalesce(1).write.mode("overwrite").parquet(f"{runs_path}/batch={number}")  # few runs a batch
        seen = with_states(batch, state_before(spark, states, number), delay_days).persist()
        changed(seen.where("_new"), known_runs(spark, runs_path)).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        next_state(seen, delay_days).write.mode("overwrite").parquet(f"{states}/batch={number}")
        seen.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def use_rocksdb(spark: SparkSession) -> None:
    """The store for queries with keyed state that start after it; the feed itself keeps none in it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
