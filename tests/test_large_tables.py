"""What made queries over large tables fail: broadcasts of words, tables of pairs, Python calls a product."""

from decimal import Decimal

from pyspark.sql import functions as F

from gondola.operators import compare, kinds, matching
from gondola.plans import match_queries
from gondola.streaming import feed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_catalogue_of_words_is_not_broadcast(spark, tmp_path):
    """A small file may hold many rows; its words never go to the driver."""
    spark.range(3000).select(F.col("id").cast("string").alias("sku"), F.concat(F.lit("red widget "), F.col("id") % 7).alias("nombre_norm"), F.lit(1.0).alias("precio")).coalesce(1).write.parquet(f"{tmp_path}/c")
    terms = spark.createDataFrame([(1, "red widget"), (2, "widget 3")], "orden int, termino string")
    found = compare.select_base(spark.read.parquet(f"{tmp_path}/c"), terms, per_term=2)
    joins = [line for line in plan(found).splitlines() if "Join" in line and "_w#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), plan(found)
    threes = sorted(str(i) for i in range(3, 3000, 7))
    assert sorted((r["orden"], r["sku"]) for r in found.collect()) == [(1, "0"), (1, "1"), *((2, x) for x in threes[:2])]


def same_names(spark, path, rows, copies):
    """part of sf0.001's first rows, each name as often as copies says: names depend on keys modulo 30030."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where(F.col("p_partkey") < rows)
    part.crossJoin(spark.range(copies)).withColumn("p_partkey", F.col("p_partkey") + 30030 * F.col("id")).drop("id").write.parquet(f"{path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_rules_are_counted_over_names(spark, tmp_path):
    """Billions of pairs of repeating names (before, each was made), and the counts of a few rows made one by one."""
    few, many = same_names(spark, tmp_path / "few", 60, 1), same_names(spark, tmp_path / "many", 60, 2000)
    counts = lambda df: {r["motivo"]: r["n"] for r in df.collect()}
    a, b = (df.withColumn("_w", F.get(F.split("nombre_origen", " "), F.lit(0))) for df in match_queries._sides(spark, few))
    pairs = a.select(F.col("id").alias("l_id"), "_w").join(b.select(F.col("id").alias("r_id"), "_w"), "_w").drop("_w")
    want = counts(matching.with_rules(pairs, a, b).groupBy("motivo").agg(F.count("*").alias("n")))
    assert counts(match_queries.d07_rules(spark, few)) == want and len(want) > 3
    assert counts(match_queries.d07_rules(spark, many)) == {k: n * 2000**2 for k, n in want.items()}


def one_name(spark, path, copies):
    """part with one name in all rows; each row has an identifier match, of its own number."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey = 1")
    part.crossJoin(spark.range(copies)).withColumn("p_partkey", F.col("p_partkey") + 30030 * F.col("id")).drop("id").write.parquet(f"{path}/part.parquet")
    return str(path)


def pair_by_pair(spark, d):
    return matching.match_offers(*match_queries._sides(spark, d), shared_namespace=True, with_quantity=True)


def test_scores_are_counted_over_names(spark, tmp_path):
    """Four hundred million pairs of one name (before, each was written), and a few names as pair by pair."""
    few, many = same_names(spark, tmp_path / "few", 60, 3), one_name(spark, tmp_path / "many", 20000)
    band = F.when(F.col("metodo") == "regla_dura", "regla").when(F.col("es_match"), "match").when(F.col("revisar"), "revisar").otherwise("no")
    want = {r["banda"]: (r["n"], r["media"]) for r in pair_by_pair(spark, few).groupBy(band.alias("banda")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("media")).collect()}
    assert {r["banda"]: (r["n"], r["media"]) for r in match_queries.d08_scores(spark, few).collect()} == want and len(want) > 1
    assert [(r["banda"], r["n"]) for r in match_queries.d08_scores(spark, many).collect()] == [("match", 20000**2)]


def assert_pairs_come_last(df):
    lines = plan(df).splitlines()
    made = next((i for i, line in enumerate(lines) if "Generate explode(_rrows" in line), None)
    assert made is not None and not any("Exchange" in line for line in lines[:made]), plan(df)


def test_pairs_of_repeating_names_are_made_last(spark, tmp_path, monkeypatch):
    """All matches as pair by pair, with packs of two rows; nothing is shuffled or stored once pairs are made."""
    monkeypatch.setattr(kinds, "PACK", 2)
    few = same_names(spark, tmp_path, 60, 5)
    found, want = match_queries.d18_match_offers(spark, few), pair_by_pair(spark, few)
    assert_pairs_come_last(found.where("metodo <> 'id'"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))


def test_methods_are_counted_over_names(spark, tmp_path):
    """Four hundred million matches of one name (before, each was written)."""
    few, many = same_names(spark, tmp_path / "few", 60, 3), one_name(spark, tmp_path / "many", 20000)
    counts = lambda df: {r["metodo"]: r["n"] for r in df.collect()}
    assert counts(match_queries.d16_methods(spark, few)) == counts(pair_by_pair(spark, few).where("es_match").groupBy("metodo").agg(F.count("*").alias("n")))
    assert counts(match_queries.d16_methods(spark, many)) == {"id": 20000, "fuzzy": 20000**2 - 20000}


def test_best_candidates_without_pairs_of_rows(spark, tmp_path):
    """The best of 20,000 rows of one name each, and of a few names as pair by pair."""
    few, many = same_names(spark, tmp_path / "few", 60, 3), one_name(spark, tmp_path / "many", 20000)
    sku = match_queries._sides(spark, few)[1].select(F.col("id").alias("r_id"), F.col("sku").alias("r_sku"))
    best = match_queries.d12_best_candidate(spark, few)
    want = matching.best_candidate(pair_by_pair(spark, few).join(sku, "r_id"), "r_sku").select(*best.columns)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))
    assert match_queries.d12_best_candidate(spark, many).where("l_id = r_id and metodo = 'id'").count() == 20000


def test_extremes_are_as_of_all_matches(spark, tmp_path):
    """The audit's rows as pair by pair; only kinds at the ends are made into rows."""
    few = same_names(spark, tmp_path / "few", 60, 3)
    want = matching.audit_sample(pair_by_pair(spark, few).where("es_match").select("l_id", "r_id", "score"), 20)
    assert sorted(map(tuple, match_queries.d16_audit(spark, few).collect())) == sorted(map(tuple, want.collect()))
    many = match_queries.d16_audit(spark, one_name(spark, tmp_path / "many", 20000)).collect()
    ids = sorted(str(1 + 30030 * i) for i in range(20000))
    assert len(many) == 20 and {r["l_id"] for r in many if r["score"] < 100} == {ids[0]}


def test_candidates_are_counted_over_names(spark, tmp_path):
    """Each of 20,000 rows of one name has as many candidates."""
    found = match_queries.d03_candidates(spark, one_name(spark, tmp_path, 20000))
    assert {(r["n"], r["rows"]) for r in found.groupBy("n").agg(F.count("*").alias("rows")).collect()} == {(20000, 20000)}


def test_the_feed_calls_no_python_for_products(spark, tmp_path):
    """Last prices are a table of a cell's last runs, not keyed state; it keeps two runs and forgets products."""
    base, day = str(tmp_path), lambda n: f"2024-01-{n:02} 00:00:00"
    row = "run string, id string, cadena string, precio decimal(12,2), en_promocion boolean"
    for run in range(1, 5):
        cells = [(str(run), i, "x", Decimal(10 + run), False) for i in (["a", "gone"] if run == 1 else ["a"])]
        spark.createDataFrame(cells, row).withColumn("ts", F.lit(day(7 * run)).cast("timestamp")).write.mode("append").parquet(f"{base}/in")
        query = feed.change_feed(spark.readStream.schema(feed.SNAPSHOT).parquet(f"{base}/in"), f"{base}/r", f"{base}/e", f"{base}/c", 8)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
        ids = {r["id"] for r in feed.state_before(spark, f"{base}/c-state", run).collect()}
        assert ids == ({"a", "gone"} if run < 4 else {"a"})
    assert sorted(r["run"] for r in feed.state_before(spark, f"{base}/c-state", 4).collect()) == ["3", "4"]
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/e").orderBy("run").collect()
    assert [(r["run"], r["tipo_evento"], r["id"]) for r in found] == [(str(n), "sube_precio", "a") for n in (2, 3, 4)]


def test_images_settle_pairs_as_they_are_made(spark, tmp_path, monkeypatch):
    """The grey band as pair by pair, with packs of two rows; nothing is shuffled once pairs are made."""
    monkeypatch.setattr(kinds, "PACK", 2)
    few = same_names(spark, tmp_path, 60, 5)
    a, b = match_queries._sides(spark, few)
    h = match_queries._sign_bits(spark, few).select(F.col("vec_id").cast("string").alias("v"), "h")
    image = lambda df, p: df.join(h.select(F.col("v").alias(f"{p}_id"), F.col("h").alias(f"{p}_h")), f"{p}_id", "left")
    scored = matching.with_score(matching.with_rules(matching.candidate_pairs(a, b, with_quantity=True), a, b))
    want = matching.with_decision(image(image(scored, "l"), "r"), "l_h", "r_h")
    found = match_queries.d10_grey_band(spark, few)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    assert_pairs_come_last(found)
