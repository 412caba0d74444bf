"""Which offers of different chains are the same product: identifiers, lossless blocking, hard rules, fuzzy score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.functions import names
from gondola.functions.similarity import cosine, hamming, image_hash, letters, token_set_bound, token_set_ratio
from gondola.sources.folders import exists, stored

# Bands, weights, tolerances.
MATCH, REVIEW = 85.0, 70.0
NAME_WEIGHT, NUCLEUS_WEIGHT = 0.35, 0.65
SIZE_TOLERANCE = 0.10
MOST_BITS = 10
PRICE_BAND = (0.60, 1.65)
#: Join keys with more pairs are cut into a grid with about so many rows a side.
BLOCK_PAIRS, BLOCK_SIDE = 1_000_000, 1000
#: Width of the logarithmic buckets of quantities: at least -ln(0.9), so equals within the tolerance are at most one bucket apart.
BUCKET = 0.1054


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle: repeating names make small files of large tables, which would be broadcast for that."""
    return df.hint("merge")


def match_by_identifier(left: DataFrame, right: DataFrame, shared_namespace: bool = True, id_column: str = "sku") -> DataFrame:
    """Pairs (l_id, r_id, metodo) with one sku ('id'), else one non-blank ean ('ean'). Inputs: id, sku, ean.

    shared_namespace says that both sides' skus come from one numbering; otherwise only ean counts.
    """
    a = left.select(F.col("id").alias("l_id"), F.col(id_column).alias("sku"), F.nullif(F.trim("ean"), F.lit("")).alias("ean"))
    b = right.select(F.col("id").alias("r_id"), F.col(id_column).alias("sku"), F.nullif(F.trim("ean"), F.lit("")).alias("ean"))
    by_ean = a.where("ean is not null").join(shuffled(b.where("ean is not null").drop("sku")), "ean").select("l_id", "r_id", F.lit("ean").alias("metodo"), F.lit(1).alias("_o"))
    if not shared_namespace:
        return by_ean.drop("_o").distinct()
    by_sku = a.where("sku <> ''").join(shuffled(b.where("sku <> ''").drop("ean")), "sku").select("l_id", "r_id", F.lit("id").alias("metodo"), F.lit(0).alias("_o"))
    return by_sku.unionByName(by_ean).groupBy("l_id", "r_id").agg(F.min_by("metodo", "_o").alias("metodo"))


def group_price_join(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """left with r_precio of the sister chain's row of the same sku and kind (null kind: pack); of several, the last by order; right prices must be known."""
    kind = lambda c: F.coalesce(F.col(c), F.lit("pack"))
    last = right.where("precio is not null").groupBy(F.col("sku").alias("_sku"), kind("presentacion_kind").alias("_kind")).agg(F.max_by("precio", order).alias("r_precio"))
    return left.join(last, (F.col("sku") == F.col("_sku")) & (kind("presentacion_kind") == F.col("_kind")), "left").drop("_sku", "_kind")


def cross_match_candidates(left: DataFrame, excluded: list[str], column: str = "categoria") -> DataFrame:
    """Rows whose category takes part in matching across chains."""
    return left.where(~F.coalesce(F.lower(column).isin([e.lower() for e in excluded]), F.lit(False)))


def quantity(size: Column, count: Column) -> Column:
    """Struct (valor, clase) of the package size, else of the count as units, else null."""
    return F.coalesce(size, F.when(count.isNotNull(), F.struct(count.cast("double").alias("valor"), F.lit("un").alias("clase"))))


def quantity_bucket(value: Column) -> Column:
    """Bucket of a positive quantity; null for others, which match nothing."""
    return F.when(value > 0, F.floor(F.log(value) / BUCKET))


def quantities_agree(a: Column, b: Column) -> Column:
    """One class, and within the tolerance of the larger; null: false."""
    near = F.abs(a["valor"] - b["valor"]) <= SIZE_TOLERANCE * F.greatest(a["valor"], b["valor"])
    return F.coalesce((a["clase"] == b["clase"]) & near, F.lit(False))


def quantity_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l_id, r_id) whose quantities agree, by an equi-join on class and neighbouring buckets. Inputs: id, q."""
    a = left.select(F.col("id").alias("l_id"), F.col("q").alias("l_q"), F.explode(F.sequence(quantity_bucket(F.col("q.valor")) - 1, quantity_bucket(F.col("q.valor")) + 1)).alias("_b"))
    b = right.select(F.col("id").alias("r_id"), F.col("q").alias("r_q"), quantity_bucket(F.col("q.valor")).alias("_rb"))
    on = (F.col("l_q.clase") == F.col("r_q.clase")) & (F.col("_b") == F.col("_rb"))
    return a.join(b, on).where(quantities_agree(F.col("l_q"), F.col("r_q"))).select("l_id", "r_id")


def ranked_tokens(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with tokens, the words of clave from the rarest (in both sides together) to the most frequent. Inputs: id, clave and more, each id once a side."""
    words = lambda df: df.select("*", F.explode("clave").alias("_t"))
    often = words(left).select("_t").unionByName(words(right).select("_t")).groupBy("_t").agg(F.count("*").alias("_n"))

    def side(df: DataFrame) -> DataFrame:
        ranks = words(df).select("id", "_t").join(shuffled(often), "_t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_n", "_t"))).alias("_r"))
        return df.join(shuffled(ranks), "id", "left").withColumn("tokens", F.coalesce(F.transform("_r", lambda x: x["_t"]), F.array().cast("array<string>"))).drop("_r")

    return side(left), side(right)


def spread(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join with _i and _j as further keys: keys with more than BLOCK_PAIRS pairs are cut into a grid of about BLOCK_SIDE rows a side, so none is a task's alone.

    Each row is in one strip of its own side and in every strip of the other, so each pair meets once.
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    strips = lambda n: F.ceil(F.col(n) / BLOCK_SIDE).cast("int")
    large = count(a, "_na").join(shuffled(count(b, "_nb")), keys).where(F.col("_na") * F.col("_nb") > BLOCK_PAIRS).select(*keys, strips("_na").alias("_si"), strips("_nb").alias("_sj"))

    def dealt(df: DataFrame, row: str, own: str, other: str) -> DataFrame:
        sized = df.join(shuffled(large), keys, "left")
        strip = F.coalesce(F.pmod(F.xxhash64(row), F.col(f"_s{own}")), F.lit(0)).cast("int")
        return sized.withColumn(f"_{own}", strip).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_s{other}") - 1, F.lit(0))))).drop("_si", "_sj")

    return dealt(a, a_id, "i", "j"), dealt(b, b_id, "j", "i")


def candidate_pairs(left: DataFrame, right: DataFrame, with_quantity: bool = False) -> DataFrame:
    """Pairs (l_id, r_id) that the rules for active ingredient, variant and audience (and quantity) don't rule out, each once.

    Inputs: id, clave, variante, infantil (names.features), and q if with_quantity. Pairs share
    a key token, or one side has none; variants, audience and the quantity bucket are part of
    the join key. A pair is kept at its rarest shared token only. A side without tokens meets all
    rows of the other side that have its key, under a token of their own. Nothing that the rules
    accept is lost, and frequent tokens and keys are cut into a grid (spread).
    """

    def side(df: DataFrame, p: str, is_left: bool) -> DataFrame:
        # "": rows without tokens on the left and all on the right; " ": rows with tokens on the left and without on the right
        empty, alone, every = F.size("tokens") == 0, F.array(F.lit(" ")), F.array(F.lit(""))
        keys = F.when(empty, every).otherwise(F.concat("tokens", alone)) if is_left else F.concat("tokens", F.when(empty, F.array(F.lit(""), F.lit(" "))).otherwise(every))
        cols = [F.col("id").alias(f"{p}id"), F.col("tokens").alias(f"{p}tokens"), F.to_json(F.struct("variante", "infantil")).alias("_v")]
        if not with_quantity:
            return df.select(*cols, F.explode(keys).alias("_t"))
        bucket = quantity_bucket(F.col("q.valor"))
        cols += [F.col("q").alias(f"{p}q"), F.col("q.clase").alias("_c"), keys.alias("_keys")]
        out = df.select(*cols, F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_b")) if is_left else df.where(bucket.isNotNull()).select(*cols, bucket.alias("_b"))
        return out.withColumn("_t", F.explode("_keys")).drop("_keys")

    left, right = ranked_tokens(left, right)
    keys = ["_t", "_v", *(["_c", "_b"] if with_quantity else [])]
    a, b = spread(side(left, "l_", True), side(right, "r_", False), keys, "l_id", "r_id")
    met = a.join(shuffled(b), [*keys, "_i", "_j"])
    rarest = F.get(F.array_intersect("l_tokens", "r_tokens"), F.lit(0))
    met = met.where(F.col("_t").isin("", " ") | (F.col("_t") == rarest))
    if with_quantity:
        met = met.where(quantities_agree(F.col("l_q"), F.col("r_q")))
    return met.select("l_id", "r_id")


def hard_rules(a, b) -> list[tuple[str, Column]]:
    """The hard rules in order with the condition that breaks each. a, b: functions from a feature's name to its column."""
    ca, cb = a("conc"), b("conc")
    compatible = F.when(a("concentracion") == b("concentracion"), True).when(ca.isNull() | cb.isNull() | (ca["unidad"] != cb["unidad"]), False)
    compatible = compatible.when(F.abs(ca["valor"] - cb["valor"]) > 1e-6, False).otherwise(F.coalesce(F.abs(ca["denominador"] - cb["denominador"]) <= 1e-6, F.lit(True)))
    solid, liquid = names.SOLID_FORMS, names.LIQUID_FORMS
    clash = lambda x, y: x.isin(*solid) & y.isin(*liquid) | x.isin(*liquid) & y.isin(*solid)
    ta, tb = a("tamano"), b("tamano")
    sizes = (ta["clase"] == tb["clase"]) & (F.abs(ta["valor"] - tb["valor"]) / F.greatest(ta["valor"], tb["valor"], F.lit(1e-9)) > SIZE_TOLERANCE)
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    other_form = F.when(a("gomita"), b("forma")).otherwise(a("forma"))
    count = lambda x: F.nullif(x, F.lit(0))
    return [
        ("concentracion", a("concentracion").isNotNull() & b("concentracion").isNotNull() & ~compatible),
        ("cantidad", count(a("cantidad")) != count(b("cantidad"))),
        ("forma", clash(a("forma"), b("forma"))),
        ("presentacion", a("efervescente") & b("tableta_plana") | b("efervescente") & a("tableta_plana")),
        ("envase", sizes),
        ("activo", apart(a("clave"), b("clave")) | (a("variante") != b("variante"))),
        ("audiencia", a("infantil") != b("infantil")),
        ("vitamina", apart(a("vitaminas"), b("vitaminas"))),
        ("gomita", (a("gomita") != b("gomita")) & other_form.isin(*solid)),
    ]


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is broken, or null."""
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])


def rule_violation(a, b) -> Column:
    """The first hard rule that a pair breaks, or null. a, b: functions from a feature's name to its column."""
    return first_broken(hard_rules(a, b))


def with_rules(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with l_ and r_ features and motivo: the hard rule broken, or null."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    joined = pairs.join(shuffled(a), "l_id").join(shuffled(b), "r_id")
    return joined.withColumn("motivo", rule_violation(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))


def with_score(ruled: DataFrame) -> DataFrame:
    """score 0 for pairs with motivo; else names and nuclei compared, each pair of distinct texts once."""
    texts = ["l_texto_norm", "r_texto_norm", "l_nucleo", "r_nucleo"]
    distinct = ruled.where("motivo is null").select(*texts).distinct()
    scored = distinct.withColumn("score", NAME_WEIGHT * token_set_ratio(F.col("l_texto_norm"), F.col("r_texto_norm")) + NUCLEUS_WEIGHT * token_set_ratio(F.col("l_nucleo"), F.col("r_nucleo")))
    blocked = ruled.where("motivo is not null").withColumn("score", F.lit(0.0))
    return ruled.where("motivo is null").join(scored, texts).unionByName(blocked)


def with_decision(scored: DataFrame, left_hash: str | None = None, right_hash: str | None = None) -> DataFrame:
    """es_match, metodo, revisar by the bands; with image hashes (64-bit columns) the grey band is settled by them where both are known."""
    score, grey = F.col("score"), (F.col("score") >= REVIEW) & (F.col("score") < MATCH) & F.col("motivo").isNull()
    same = hamming(F.col(left_hash), F.col(right_hash)) <= MOST_BITS if left_hash else F.lit(None).cast("boolean")
    out = scored.withColumn("_same", F.when(grey, same))
    out = out.withColumn("metodo", F.when(F.col("motivo").isNotNull(), "regla_dura").when(F.col("_same").isNotNull(), "imagen").otherwise("fuzzy"))
    out = out.withColumn("es_match", F.coalesce("_same", (score >= MATCH) & F.col("motivo").isNull()))
    out = out.withColumn("revisar", grey & F.col("_same").isNull())
    return out.withColumn("score", F.when(F.col("_same"), F.greatest(score, F.lit(MATCH))).otherwise(score)).drop("_same")


def split_matches(left: DataFrame, right: DataFrame, shared_namespace: bool, with_quantity: bool) -> tuple[DataFrame, DataFrame]:
    """Identifier matches (l_id, r_id, metodo, es_match, score, revisar, motivo) and the other candidate pairs (l_id, r_id)."""
    hard = match_by_identifier(left, right, shared_namespace).withColumns({"es_match": F.lit(True), "score": F.lit(100.0), "revisar": F.lit(False), "motivo": F.lit(None).cast("string")})
    if with_quantity:
        sides = hard.join(left.select(F.col("id").alias("l_id"), F.col("q").alias("_lq")), "l_id").join(right.select(F.col("id").alias("r_id"), F.col("q").alias("_rq")), "r_id")
        hard = sides.where(quantities_agree(F.col("_lq"), F.col("_rq")) & (F.col("_lq.valor") > 0)).drop("_lq", "_rq")
    hard = stored(hard, "identified")
    return hard, candidate_pairs(left, right, with_quantity).join(hard.select("l_id", "r_id"), ["l_id", "r_id"], "left_anti")


def match_offers(left: DataFrame, right: DataFrame, shared_namespace: bool = False, with_quantity: bool = False) -> DataFrame:
    """Identifier matches and scored candidates: l_id, r_id, es_match, score, metodo, revisar, motivo.

    Inputs: id, sku, ean and names.features, and q if with_quantity; then only pairs whose
    quantities agree. An identifier match has score 100 whatever the names say.
    """
    hard, pairs = split_matches(left, right, shared_namespace, with_quantity)
    soft = with_decision(with_score(with_rules(pairs, left, right)))
    columns = ["l_id", "r_id", "es_match", "score", "metodo", "revisar", "motivo"]
    return hard.select(*columns).unionByName(soft.select(*columns))


def score_bound() -> Column:
    """An upper bound of the score of a pair with l_ and r_ texts and their letters."""
    text, core = (token_set_bound(F.col(f"l_{c}"), F.col(f"r_{c}"), F.col(f"l_{c}_letters"), F.col(f"r_{c}_letters")) for c in ("texto_norm", "nucleo"))
    return NAME_WEIGHT * text + NUCLEUS_WEIGHT * core


def best_matches(left: DataFrame, right: DataFrame, order: str, shared_namespace: bool = False, with_quantity: bool = False) -> DataFrame:
    """best_candidate of match_offers, scoring only pairs that can still win: l_id, r_id, score, es_match, revisar, metodo.

    order: a column of right that decides ties. Each pair that no rule breaks has an upper bound
    of its score from lengths, shared words and letter counts. Pairs bound below REVIEW drop out;
    of each l_id the pair of greatest bound is scored first (score 100 by an identifier stands),
    then those whose bound reaches that score. The result is the same as with all pairs scored.
    """
    hard, pairs = split_matches(left, right, shared_namespace, with_quantity)
    sized = lambda df: df.withColumns({f"{c}_letters": letters(F.col(c)) for c in ("texto_norm", "nucleo")})
    kept = with_rules(pairs, sized(left), sized(right)).where("motivo is null").withColumn("bound", score_bound()).where(F.col("bound") >= REVIEW)
    kept = stored(kept.select("l_id", "r_id", "l_texto_norm", "r_texto_norm", "l_nucleo", "r_nucleo", "motivo", F.col(f"r_{order}").alias("_order"), "bound"), "bounded")
    known = hard.groupBy("l_id").agg(F.max("score").alias("best"))
    # of pairs without an identifier match, the one of greatest bound
    rank = F.max_by("r_id", F.struct("bound", "r_id"))
    first = kept.join(known, "l_id", "left_anti").groupBy("l_id").agg(rank.alias("r_id"))
    first = stored(with_score(kept.join(first, ["l_id", "r_id"])), "first")
    best = known.unionByName(first.select("l_id", F.col("score").alias("best")))
    rest = kept.join(first.select("l_id", "r_id"), ["l_id", "r_id"], "left_anti").join(best, "l_id").where(F.col("bound") >= F.col("best")).drop("best")
    columns = ["l_id", "r_id", "score", "es_match", "revisar", "metodo"]
    soft = with_decision(first.unionByName(with_score(rest).select(first.columns))).select(*columns, "_order")
    named = hard.join(right.select(F.col("id").alias("r_id"), F.col(order).alias("_order")), "r_id").select(*columns, "_order")
    return best_candidate(named.unionByName(soft), "_order").select(*columns)


def best_candidate(scored: DataFrame, order: str = "r_orden") -> DataFrame:
    """For each l_id the candidate of greatest score from REVIEW up; ties go to the lesser order, then r_id. A candidate may serve several."""
    rank = W.partitionBy("l_id").orderBy(F.col("score").desc(), order, "r_id")
    return scored.where(F.col("score") >= REVIEW).withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def plausible_price(a: Column, b: Column) -> Column:
    """The ratio of b to a lies in the band of plausible ones."""
    ratio = F.try_divide(b, a)
    return (ratio >= PRICE_BAND[0]) & (ratio <= PRICE_BAND[1])


def weighted_score(name: Column, image: Column, brand: Column) -> Column:
    """0.55 name + 0.30 image + 0.15 brand; unknown parts count as 0."""
    return 0.55 * F.coalesce(name, F.lit(0.0)) + 0.30 * F.coalesce(image, F.lit(0.0)) + 0.15 * F.coalesce(brand, F.lit(0.0))


def embedding_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of their vectors. vectors: vec_id, embedding."""
    v = lambda p: vectors.select(F.col("vec_id").alias(p), F.col("embedding").alias(f"_{p}"))
    return pairs.join(v("a"), "a").join(v("b"), "b").withColumn("coseno", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


HASHES = "url string, hash long"


def stored_hashes(spark: SparkSession, path: str) -> DataFrame:
    """url, hash of all images hashed so far; null: the image couldn't be read."""
    return spark.read.schema(HASHES).parquet(path)


def hash_images(images: DataFrame, path: str) -> DataFrame:
    """Hash the images (url, pixels) that the store lacks, each distinct url once, and add them; returns those. A null url has no hash, an image that can't be read keeps a null one and isn't tried again."""
    spark = images.sparkSession
    new = images.where("url is not null").dropDuplicates(["url"])
    if exists(spark, path):
        new = new.join(stored_hashes(spark, path).select("url"), "url", "left_anti")
    new = stored(new.select("url", image_hash("pixels").alias("hash")), "hashed")
    new.write.mode("append").parquet(path)
    return new


def audit_sample(matches: DataFrame, n: int) -> DataFrame:
    """The n // 2 lowest and n - n // 2 highest scores (all, if no more than n), ties by ids."""
    ends = matches.orderBy("score", "l_id", "r_id").limit(n // 2).unionByName(matches.orderBy(F.col("score").desc(), F.col("l_id").desc(), F.col("r_id").desc()).limit(n - n // 2))
    return ends.distinct()


def coverage(canonical: DataFrame, matches: DataFrame) -> DataFrame:
    """total, con, sin, pct (floor) of canonical ids with a match, and how many matches are by ean."""
    has = matches.select(F.col("l_id").alias("id")).distinct().withColumn("_has", F.lit(1))
    counts = canonical.select("id").join(has, "id", "left").agg(F.count("*").alias("total"), F.count("_has").alias("con"))
    return counts.withColumns({"sin": F.col("total") - F.col("con"), "pct": F.coalesce(F.floor(F.try_divide(100 * F.col("con"), F.col("total"))), F.lit(0))})


def canonical_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the rows of right whose sku left doesn't have; solo_derecha marks those."""
    only = right.join(left.select("sku").distinct(), "sku", "left_anti").withColumn("solo_derecha", F.lit(True))
    return left.withColumn("solo_derecha", F.lit(False)).unionByName(only)


assert BUCKET >= -math.log(1 - SIZE_TOLERANCE)
