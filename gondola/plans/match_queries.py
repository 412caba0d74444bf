"""Names (C) and matching (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import names
from gondola.functions.similarity import hamming, image_hash
from gondola.operators import kinds, matching
from gondola.plans.offerview import LAST, NAME_A, NAME_B, OFFERS, named, offers, table
from gondola.sources.folders import new_folder, stored


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _forms(w: str, other: str) -> str:
    return f"CASE {w} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.FORMS.items()) + f" ELSE {other} END"


def features_sql(source: str, keep: str) -> str:
    """CTEs f1 to f4 over a relation with nombre_origen; f4 has the features."""
    vitamin = names.VITAMIN.replace(r"(?=\b|\d)", r"(?:\b|\d)")
    return f"""f1 AS (
  SELECT {keep}, nombre_origen, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(coalesce(nombre_origen, ''), 'º', 'o'), 'ª', 'a'))),
    '[^a-z0-9%./ ]+', ' ', 'g'), '{names.UNIT_GAP}', '\\1\\2', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: {_forms("w", "w")}), ' ') AS texto_norm FROM {source}
), f2 AS (
  SELECT *, list_filter(string_split(texto_norm, ' '), lambda w: w <> '') AS toks, nullif(replace(regexp_replace(regexp_extract(texto_norm, '{names.STRENGTH}'), '\\s+', '', 'g'), ',', '.'), '') AS c1,
    try_cast(replace(nullif(regexp_extract(texto_norm, '{names.GRAM_DOSE}', 1), ''), ',', '.') AS DOUBLE) AS g,
    regexp_replace(texto_norm, '{names.STRENGTH}', ' ', 'g') AS rest,
    list_filter(string_split(regexp_replace(texto_norm, '{names.NUMBERS}', ' ', 'g'), ' '), lambda w: NOT list_contains({_list(names.STOP_WORDS)}, w) AND length(w) > 2) AS nt FROM f1
), f3 AS (
  SELECT *, coalesce(c1, CASE WHEN g > 0 AND g <= 5 THEN regexp_replace(g::DECIMAL(20,6)::VARCHAR, '\\.?0+$', '') || 'g' END) AS concentracion,
    {_forms(f"list_filter(toks, lambda w: list_contains({_list(names.FORMS)}, w))[1]", "NULL")} AS forma,
    coalesce(try_cast(nullif(regexp_extract(texto_norm, '{names.COUNT}', 1), '') AS INT), try_cast(nullif(regexp_extract(texto_norm, '{names.COUNT}', 2), '') AS INT), try_cast(nullif(regexp_extract(texto_norm, '{names.COUNT}', 3), '') AS INT)) AS cantidad,
    try_cast(replace(regexp_extract_all(rest, '{names.SIZE}', 1)[-1], ',', '.') AS DOUBLE) AS sv, regexp_extract_all(rest, '{names.SIZE}', 2)[-1] AS su,
    array_to_string(nt, ' ') AS nucleo, list_sort(list_distinct(list_filter(nt, lambda w: NOT list_contains({_list(names.GENERIC_WORDS + names.VARIANT_WORDS)}, w)))) AS clave,
    list_sort(list_distinct(list_filter(nt, lambda w: list_contains({_list(names.VARIANT_WORDS)}, w)))) AS variante, list_has_any(nt, {_list(names.CHILD_WORDS)}) AS infantil,
    list_sort(list_distinct(regexp_extract_all(texto_norm, '{vitamin}', 1))) AS vitaminas, contains(texto_norm, 'efervescente') AS efervescente,
    NOT list_has_any(toks, {_list(("efervescente", *names.NOT_PLAIN_WORDS))}) AND list_has_any(toks, {_list(names.SOLID_FORMS)}) AS tableta_plana, contains(texto_norm, 'gomita') AS gomita FROM f2
), f4 AS (
  SELECT *, sv * CASE WHEN su IN ('l', 'kg') THEN 1000 ELSE 1 END AS tam_valor, CASE WHEN sv IS NULL THEN NULL WHEN su IN ('ml', 'l') THEN 'ml' WHEN su IN ('g', 'gr', 'kg') THEN 'g' ELSE 'un' END AS tam_clase,
    try_cast(nullif(regexp_extract(concentracion, '{names.CONCENTRATION}', 1), '') AS DOUBLE) * CASE regexp_extract(concentracion, '{names.CONCENTRATION}', 2) WHEN 'g' THEN 1000 WHEN 'mcg' THEN 0.001 ELSE 1 END AS conc_valor,
    CASE WHEN regexp_extract(concentracion, '{names.CONCENTRATION}', 2) IN ('g', 'mcg') THEN 'mg' ELSE regexp_extract(concentracion, '{names.CONCENTRATION}', 2) END AS conc_unidad,
    try_cast(nullif(regexp_extract(concentracion, '{names.CONCENTRATION}', 3), '') AS DOUBLE) AS conc_den FROM f3
)"""


def _names_sql() -> str:
    return f"src AS (SELECT p_partkey::VARCHAR || '/' || w AS id, CASE w WHEN 'a' THEN {NAME_A} ELSE {NAME_B} END AS nombre_origen FROM part, (VALUES ('a'), ('b')) t(w))"


def _both(spark, d):
    a, b = named(spark, d, NAME_A), named(spark, d, NAME_B)
    return a.withColumn("id", F.concat("id", F.lit("/a"))).unionByName(b.withColumn("id", F.concat("id", F.lit("/b")))).select("id", "nombre_origen")


def _flat(df):
    return df.withColumns({"tam_valor": F.col("tamano.valor"), "tam_clase": F.col("tamano.clase"), "conc_valor": F.col("conc.valor"), "conc_den": F.col("conc.denominador")})


def c_normal_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(names.normal_text(F.col("text"))).alias("norm"))


def c_name_specs(spark, d):
    """Dose, form, count, size, parsed dose and signature (C3 to C7, C9, C13)."""
    out = _flat(names.features(_both(spark, d)))
    return out.select("id", "texto_norm", "concentracion", "forma", "cantidad", "tam_valor", "tam_clase", "conc_valor", "conc_den", names.spec_signature(F.col("concentracion"), F.col("forma"), F.col("cantidad")).alias("firma"))


def c_name_tokens(spark, d):
    """Nucleus, key and variant words, audience, vitamins, flags and search keys (C8, C10 to C12, C14)."""
    text = lambda c: F.array_join(c, " ").alias(c)
    out = names.features(_both(spark, d))
    keys = [names.search_key(F.col("nombre_origen"), F.split("nucleo", " "), n).alias(f"busca_{n}") for n in (1, 3)]
    return out.select("id", "nucleo", text("clave"), text("variante"), "infantil", text("vitaminas"), "efervescente", "tableta_plana", "gomita", *keys)


def c15_slugs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_size").alias("slug"))
    return rows.select("p_partkey", names.slug_base(F.col("slug")).alias("base"), names.slug_title(F.col("slug")).alias("titulo"), names.count_text(F.concat("slug", F.lit(" ,"))).alias("n"))


def _sides(spark, d):
    """Both chains' names with their features, computed once."""
    q = lambda df: names.features(df).withColumn("q", matching.quantity(F.col("tamano"), F.col("cantidad")))
    return stored(q(named(spark, d, NAME_A)), "names"), stored(q(named(spark, d, NAME_B)), "names")


def _kinds(spark, d):
    """Both chains' rows, and their names with features."""
    q = lambda df: names.features(df).withColumn("q", matching.quantity(F.col("tamano"), F.col("cantidad")))
    return kinds.side(named(spark, d, NAME_A), q), kinds.side(named(spark, d, NAME_B), q)


def d01_identifiers(spark, d):
    return matching.match_by_identifier(named(spark, d, NAME_A), named(spark, d, NAME_B))


D01 = """WITH b AS (SELECT p_partkey::VARCHAR AS r_id, CASE WHEN p_partkey % 3 = 0 THEN 'X' || p_partkey ELSE p_partkey::VARCHAR END AS sku, CASE WHEN p_partkey % 5 = 0 THEN '77500' || p_partkey END AS ean FROM part),
a AS (SELECT p_partkey::VARCHAR AS l_id, p_partkey::VARCHAR AS sku, CASE WHEN p_partkey % 5 = 0 THEN '77500' || p_partkey END AS ean FROM part)
SELECT l_id, r_id, CASE WHEN a.sku = b.sku THEN 'id' ELSE 'ean' END AS metodo FROM a JOIN b ON a.sku = b.sku OR a.ean = b.ean"""


def d02_group_join(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST)
    left = rows.where("cadena = 'america'").select("sku", "presentacion_kind", "precio")
    right = rows.where("cadena = 'europe'").select("sku", "presentacion_kind", "precio", F.col("cantidad").alias("orden"))
    return matching.group_price_join(left, right, "orden")


def d03_candidates(spark, d):
    return kinds.candidate_counts(*_kinds(spark, d), with_quantity=True)


QS = "CASE WHEN tam_valor IS NOT NULL THEN tam_valor ELSE cantidad END AS qv, CASE WHEN tam_valor IS NOT NULL THEN tam_clase WHEN cantidad IS NOT NULL THEN 'un' END AS qc"
SIDES = f"""{_names_sql()}, {features_sql("src", "id")}, s AS (SELECT *, {QS} FROM f4), a AS (SELECT * REPLACE (split_part(id, '/', 1) AS id) FROM s WHERE id LIKE '%/a'), b AS (SELECT * REPLACE (split_part(id, '/', 1) AS id) FROM s WHERE id LIKE '%/b')"""
NEAR = "a.qc = b.qc AND abs(a.qv - b.qv) <= 0.1 * greatest(a.qv, b.qv) AND a.qv > 0 AND b.qv > 0"
PAIRS = f"""{SIDES}, pairs AS (SELECT a.id AS l_id, b.id AS r_id, a.* EXCLUDE (id), b.id AS bid, b.concentracion AS b_concentracion FROM a JOIN b ON a.variante = b.variante AND a.infantil = b.infantil AND {NEAR}
  AND (list_has_any(a.clave, b.clave) OR len(a.clave) = 0 OR len(b.clave) = 0))"""
RULES = """CASE
  WHEN a.concentracion IS NOT NULL AND b.concentracion IS NOT NULL AND NOT (a.concentracion = b.concentracion OR (a.conc_valor IS NOT NULL AND b.conc_valor IS NOT NULL AND a.conc_unidad = b.conc_unidad
    AND abs(a.conc_valor - b.conc_valor) <= 1e-6 AND coalesce(abs(a.conc_den - b.conc_den) <= 1e-6, true))) THEN 'concentracion'
  WHEN nullif(a.cantidad, 0) <> nullif(b.cantidad, 0) THEN 'cantidad'
  WHEN (a.forma IN ('tableta', 'capsula') AND b.forma IN ('jarabe', 'suspension', 'solucion', 'gotas')) OR (b.forma IN ('tableta', 'capsula') AND a.forma IN ('jarabe', 'suspension', 'solucion', 'gotas')) THEN 'forma'
  WHEN (a.efervescente AND b.tableta_plana) OR (b.efervescente AND a.tableta_plana) THEN 'presentacion'
  WHEN a.tam_clase = b.tam_clase AND abs(a.tam_valor - b.tam_valor) / greatest(a.tam_valor, b.tam_valor, 1e-9) > 0.1 THEN 'envase'
  WHEN (len(a.clave) > 0 AND len(b.clave) > 0 AND NOT list_has_any(a.clave, b.clave)) OR a.variante <> b.variante THEN 'activo'
  WHEN a.infantil <> b.infantil THEN 'audiencia'
  WHEN len(a.vitaminas) > 0 AND len(b.vitaminas) > 0 AND NOT list_has_any(a.vitaminas, b.vitaminas) THEN 'vitamina'
  WHEN a.gomita <> b.gomita AND (CASE WHEN a.gomita THEN b.forma ELSE a.forma END) IN ('tableta', 'capsula') THEN 'gomita' END"""


def d06_quantity_join(spark, d):
    """Counts of units within a tenth, over distinct quantities."""
    a, b = _sides(spark, d)
    one = lambda df: df.where("q is not null").select(F.to_json("q").alias("id"), "q").distinct()
    return matching.quantity_join(one(a), one(b)).groupBy(F.lit("pares").alias("que")).agg(F.count("*").alias("n"))


def d07_rules(spark, d):
    """How many pairs of one brand word break each rule."""
    return kinds.rule_counts(*_kinds(spark, d), F.get(F.split("nombre_origen", " "), F.lit(0)))


def d12_best_candidate(spark, d):
    """Identifiers first, then blocked, ruled, scored (D1, D3, D5 to D9), best one a reference (D12)."""
    return kinds.best_rows(*_kinds(spark, d), "sku", shared_namespace=True, with_quantity=True)


def d18_match_offers(spark, d):
    """All identifier matches and candidates of like quantity with their decisions."""
    return kinds.match_rows(*_kinds(spark, d), shared_namespace=True, with_quantity=True)


def _sign_bits(spark, d):
    """vec_id, label and h, the signs of the 64 numbers as bits."""
    bit = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return table(spark, d, "embeddings").select("vec_id", "label", bit(F.col("embedding")).alias("h"))


def d16_audit(spark, d):
    """The ten lowest and ten highest scores of matches, for an audit by hand."""
    return kinds.extreme_rows(*_kinds(spark, d), 20, shared_namespace=True, with_quantity=True)


def d16_methods(spark, d):
    """Matches by the method that found them."""
    return kinds.match_counts(*_kinds(spark, d), shared_namespace=True, with_quantity=True).where("es_match").groupBy("metodo").agg(F.sum("n").alias("n"))


def d10_image_bits(spark, d):
    """Vectors of one label whose sign bits differ in at most MOST_BITS of 64 places: such pairs have one of MOST_BITS + 1 bands in common."""
    n = matching.MOST_BITS + 1
    at = [64 * k // n for k in range(n + 1)]
    bands = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("h", at[k]).bitwiseAND(F.lit((1 << at[k + 1] - at[k]) - 1).cast("long")).alias("x")) for k in range(n)])
    v = _sign_bits(spark, d).withColumn("band", F.explode(bands))
    a, b = v.select(F.col("vec_id").alias("a"), "label", "band", F.col("h").alias("ha")), v.select(F.col("vec_id").alias("b"), "label", "band", F.col("h").alias("hb"))
    near = a.join(b, ["label", "band"]).where("a < b").where(hamming(F.col("ha"), F.col("hb")) <= matching.MOST_BITS)
    return near.select("a", "b").distinct()


def d10_grey_band(spark, d):
    """Decisions of candidates (D9) where image hashes settle the grey band (D10): a product's image is the vector of its number, unknown for the rest."""
    a, b = _kinds(spark, d)
    h = _sign_bits(spark, d).select(F.col("vec_id").cast("string").alias("id"), "h")
    a, b = (s._replace(rows=s.rows.join(matching.shuffled(h), "id", "left")) for s in (a, b))
    pairs = kinds.row_pairs(kinds.scored_kinds(a, b, with_quantity=True), a, b, ["id", "h"])
    decided = matching.with_decision(pairs.select(F.col("l.id").alias("l_id"), F.col("r.id").alias("r_id"), "score", "motivo", F.col("l.h").alias("l_h"), F.col("r.h").alias("r_h")), "l_h", "r_h")
    return decided.select("l_id", "r_id", "score", "es_match", "revisar", "metodo", "motivo")


BITS = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"
D10 = f"""WITH v AS (SELECT vec_id, label, {BITS} AS h FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE hamming(a.h, b.h) <= {matching.MOST_BITS}"""


def _alike(a: str, b: str) -> str:
    """SQL for the likeness of two strings by their longest common subsequence, one bit a letter of a (120 at most)."""
    masks = f"list_transform(string_split({b}, ''), lambda letter: list_sum(list_transform(range(length({a})), lambda k: CASE WHEN {a}[k + 1] = letter THEN 1::HUGEINT << k::INT ELSE 0::HUGEINT END))::HUGEINT)"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    rest = f"list_reduce({masks}, lambda row, m: ((row + (row & m)) | (row - (row & m))) & {full}, {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 0.0 END ELSE 100.0::DOUBLE * 2 * (length({a}) - bit_count({rest})) / (length({a}) + length({b})) END"


# token-set likeness of each pair of texts (x, y) of the relation soft
SCORES = f"""texts AS (SELECT ta AS x, tb AS y FROM soft WHERE motivo IS NULL UNION SELECT na, nb FROM soft WHERE motivo IS NULL
), w1 AS (SELECT *, list_sort(list_distinct(list_filter(string_split(x, ' '), lambda w: w <> ''))) AS xs, list_sort(list_distinct(list_filter(string_split(y, ' '), lambda w: w <> ''))) AS ys FROM texts
), w2 AS (SELECT x, y, array_to_string(list_filter(xs, lambda w: list_contains(ys, w)), ' ') AS i, array_to_string(list_filter(xs, lambda w: NOT list_contains(ys, w)), ' ') AS p, array_to_string(list_filter(ys, lambda w: NOT list_contains(xs, w)), ' ') AS q FROM w1
), w3 AS (SELECT *, trim(i || ' ' || p) AS ip, trim(i || ' ' || q) AS iq FROM w2
), likeness AS (SELECT x, y, CASE WHEN x = '' OR y = '' THEN 0.0::DOUBLE WHEN i <> '' AND (p = '' OR q = '') THEN 100.0::DOUBLE
    WHEN i <> '' THEN greatest({_alike("i", "ip")}, {_alike("i", "iq")}, {_alike("ip", "iq")}) ELSE {_alike("p", "q")} END AS r FROM w3
), scored AS (SELECT l_id, r_id, motivo, CASE WHEN motivo IS NOT NULL THEN 0.0::DOUBLE ELSE 0.35::DOUBLE * n.r + 0.65::DOUBLE * m.r END AS score
  FROM soft LEFT JOIN likeness n ON n.x = ta AND n.y = tb LEFT JOIN likeness m ON m.x = na AND m.y = nb)"""
SOFT = f"""soft AS (SELECT a.id AS l_id, b.id AS r_id, a.texto_norm AS ta, b.texto_norm AS tb, a.nucleo AS na, b.nucleo AS nb, {RULES} AS motivo FROM a JOIN b ON a.variante = b.variante AND a.infantil = b.infantil AND {NEAR}
  AND (list_has_any(a.clave, b.clave) OR len(a.clave) = 0 OR len(b.clave) = 0))"""
MATCHED = f"""{SIDES}, {SOFT}, {SCORES}, ids AS ({D01}), hard AS (SELECT l_id, r_id, metodo FROM ids JOIN a ON a.id = l_id JOIN b ON b.id = r_id WHERE {NEAR}
), matched AS (SELECT l_id, r_id, true AS es_match, 100.0::DOUBLE AS score, metodo, false AS revisar, NULL AS motivo FROM hard
  UNION ALL SELECT l_id, r_id, score >= 85 AND motivo IS NULL, score, CASE WHEN motivo IS NULL THEN 'fuzzy' ELSE 'regla_dura' END, score >= 70 AND score < 85 AND motivo IS NULL, motivo FROM scored ANTI JOIN hard USING (l_id, r_id))"""
GREY = f"""WITH {SIDES}, {SOFT}, {SCORES}, v AS (SELECT vec_id::VARCHAR AS id, {BITS} AS h FROM embeddings
), same AS (SELECT l_id, r_id, motivo, score, CASE WHEN score >= 70 AND score < 85 AND motivo IS NULL THEN hamming(x.h, y.h) <= {matching.MOST_BITS} END AS s FROM scored LEFT JOIN v x ON x.id = l_id LEFT JOIN v y ON y.id = r_id)
SELECT l_id, r_id, CASE WHEN s THEN greatest(score, 85) ELSE score END AS score, coalesce(s, score >= 85 AND motivo IS NULL) AS es_match, s IS NULL AND score >= 70 AND score < 85 AND motivo IS NULL AS revisar,
  CASE WHEN motivo IS NOT NULL THEN 'regla_dura' WHEN s IS NOT NULL THEN 'imagen' ELSE 'fuzzy' END AS metodo, motivo FROM same"""


def d13_plausible(spark, d):
    w = offers(spark, d).where(F.col("run") == LAST)
    a, b = w.where("cadena = 'asia'").select("id", F.col("precio").alias("a")), w.where("cadena = 'europe'").select("id", F.col("precio").alias("b"))
    return a.join(b, "id").select("id", matching.plausible_price(F.col("a"), F.col("b")).alias("plausible"))


def d15_cosine(spark, d):
    v = table(spark, d, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return matching.embedding_pairs(v, pairs).select("a", "b", F.round("coseno", 6).alias("coseno"))


D15 = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS coseno FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def d16_coverage(spark, d):
    a, b = named(spark, d, NAME_A), named(spark, d, NAME_B)
    return matching.coverage(a, matching.match_by_identifier(a, b, shared_namespace=False))


def d17_canonical(spark, d):
    rows = offers(spark, d).where(F.col("run") == LAST)
    one = lambda c: rows.where(F.col("cadena") == c).select("sku").distinct()
    return matching.canonical_set(one("africa"), one("asia"))


def d08_scores(spark, d):
    """Scores of identifier matches and candidates (D1, D8), with their bands (D9)."""
    scored = kinds.match_counts(*_kinds(spark, d), shared_namespace=True, with_quantity=True)
    band = F.when(F.col("metodo") == "regla_dura", "regla").when(F.col("es_match"), "match").when(F.col("revisar"), "revisar").otherwise("no")
    return scored.groupBy(band.alias("banda")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 2).alias("media"))


def d11_image_hash(spark, d):
    """Hashes of images made of the vectors: the products of their first 32 numbers (rows) and the other 32 (columns) as pixels."""
    e = F.col("embedding").cast("array<double>")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.get(e, F.floor(k / 32).cast("int")) * F.get(e, 32 + k % 32))
    return table(spark, d, "embeddings").select("vec_id", image_hash(pixels).alias("hash"))


def _pixels(spark, d):
    e = F.col("embedding").cast("array<double>")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.get(e, F.floor(k / 32).cast("int")) * F.get(e, 32 + k % 32))
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("/img/"), F.floor(F.col("vec_id") / 2) * 2).alias("url"), pixels.alias("pixels"))


def d11_stored_hashes(spark, d):
    """Two runs over a store of hashes: the even vectors, then all; two vectors share a url, whose image is the even one's."""
    path = new_folder(spark, "hashes")
    rows = _pixels(spark, d)
    images = rows.where("vec_id % 2 = 0").select("url", "pixels")
    matching.hash_images(images.where(F.substring("url", 6, 20).cast("long") % 4 == 0), path)
    matching.hash_images(images, path)
    return rows.select("vec_id", "url").join(matching.stored_hashes(spark, path), "url", "left").select("vec_id", "hash")


def _waves(k: int) -> str:
    return f"list_transform(range(8), lambda u: list_sum(list_transform(range(32), lambda i: embedding[i + {k}]::DOUBLE * cos(pi() * (2 * i + 1) * u / 64))))"


D11 = f"""WITH f AS (SELECT vec_id, {_waves(1)} AS a, {_waves(33)} AS b FROM embeddings), p AS (SELECT vec_id, list_transform(range(64), lambda k: a[k // 8 + 1] * b[k % 8 + 1]) AS low FROM f
), h AS (SELECT vec_id, list_sum(list_transform(range(64), lambda k: CASE WHEN low[k + 1] > list_median(low) THEN 1::HUGEINT << (63 - k)::INT ELSE 0::HUGEINT END))::HUGEINT AS n FROM p)
SELECT vec_id, (CASE WHEN n >= 1::HUGEINT << 63 THEN n - (1::HUGEINT << 64) ELSE n END)::BIGINT AS hash FROM h"""


def d14_weighted(spark, d):
    """Name, image and brand of vector neighbours in one score."""
    pairs = d15_cosine(spark, d)
    return pairs.select("a", "b", F.round(matching.weighted_score((F.col("a") % 7 / 7.0), F.when(F.col("a") % 3 > 0, F.col("coseno")), F.when(F.col("a") % 2 > 0, 1.0)), 5).alias("score"))


def d04_excluded(spark, d):
    return matching.cross_match_candidates(offers(spark, d).where(F.col("run") == LAST), ["Promo", "LARGE"]).groupBy("categoria").agg(F.count("*").alias("n"))


FEATURES = f"WITH {_names_sql()}, {features_sql('src', 'id')}"
ALL = {
    "c_normal_text": (c_normal_text, f"WITH src AS (SELECT doc_id, text AS nombre_origen FROM documents), {features_sql('src', 'doc_id')} SELECT doc_id, md5(texto_norm) AS norm FROM f1"),
    "c_name_specs": (c_name_specs, f"{FEATURES} SELECT id, texto_norm, concentracion, forma, cantidad, tam_valor, tam_clase, conc_valor, conc_den, coalesce(concentracion, '') || '|' || coalesce(forma, '') || '|' || coalesce(cantidad::VARCHAR, '') AS firma FROM f4"),
    "c_name_tokens": (c_name_tokens, f"{FEATURES} SELECT id, nucleo, array_to_string(clave, ' ') AS clave, array_to_string(variante, ' ') AS variante, infantil, array_to_string(vitaminas, ' ') AS vitaminas, efervescente, tableta_plana, gomita, array_to_string(nt[1:1], ' ') AS busca_1, array_to_string(nt[1:3], ' ') AS busca_3 FROM f4"),
    "c15_slugs": (c15_slugs, "SELECT p_partkey, replace(p_name, ' ', '-') AS base, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titulo, p_size AS n FROM part"),
    "d01_identifiers": (d01_identifiers, D01),
    "d02_group_join": (d02_group_join, f"WITH {OFFERS} SELECT a.sku, a.presentacion_kind, a.precio, b.precio AS r_precio FROM offers a LEFT JOIN offers b ON a.sku = b.sku AND a.presentacion_kind = b.presentacion_kind AND b.run = '{LAST}' AND b.cadena = 'europe' WHERE a.run = '{LAST}' AND a.cadena = 'america'"),
    "d03_candidates": (d03_candidates, f"WITH {PAIRS} SELECT l_id, count(*) AS n FROM pairs GROUP BY l_id"),
    "d04_excluded": (d04_excluded, f"WITH {OFFERS} SELECT categoria, count(*) AS n FROM offers WHERE run = '{LAST}' AND categoria NOT IN ('PROMO', 'LARGE') GROUP BY categoria"),
    "d06_quantity_join": (d06_quantity_join, f"WITH {SIDES} SELECT 'pares' AS que, count(*) AS n FROM (SELECT DISTINCT qv, qc FROM a) a JOIN (SELECT DISTINCT qv, qc FROM b) b ON {NEAR}"),
    "d07_rules": (d07_rules, f"WITH {SIDES} SELECT {RULES} AS motivo, count(*) AS n FROM a JOIN b ON split_part(a.nombre_origen, ' ', 1) = split_part(b.nombre_origen, ' ', 1) GROUP BY ALL"),
    "d10_image_bits": (d10_image_bits, D10),
    "d08_scores": (d08_scores, f"WITH {MATCHED} SELECT CASE WHEN metodo = 'regla_dura' THEN 'regla' WHEN es_match THEN 'match' WHEN revisar THEN 'revisar' ELSE 'no' END AS banda, count(*) AS n, round(avg(score), 2) AS media FROM matched GROUP BY ALL"),
    "d10_grey_band": (d10_grey_band, GREY),
    "d11_image_hash": (d11_image_hash, D11),
    "d11_stored_hashes": (d11_stored_hashes, f"WITH hashed AS ({D11}) SELECT e.vec_id, hash FROM embeddings e LEFT JOIN hashed h ON h.vec_id = e.vec_id // 2 * 2"),
    "d14_weighted": (d14_weighted, f"WITH c AS ({D15}) SELECT a, b, round(0.55 * (a % 7 / 7.0) + 0.3 * (CASE WHEN a % 3 > 0 THEN coseno ELSE 0 END) + 0.15 * (CASE WHEN a % 2 > 0 THEN 1 ELSE 0 END), 5) AS score FROM c"),
    "d12_best_candidate": (d12_best_candidate, f"WITH {MATCHED}, skus AS (SELECT p_partkey::VARCHAR AS r_id, CASE WHEN p_partkey % 3 = 0 THEN 'X' || p_partkey ELSE p_partkey::VARCHAR END AS r_sku FROM part) SELECT l_id, r_id, score, es_match, revisar, metodo FROM matched JOIN skus USING (r_id) WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_sku, r_id) = 1"),
    "d13_plausible": (d13_plausible, f"WITH {OFFERS} SELECT id, b.precio >= 0.6 * a.precio AND b.precio <= 1.65 * a.precio AS plausible FROM offers a JOIN offers b USING (id) WHERE a.run = '{LAST}' AND b.run = '{LAST}' AND a.cadena = 'asia' AND b.cadena = 'europe'"),
    "d15_cosine": (d15_cosine, D15),
    "d16_coverage": (d16_coverage, "SELECT count(*) AS total, count(*) FILTER (p_partkey % 5 = 0) AS con, count(*) FILTER (p_partkey % 5 <> 0) AS sin, floor(100 * count(*) FILTER (p_partkey % 5 = 0) / count(*))::BIGINT AS pct FROM part"),
    "d16_audit": (d16_audit, f"WITH {MATCHED}, m AS (SELECT l_id, r_id, score FROM matched WHERE es_match) SELECT * FROM (SELECT * FROM m ORDER BY score, l_id, r_id LIMIT 10) UNION SELECT * FROM (SELECT * FROM m ORDER BY score DESC, l_id DESC, r_id DESC LIMIT 10)"),
    "d16_methods": (d16_methods, f"WITH {MATCHED} SELECT metodo, count(*) AS n FROM matched WHERE es_match GROUP BY metodo"),
    "d18_match_offers": (d18_match_offers, f"WITH {MATCHED} SELECT l_id, r_id, es_match, score, metodo, revisar, motivo FROM matched"),
    "d17_canonical": (d17_canonical, f"WITH {OFFERS}, l AS (SELECT DISTINCT sku FROM offers WHERE run = '{LAST}' AND cadena = 'africa'), r AS (SELECT DISTINCT sku FROM offers WHERE run = '{LAST}' AND cadena = 'asia') SELECT sku, false AS solo_derecha FROM l UNION ALL SELECT sku, true FROM r ANTI JOIN l USING (sku)"),
}
