"""Landed raw records to offers: search hits, detail records, quick views, store products, HTML tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.functions.names import normal_text, pack_count, package_size
from gondola.operators.compare import unit_price
from gondola.operators.matching import quantity

HIT = (
    "objectID string, name string, uri string, priceList double, pricePromo double, priceWithCard double, withPromotion boolean, brand string, laboratory string, lab string, "
    "activePrinciples string, presentation string, category array<string>, subCategory array<string>, prescription string, image string, gtin string, skuMifarma string, skuSap string, channels array<string>"
)
DETAIL = (
    "id string, slug string, name string, brand string, prescription string, imageList array<struct<url:string>>, eanCode string, gtin string, skuMifarma string, sapCode string, pricePack double, "
    "price double, noFractionatedText string, crossOutPL double, fractionalMode boolean, fractionatedPrice double, fractionatedText string, crossOutFractionatedPL double"
)
QUICK_VIEW = (
    "product struct<id:string,productName:string,brand:string,price:struct<sales:struct<value:double>,list:struct<value:double>>,pricebookPrices:struct<listPrice:struct<value:double>>,"
    "promotions:array<string>,ribbon:string,custom:struct<ribbon:string,medicalPrescription:boolean,healthRegistrationNumber:string>,healthRegistrationNumber:string,available:boolean,"
    "selectedProductUrl:string,images:struct<large:array<struct<url:string>>,small:array<struct<url:string>>,medium:array<struct<url:string>>>>"
)
OFFER_PART = "Price:double,ListPrice:double,PriceWithoutDiscount:double,Teasers:array<string>,PromotionTeasers:array<string>,DiscountHighLight:array<string>,AvailableQuantity:double,IsAvailable:boolean"
STORE = (
    "productId string, productName string, brand string, link string, `Presentación` array<string>, `Requiere receta médica` array<string>, "
    f"items array<struct<itemId:string,nameComplete:string,name:string,ean:string,images:array<struct<imageUrl:string>>,sellers:array<struct<commertialOffer:struct<{OFFER_PART}>>>>>"
)
# What pages and headers of bot protection hold.
CHALLENGE_SIGNS = (
    "__cf_chl", "cf-challenge", "cf_chl_opt", "/cdn-cgi/challenge-platform", "attention required", "checking your browser", "just a moment", "ddos protection by",
    "access denied", "request blocked", "incapsula", "akamai",
)
CHALLENGE_HEADERS = ("cf-ray", "cf-cache-status", "cf-mitigated", "cf-chl-bypass")
CHALLENGE_STATUS = (403, 429, 503)


def text(c) -> Column:
    """Trimmed; blank: null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def first_text(array) -> Column:
    """The first entry that isn't blank."""
    return F.trim(F.get(F.filter(array, lambda x: F.trim(x) != ""), F.lit(0)))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def from_search_hits(hits: DataFrame, chain: str, site: str) -> DataFrame:
    """Offers of search-index hits (schema HIT). The promotional price counts if above 0; a url needs both slug and id."""
    promo = positive(F.col("pricePromo"))
    slug, key = text("uri"), text("objectID")
    return hits.select(
        F.lit(chain).alias("cadena"), key.alias("sku"), text("name").alias("nombre_origen"), F.coalesce(promo, "priceList").alias("precio"), F.col("priceList").alias("precio_regular"),
        positive(F.col("priceWithCard")).alias("precio_tarjeta"), (F.coalesce("withPromotion", F.lit(False)) | promo.isNotNull()).alias("en_promocion"), text("brand").alias("marca"),
        F.coalesce(text("laboratory"), text("lab")).alias("laboratorio"), text("activePrinciples").alias("principio_activo"), text("presentation").alias("presentacion"),
        first_text("category").alias("categoria"), first_text("subCategory").alias("subcategoria"), text("prescription").alias("prescripcion"),
        F.when(slug.isNotNull() & key.isNotNull(), F.format_string(f"{site}/producto/%s/%s", slug, key)).alias("url"), text("image").alias("imagen"), text("gtin").alias("ean"),
        text("skuMifarma").alias("sku_mifarma"), text("skuSap").alias("sku_sap"),
    )


def from_details(details: DataFrame, chain: str) -> DataFrame:
    """One or two presentations of each detail record (schema DETAIL): the pack, and in fractional mode the fraction, where priced above 0 and labelled."""
    row = lambda kind, price, label, crossed: F.struct(F.lit(kind).alias("presentacion_kind"), price.alias("precio"), text(label).alias("presentacion"), F.col(crossed).alias("precio_regular"))
    both = F.array(row("pack", F.coalesce("pricePack", "price"), "noFractionatedText", "crossOutPL"), F.when(F.col("fractionalMode"), row("fraccion", F.col("fractionatedPrice"), "fractionatedText", "crossOutFractionatedPL")))
    rows = details.where(text("id").isNotNull()).withColumn("p", F.explode(F.filter(both, lambda p: (p["precio"] > 0) & p["presentacion"].isNotNull())))
    label = normal_text(F.col("p.presentacion"))
    rows = rows.withColumn("_q", quantity(package_size(label), pack_count(label)))
    return rows.select(
        F.lit(chain).alias("cadena"), text("id").alias("sku"), text("name").alias("nombre_origen"), text("brand").alias("marca"), "p.presentacion_kind", "p.presentacion", "p.precio",
        F.coalesce("p.precio_regular", "p.precio").alias("precio_regular"), (F.coalesce("p.precio_regular", F.lit(0.0)) > 0).alias("en_promocion"), F.col("_q.valor").alias("cantidad_envase"),
        F.col("_q.clase").alias("unidad_envase"), unit_price(F.col("p.precio"), F.col("_q.valor")).alias("precio_por_unidad"), F.coalesce(text("eanCode"), text("gtin")).alias("ean"),
        text("skuMifarma").alias("sku_mifarma"), text("sapCode").alias("sku_sap"), F.get("imageList.url", F.lit(0)).alias("imagen"),
    )


def from_quick_views(raw: DataFrame, chain: str, column: str = "json") -> DataFrame:
    """Offers of quick-view JSON texts (schema QUICK_VIEW); the sanitary registry goes to ean. Stock and prescription have three states."""
    rows = raw.select(F.from_json(column, QUICK_VIEW)["product"].alias("p")).where("p.id is not null")
    sale, listed = F.col("p.price.sales.value"), F.coalesce("p.price.list.value", "p.pricebookPrices.listPrice.value")
    promo = (F.size(F.coalesce("p.promotions", F.array().cast("array<string>"))) > 0) | F.coalesce(text("p.ribbon"), text("p.custom.ribbon")).isNotNull() | F.coalesce(listed > sale, F.lit(False))
    image = F.coalesce(*[F.get(F.col(f"p.images.{s}.url"), F.lit(0)) for s in ("large", "small", "medium")])
    return rows.select(
        F.lit(chain).alias("cadena"), F.col("p.id").alias("sku"), text("p.productName").alias("nombre_origen"), sale.alias("precio"), F.coalesce(listed, sale).alias("precio_regular"),
        promo.alias("en_promocion"), text("p.brand").alias("marca"), F.when(F.col("p.custom.medicalPrescription"), "con receta").when(~F.col("p.custom.medicalPrescription"), "sin receta").alias("prescripcion"),
        F.col("p.available").alias("stock"), text("p.selectedProductUrl").alias("url"), image.alias("imagen"), F.coalesce(text("p.custom.healthRegistrationNumber"), text("p.healthRegistrationNumber")).alias("ean"),
    )


def valid_barcode(c: Column) -> Column:
    """8 to 14 digits, else null."""
    return F.when(F.trim(c).rlike("^[0-9]{8,14}$"), F.trim(c))


def from_store_products(products: DataFrame, chain: str) -> DataFrame:
    """One offer an item of store products (schema STORE), by its first seller."""
    rows = products.withColumn("i", F.explode("items")).withColumn("o", F.get("i.sellers", F.lit(0))["commertialOffer"])
    price, listed = F.col("o.Price"), F.coalesce(positive(F.col("o.ListPrice")), F.col("o.PriceWithoutDiscount"))
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    promo = some("o.Teasers") | some("o.PromotionTeasers") | some("o.DiscountHighLight") | F.coalesce(listed > price, F.lit(False))
    return rows.select(
        F.lit(chain).alias("cadena"), F.coalesce(text("i.itemId"), text("productId")).alias("sku"), F.coalesce(text("i.nameComplete"), text("i.name"), text("productName")).alias("nombre_origen"),
        price.alias("precio"), listed.alias("precio_regular"), promo.alias("en_promocion"), text("brand").alias("marca"), first_text("Presentación").alias("presentacion"),
        first_text("Requiere receta médica").alias("prescripcion"), F.coalesce("o.IsAvailable", F.col("o.AvailableQuantity") > 0).alias("stock"), text("link").alias("url"),
        F.get("i.images.imageUrl", F.lit(0)).alias("imagen"), valid_barcode(F.col("i.ean")).alias("ean"),
    )


def from_tiles(pages: DataFrame, chain: str, site: str, column: str = "html") -> DataFrame:
    """Offers of product tiles in HTML pages; tiles without a product id drop out. Prices come from content attributes, else from text such as 'S/ 1,234.50'."""
    parts = F.slice(F.split(column, r'(?=<div[^>]*\bclass="[^"]*\bproduct\b[^"]*"[^>]*\bdata-pid=)'), F.lit(1), F.lit(1_000_000))
    rows = pages.select(F.posexplode(parts).alias("pos", "tile"))
    got = lambda p: text(F.regexp_extract("tile", p, 1))
    image = F.regexp_extract("tile", r'<img[^>]*class="[^"]*tile-image[^"]*"[^>]*>', 0)
    of_image = lambda a: text(F.regexp_extract(image, rf'\b{a}="([^"]*)"', 1))
    content = got(r'class="[^"]*\bsales\b[^"]*"[\s\S]*?class="[^"]*\bvalue\b[^"]*"[^>]*\bcontent="([^"]*)"').try_cast("double")
    written = F.replace(got(r"S/\s*([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(","), F.lit("")).try_cast("double")
    href = got(r'<a[^>]*\bhref="([^"]*)"')
    return rows.select(
        F.lit(chain).alias("cadena"), got(r'\bdata-pid="([^"]*)"').alias("sku"), F.coalesce(of_image("alt"), of_image("title"), got(r"<a[^>]*>([^<]+)</a>")).alias("nombre_origen"),
        F.coalesce(content, written).alias("precio"), F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href).alias("url"), of_image("src").alias("imagen"),
    ).where("sku is not null")


def from_paths(raw: DataFrame, mapping: dict[str, tuple[str, str]], column: str = "json") -> DataFrame:
    """Columns by declared paths: target -> ('a.b | c[0]', type). The first path with a non-blank value wins; what doesn't cast is null."""
    def value(paths: str, kind: str) -> Column:
        found = F.coalesce(*[text(F.get_json_object(column, "$." + p.strip())) for p in paths.split("|")])
        return found if kind == "string" else found.try_cast(kind)

    return raw.select(*[value(p, k).alias(t) for t, (p, k) in mapping.items()])


def first_seen(rows: DataFrame, key: str = "sku", order: str = "arrival", channel: str | None = None, priced: bool = False) -> DataFrame:
    """The first row (by order) of each key; with channel only rows whose channels hold it, with priced only rows with a price."""
    if channel is not None:
        rows = rows.where(F.array_contains("channels", channel))
    if priced:
        rows = rows.where("precio is not null")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def safe_name(c: Column) -> Column:
    """Lower case; runs of other characters than letters, digits, dot, underscore and hyphen as one underscore; 60 characters at most; never empty."""
    slug = F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9._-]+", "_"), F.lit("_"))
    return F.substring(F.coalesce(F.nullif(slug, F.lit("")), F.lit("x")), 1, 60)


def audit_pages(responses: DataFrame) -> DataFrame:
    """responses (url, status, content_type, headers map, body) with senales, reto, extension and slug.

    senales: signs of bot protection in headers (any case; null: none) and in the first 8192
    characters of the body. reto: there are some, and the status is one of CHALLENGE_STATUS.
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    h = lambda k: F.try_element_at(lower, F.lit(k))
    head = F.lower(F.substring(F.coalesce("body", F.lit("")), 1, 8192))
    found = F.filter(F.array(*[F.lit(s) for s in CHALLENGE_SIGNS]), lambda s: F.contains(head, s))
    signs = F.array(
        F.when(F.contains(F.lower(h("server")), F.lit("cloudflare")), F.concat(F.lit("server="), h("server"))),
        *[F.when(h(k).isNotNull(), F.concat(F.lit(f"{k}="), h(k))) for k in CHALLENGE_HEADERS],
        F.when(F.exists(F.map_keys(lower), lambda k: k.startswith("x-akamai") | k.startswith("akamai")), "headers akamai-*"),
        F.when(h("x-iinfo").isNotNull() | F.contains(F.lower(F.coalesce(h("set-cookie"), F.lit(""))), F.lit("incap_ses")), "incapsula/imperva"),
        F.when(h("x-sucuri-id").isNotNull(), "sucuri"),
        F.when(F.size(found) > 0, F.concat(F.lit("body:"), F.array_join(found, ","))),
    )
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    extension = F.lit("bin")
    for part, name in (("text/plain", "txt"), ("ecmascript", "js"), ("javascript", "js"), ("xml", "xml"), ("html", "html"), ("json", "json")):
        extension = F.when(F.contains(kind, F.lit(part)), name).otherwise(extension)
    out = responses.withColumn("senales", F.filter(signs, lambda x: x.isNotNull()))
    return out.withColumns({"reto": F.coalesce(F.col("status").isin(*CHALLENGE_STATUS), F.lit(False)) & (F.size("senales") > 0), "extension": extension, "slug": safe_name(F.col("url"))})
