"""Product markup and records. The sample has no product markup, so each query writes its documents from the part and
order tables first (whole tables) and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwave.functions import numbers as N
from shelfwave.operators import markup as K, products as P
from shelfwave.plans.registry import query
from shelfwave.sources import samples as S


def product_pages(spark, sf):
    """One page per part with a JSON-LD graph: product, referenced brand and image, offers of several kinds."""
    part = S.spread(S.load(spark, sf, "part"))
    key = F.col("p_partkey")
    offer_kind = F.pmod(key, F.lit(3))
    text = lambda c: F.to_json(F.struct(c.alias("x")))
    ref = lambda kind: F.concat(F.lit('{"@id":"#'), F.lit(kind), F.lit('"}'))
    plain = F.concat(F.lit('{"@type":"Offer","price":"'), F.translate(F.col("p_retailprice").cast("string"), ".", ","), F.lit('","priceCurrency":"EUR","sku":"S'), key,
                     F.lit('","name":" Havana  '), F.col("p_size"), F.lit('","availability":"https://schema.org/'), F.when(F.pmod(key, F.lit(2)) == 0, "InStock").otherwise("OutOfStock"), F.lit('"}'))
    low = F.concat(F.lit('{"@type":"AggregateOffer","lowPrice":'), F.col("p_retailprice"), F.lit(',"priceCurrency":"USD"}'))
    spec = F.concat(F.lit('{"@type":"Offer","priceSpecification":[{"priceType":"https://schema.org/ListPrice","price":"'), F.col("p_retailprice") + 50, F.lit('"},{"price":"'),
                    F.col("p_retailprice"), F.lit('","priceCurrency":"TND"}]}'))
    offers = F.when(offer_kind == 0, F.concat(F.lit("["), plain, F.lit(","), plain, F.lit("]"))).when(offer_kind == 1, low).otherwise(spec)
    product = F.concat(F.lit('{"@type":["Product","Thing"],"name":" '), F.col("p_name"), F.lit(' ","url":"/p/'), key, F.lit('","brand":'), ref("brand"), F.lit(',"image":['), ref("image"),
                       F.lit('],"offers":'), offers, F.lit("}"))
    graph = F.concat(F.lit('{"@graph":[{"@type":"Brand","@id":"#brand","name":"'), F.col("p_brand"), F.lit('"},{"@type":"ImageObject","@id":"#image","contentUrl":"/img/'), key,
                     F.lit('.jpg"},{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":'), product, F.lit("}]}]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), graph, F.lit("</script></html>"))
    return part.select(key.alias("page_id"), F.concat(F.lit("https://shop.example/p/"), key).alias("url"), html.alias("html"))


@query("json_ld_products", """
SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 3 = 2 THEN round(p_retailprice + 50, 2) END AS list_price,
  CASE p_partkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'TND' END AS currency, 'https://shop.example/img/' || p_partkey || '.jpg' AS image_url, 'https://shop.example/p/' || p_partkey AS url FROM part""")
def json_ld_products(spark, sf):
    rows = K.page_product(K.json_ld_products(product_pages(spark, sf)))
    return rows.select("page_id", "name", "brand", F.round("price", 2).alias("price"), F.round("list_price", 2).alias("list_price"), "currency", "image_url", "url")


@query("offer_variants", """
SELECT p_partkey AS page_id, 'S' || p_partkey AS code, 'Havana ' || p_size AS color, p_partkey % 2 = 0 AS in_stock FROM part WHERE p_partkey % 3 = 0""")
def offer_variants(spark, sf):
    rows = K.json_ld_products(product_pages(spark, sf))
    return rows.select("page_id", F.explode(K.offer_variants(F.col("offers"))).alias("v")).select("page_id", "v.*")


def catalog_listings(spark, sf):
    """One catalog document per brand, its parts as products."""
    part = S.load(spark, sf, "part")
    size = F.col("p_size")
    variant = lambda n: F.struct(F.when(F.pmod(size, F.lit(2)) == 0, F.concat(F.lit(f"SKU{n}-"), F.col("p_partkey"))).alias("sku"), (F.col("p_partkey") * 10 + n).cast("string").alias("id"),
                                 F.col("p_retailprice").cast("string").alias("price"), (F.pmod(F.col("p_partkey") + n, F.lit(3)) == 0).alias("available"), F.concat(F.lit("T"), F.lit(n)).alias("title"),
                                 F.lit("M").alias("option1"), F.get(F.split("p_name", " "), F.lit(0)).alias("option2"))
    product = F.struct(F.when(F.pmod("p_partkey", F.lit(19)) != 0, F.concat(F.lit("h"), F.col("p_partkey"))).alias("handle"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"),
                       F.array(variant(1), variant(2)).alias("variants"), F.array(F.struct(F.concat(F.lit("https://cdn.example/"), F.col("p_partkey")).alias("src"))).alias("images"),
                       F.array(F.struct(F.lit("Size").alias("name")), F.struct(F.lit("Colour").alias("name"))).alias("options"),
                       F.array(F.when(size < 10, "Acetate Frame").when(size < 20, "Titanium").otherwise("Plain"), F.when(size > 40, "New Arrivals").otherwise("Shape-cat-eye"), F.lit("The Icons")).alias("tags"),
                       F.concat(F.lit("<p>About "), F.col("p_name"), F.lit("</p>")).alias("body_html"))
    docs = part.groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", product.alias("p")))).alias("ps"))
    return docs.select(F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example/collections/all?page="), F.col("page")).alias("page_url"),
                       F.to_json(F.struct(F.transform("ps", lambda x: x["p"]).alias("products"))).alias("payload"))


@query("catalog_json_products", """
SELECT 'https://' || lower(replace(p_brand, '#', '')) || '.example/products/h' || p_partkey AS url,
  row_number() OVER (PARTITION BY p_brand, p_partkey // 100 ORDER BY p_partkey) AS rank, p_name AS name, CASE WHEN p_brand LIKE 'Brand#1%' OR p_brand = 'Brand#7' THEN 'Brand#1' ELSE p_brand END AS brand,
  round(p_retailprice, 2) AS price, (p_partkey + 1) % 3 <> 0 AND (p_partkey + 2) % 3 <> 0 AS out_of_stock,
  CASE WHEN p_size % 2 = 0 THEN 'SKU1-' || p_partkey ELSE CAST(p_partkey * 10 + 1 AS VARCHAR) END AS code, split_part(p_name, ' ', 1) AS color,
  CASE WHEN p_size < 10 THEN 'acetate' WHEN p_size < 20 THEN 'metal' ELSE 'horn' END AS material, CASE WHEN p_size > 40 THEN true END AS is_new, true AS is_bestseller,
  'About ' || p_name || CASE WHEN p_size > 40 THEN '' ELSE ' cat eye' END AS description
FROM part WHERE p_partkey % 19 <> 0""")
def catalog_json_products(spark, sf):
    config = K.CatalogConfig(default_brand="Brand#1", brand_aliases=("Brand#7",), default_material="horn")
    rows = K.catalog_products(catalog_listings(spark, sf), config)
    return rows.select("url", "rank", "name", "brand", F.round("price", 2).alias("price"), "out_of_stock", F.col("variants")[0]["code"].alias("code"),
                       F.col("variants")[0]["color"].alias("color"), "material", "is_new", "is_bestseller", "description")


@query("json_ld_deep_products", "SELECT p_partkey AS page_id, p_name AS name, CAST(1 + 3 * (p_partkey % 40) AS INTEGER) AS depth FROM part")
def json_ld_deep_products(spark, sf):
    """Products under item lists of lists, up to 39 of them; the path says how deep."""
    deep = F.pmod("p_partkey", F.lit(40)).cast("int")
    html = F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit('{"@type":"ItemList","itemListElement":[["x",'), deep), F.lit('{"@type":"Product","name":"'), F.col("p_name"),
                    F.lit('"}'), F.repeat(F.lit("]]}"), deep), F.lit("</script>"))
    pages = S.spread(S.load(spark, sf, "part")).select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.example/").alias("url"), html.alias("html"))
    return K.json_ld_products(pages).select("page_id", "name", F.size("path").alias("depth"))


def family_listings(spark, sf):
    part = S.load(spark, sf, "part")
    member = F.struct(F.col("p_partkey").cast("string").alias("id"), F.get(F.split("p_name", " "), F.lit(0)).alias("color"), (F.pmod("p_partkey", F.lit(4)) == 0).alias("isInStock"), F.col("p_name").alias("name"),
                      F.when(F.pmod("p_partkey", F.lit(2)) == 0, "sunGlasses").otherwise("optical").alias("kind"), F.concat(F.lit("$"), F.col("p_retailprice")).alias("price"),
                      F.when(F.col("p_size") < 15, "HB").when(F.col("p_size") < 30, "GD").otherwise("ZZ").alias("eyewireMaterial"), F.lit("Wide  bridge").alias("description"), F.col("p_type").alias("primaryShape"),
                      F.array(F.struct(F.lit("Made in Italy").alias("label"))).alias("tags"))
    fams = part.groupBy(F.floor(F.col("p_partkey") / 5).alias("fam")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", member.alias("m")))).alias("ms"))
    docs = fams.groupBy(F.floor(F.col("fam") / 20).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("fam", "ms"))).alias("fs"))
    return docs.select(F.lit("https://family.example/catalog").alias("page_url"), F.to_json(F.struct(F.transform("fs", lambda f: F.transform(f["ms"], lambda m: m["m"])).alias("items"))).alias("payload"))


@query("family_json_products", """
WITH f AS (SELECT p_partkey // 5 AS fam, arg_min(struct_pack(p_partkey, p_name, p_size, p_type, p_retailprice), p_partkey) AS a, bool_or(p_partkey % 4 = 0) AS stock, count(*) AS n FROM part GROUP BY 1)
SELECT 'https://family.example/' || CASE WHEN a.p_partkey % 2 = 0 THEN 'sunglasses/' ELSE 'eyeglasses/' END || replace(a.p_name, ' ', '-') AS url, row_number() OVER (PARTITION BY fam // 20 ORDER BY fam) AS rank,
  a.p_name AS name, round(a.p_retailprice, 2) AS price, NOT stock AS out_of_stock, n AS variants, CASE WHEN a.p_size < 15 THEN 'acetate' WHEN a.p_size < 30 THEN 'metal' END AS material,
  'Wide bridge ' || lower(a.p_type) AS description, 'Italy' AS made_in FROM f""")
def family_json_products(spark, sf):
    rows = K.family_products(family_listings(spark, sf), "House")
    return rows.select("url", "rank", "name", F.round("price", 2).alias("price"), "out_of_stock", F.size("variants").cast("long").alias("variants"), "material", "description", "made_in")


def widget_pages(spark, sf):
    part = S.load(spark, sf, "part")
    word = F.get(F.split("p_name", " "), F.lit(0))
    vto = F.concat(F.lit('<script data-vto-carousel="1">{"frames":[{"variants":[{"variantLabel":"'), word, F.lit(" / Blue/"), F.lit('","sizes":[{"frameId":"5 KORE '), F.col("p_size"), F.lit(' A-'), F.col("p_partkey"),
                   F.lit('"}]},{"variantLabel":"Solo","sizes":[{"frameId":"B'), F.col("p_partkey"), F.lit('"}]}]}]}</script>'))
    meta = F.concat(F.lit('<script>var meta = {"product":{"variants":[{"id":'), F.col("p_partkey") + 1000, F.lit(',"public_title":"A/'), F.col("p_partkey"), F.lit('"},{"id":0,"public_title":null}]}}; go();</script>'))
    return part.select("p_partkey", word.alias("word"), F.concat(vto, meta).alias("html"))


@query("widget_variants", """
SELECT p_partkey, 'A/' || p_partkey AS code, split_part(p_name, ' ', 1) || '+Blue' AS layers, CAST(p_partkey + 1000 AS VARCHAR) AS id FROM part
UNION ALL SELECT p_partkey, 'B' || p_partkey, NULL, NULL FROM part""")
def widget_variants(spark, sf):
    rows = widget_pages(spark, sf)
    none = F.lit(None)
    variant = lambda code: F.struct(code.alias("code"), none.cast("array<string>").alias("layers"), none.cast("string").alias("id"))
    variants = F.array(variant(F.concat(F.lit("A/"), F.col("p_partkey"))), variant(F.concat(F.lit("B"), F.col("p_partkey"))))
    rows = rows.select("p_partkey", variants.alias("v"), K.try_on_layers(F.col("html")).alias("layers"), K.analytics_titles(F.col("html")).alias("titles"))
    rows = rows.select("p_partkey", F.explode(K.with_ids(K.with_layers(F.col("v"), F.col("layers")), F.col("titles"))).alias("v"))
    return rows.select("p_partkey", "v.code", F.array_join("v.layers", "+").alias("layers"), "v.id")


# --- records ---------------------------------------------------------------------------------------

@query("description_specs", """
SELECT p_partkey, p_brand AS brand, p_type AS shape, CAST(p_size AS VARCHAR) || ': mm' AS size FROM part""")
def description_specs(spark, sf):
    text = F.concat(F.lit("Lunette pour tous – Marque :  "), F.col("p_brand"), F.lit(" — Forme: "), F.col("p_type"), F.lit(" | Forme : autre\n x : non ; Taille :"), F.col("p_size"), F.lit(": mm • fin"))
    specs = P.description_specs(text)
    return S.load(spark, sf, "part").select("p_partkey", specs["Marque"].alias("brand"), specs["Forme"].alias("shape"), specs["Taille"].alias("size"))


@query("price_texts", """
SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice, 2) AS price, CASE l_linenumber % 4 WHEN 0 THEN 'TND' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' END AS currency FROM lineitem""")
def price_texts(spark, sf):
    plain = F.format_number("l_extendedprice", 2)
    french = F.translate(plain, ",.", " ,")
    text = (F.when(F.pmod("l_linenumber", F.lit(4)) == 0, F.concat(french, F.lit(" DT"))).when(F.pmod("l_linenumber", F.lit(4)) == 1, F.concat(F.lit("€"), plain))
            .when(F.pmod("l_linenumber", F.lit(4)) == 2, F.concat(F.translate(plain, ",.", ".,"), F.lit(" usd"))).otherwise(F.format_string("%.2f", "l_extendedprice")))
    price, currency = N.price_of(text)
    return S.load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(price, 2).alias("price"), currency.alias("currency"))


@query("merged_layers", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'card' END AS name, CASE WHEN p_size % 3 = 0 THEN round(p_retailprice, 2) ELSE 7.5 END AS price,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 9.5 END AS list_price, 'TND' AS currency, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE 'House' END AS brand FROM part""")
def merged_layers(spark, sf):
    none = F.lit(None)
    page = F.struct(F.when(F.pmod("p_size", F.lit(2)) == 0, F.col("p_name")).alias("name"), F.when(F.pmod("p_size", F.lit(5)) == 0, F.col("p_brand")).alias("brand"),
                    F.when(F.pmod("p_size", F.lit(3)) == 0, F.col("p_retailprice")).otherwise(0.0).alias("price"), F.lit(0.0).alias("list_price"), none.cast("string").alias("currency"), none.cast("string").alias("image_url"))
    card = F.struct(F.lit("card").alias("name"), none.cast("string").alias("brand"), F.lit(7.5).alias("price"), F.lit(9.5).alias("list_price"), none.cast("string").alias("currency"), none.cast("string").alias("image_url"))
    rows = S.load(spark, sf, "part").select("p_partkey", page.alias("page"), card.alias("card"))
    return rows.select("p_partkey", *P.merged(["page", "card"], "TND", "House")).select("p_partkey", "name", F.round("price", 2).alias("price"), "list_price", "currency", "brand")


@query("merged_specs", "SELECT p_partkey, p_brand AS a, 'list' AS b, p_type AS c FROM part")
def merged_specs(spark, sf):
    specs = P.merged_specs(F.create_map(F.lit("A"), F.col("p_brand"), F.lit("C"), F.col("p_type")), F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("list")))
    return S.load(spark, sf, "part").select("p_partkey", specs["A"].alias("a"), specs["B"].alias("b"), specs["C"].alias("c"))


@query("variant_stock_and_colors", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN true ELSE p_partkey % 3 <> 0 END AS sold_out, split_part(p_name, ' ', 2) AS color, split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) AS subparts,
  CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name FROM part""")
def variant_stock_and_colors(spark, sf):
    none = F.lit(None).cast("array<string>")
    label = F.concat(F.translate("p_name", " ", "/"), F.lit(" - Lens "), F.col("p_type"))
    variants = F.array(F.struct(F.lit("v").alias("code"), label.alias("color"), (F.pmod("p_partkey", F.lit(3)) == 0).alias("in_stock"), none.alias("parts"), none.alias("subparts")))
    rows = S.load(spark, sf, "part").select("*", P.split_colors(variants, P.ColorSplit(" - ", 0, P.ColorSplit("/", 1))).alias("v"))
    name = F.when(F.pmod("p_size", F.lit(2)) == 0, P.stripped_name(F.col("p_name"), r" \w+$")).otherwise(P.stripped_name(F.col("p_name"), "^.*$"))
    return rows.select("p_partkey", P.sold_out(F.when(F.pmod("p_size", F.lit(7)) == 0, F.lit(True)), F.col("v")).alias("sold_out"), F.col("v")[0]["color"].alias("color"),
                       F.array_join(F.col("v")[0]["subparts"], "|").alias("subparts"), name.alias("name"))


def raw_records(spark, sf):
    size = F.col("p_size")
    return S.load(spark, sf, "part").select(
        F.col("p_partkey"), F.when(size == 1, F.lit("ftp://x/y")).when(size == 2, F.concat(F.lit("https://s.example/"), F.repeat(F.lit("a"), 1000))).otherwise(F.concat(F.lit(" HTTPS://Shop.Example/p/"), F.col("p_partkey"))).alias("url"),
        F.when(size == 3, "  ").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")))).alias("name"), F.when(size == 4, "  ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("brand"),
        F.when(size == 5, F.lit(-1.0)).otherwise(F.col("p_retailprice")).alias("price"), (F.col("p_retailprice") + F.pmod("p_partkey", F.lit(3)) - 1).alias("list_price"),
        F.when(size == 6, "EURO").when(size == 7, " eur ").otherwise(F.lit(None)).alias("currency"), F.when(size == 8, 0).otherwise(size).alias("rank"), F.lit(None).cast("string").alias("image_url"))


@query("valid_records", """
SELECT p_partkey, 'https://shop.example/p/' || p_partkey AS url, p_name AS name, CASE WHEN p_size <> 4 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 2 THEN round(p_retailprice + 1, 2) END AS list_price,
  CASE WHEN p_size = 7 THEN 'EUR' END AS currency FROM part WHERE p_size NOT IN (1, 2, 3, 5, 6, 8)""")
def valid_records(spark, sf):
    rows = P.valid(P.checked(raw_records(spark, sf)))
    return rows.select("p_partkey", "url", "name", "brand", F.round("list_price", 2).alias("list_price"), "currency")


@query("record_errors", """
SELECT CASE WHEN p_size <= 2 THEN 'url: invalid or too long' WHEN p_size = 3 THEN 'name: empty' WHEN p_size = 5 THEN 'price: negative' WHEN p_size = 6 THEN 'currency: not a 3-letter code' ELSE 'rank: below 1' END AS reason,
  count(*) AS records FROM part WHERE p_size IN (1, 2, 3, 5, 6, 8) GROUP BY 1""")
def record_errors(spark, sf):
    return P.error_counts(P.checked(raw_records(spark, sf)))
