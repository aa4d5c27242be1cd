"""Products from markup: schema.org JSON-LD, catalog JSON, family JSON, try-on and analytics scripts.

A page is one row; everything is found inside the row with VARIANT values and array functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.numbers import number_from_text
from shelfwave.functions.text import blank_to_null, collapse, let, strip_tags
from shelfwave.functions.urls import absolute, canonical

# Price types of a priceSpecification that are not the selling price.
LIST_PRICE_TYPES = ("listprice", "strikethroughprice", "msrp", "srp")
# Availability values that mean sold out.
SOLD_OUT = ("outofstock", "soldout", "discontinued")
# The keys that nest further nodes.
NESTING = ("@graph", "itemListElement", "item")
NESTED = "struct<" + ",".join(f"`{key}`:variant" for key in NESTING) + ">"
NODE = "array<struct<path:array<int>,node:variant>>"


def script_bodies(html: Column, attribute: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script\b[^>]*{attribute}[^>]*>(.*?)</script>"), F.lit(1))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _text(v: Column) -> Column:
    """A JSON string's value; NULL for any other kind of value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _as_list(v: Column) -> Column:
    """A JSON list's elements, any other value as a list of one, nothing for null; the value is evaluated once."""
    none = F.array().cast("array<variant>")
    return F.coalesce(let(v, lambda x: F.when(x.isNull() | F.is_variant_null(x), none).otherwise(
        F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x)))), none)


def _is_object(v: Column) -> Column:
    # a cast that asks for no more than a name; schema_of_variant would walk all that is below
    return F.try_variant_get(v, "$", "struct<`@id`:variant>").isNotNull()


def _first(v: Column) -> Column:
    return F.get(_as_list(v), F.lit(0))


def _children(parent: Column) -> Column:
    """The elements of a list, or the values under an object's nesting keys, with their places appended to the path."""
    node, path = parent["node"], parent["path"]
    at = lambda i, v: F.struct(F.concat_ws(",", path, i.cast("string")).alias("path"), v.alias("node"))
    elements = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v, i: at(i, v))
    nested = F.try_variant_get(node, "$", NESTED)  # all keys by one cast, nothing for what is no object
    values = let(nested, lambda o: F.filter(F.array(*[at(F.lit(n), o[key]) for n, key in enumerate(NESTING)]), lambda c: c["node"].isNotNull()))
    return F.coalesce(elements, values)


def _path(text: Column) -> Column:
    return F.split(text, ",").cast("array<int>")


def _walked(html: Column) -> Column:
    """json_ld_nodes with the path as text: an array is copied number by number at every step of the walk.

    Every step down takes one "[" or a nesting key of the text, so their number bounds the steps; steps after the last level do nothing. A key may be
    written with \\u escapes; a text that has any counts all its ":" as keys."""
    bodies = script_bodies(html, r'type="application/ld\+json"')
    without = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    keys = F.lit("\"(?:" + "|".join(NESTING) + ")\"\\s*:")
    count = lambda s: F.when(s.contains("\\u"), without(s, "[:")).otherwise(without(s, "[") + F.regexp_count(s, keys))

    def down(acc: Column, _: Column) -> Column:
        below = lambda level: let(F.flatten(F.transform(level, _children)), lambda n: F.struct(n.alias("level"), F.concat(acc["all"], n).alias("all")))
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(below(acc["level"]))

    def walk(texts: Column) -> Column:
        steps = F.aggregate(texts, F.lit(0), lambda n, s: n + count(s))
        roots = F.transform(texts, lambda s, i: F.struct(i.cast("string").alias("path"), F.try_parse_json(s).alias("node")))
        turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        first = F.filter(roots, lambda r: r["node"].isNotNull())
        return let(first, lambda f: F.aggregate(turns, F.struct(f.alias("level"), f.alias("all")), down)["all"])

    return F.filter(let(bodies, walk), lambda n: _is_object(n["node"]))


def json_ld_nodes(html: Column) -> Column:
    """Every JSON-LD node of a page with its path in reading order; nested graphs, item lists and lists in lists are followed to any depth. Scripts
    that are not JSON are skipped."""
    return F.transform(_walked(html), lambda n: F.struct(_path(n["path"]).alias("path"), n["node"].alias("node")))


def _types(node: Column) -> Column:
    return F.transform(_as_list(_get(node, "@type")), lambda t: _text(t))


def resolve(value: Column, nodes: Column) -> Column:
    """A bare {"@id": ...} reference -> the node of the page it points to; any other value itself."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    target = _text(_get(value, "@id"))
    same = F.filter(nodes, lambda n: (_text(_get(n["node"], "@id")) == target)
                    & (F.size(F.map_keys(F.try_variant_get(n["node"], "$", "map<string,variant>"))) > 1))
    found = F.get(same, F.size(same) - 1)["node"]
    return F.when(_is_object(value) & (F.size(keys) == 1) & target.isNotNull(), F.coalesce(found, value)).otherwise(value)


def json_price(value: Column) -> Column:
    """A price stated as a number or as text with a decimal comma."""
    return F.replace(blank_to_null(F.try_variant_get(value, "$", "string")), F.lit(","), F.lit(".")).try_cast("double")


def _price_spec(specs: Column, listed: bool) -> Column:
    kind = lambda s: F.lower(F.regexp_extract(F.coalesce(F.try_variant_get(_get(s, "priceType"), "$", "string"), F.lit("")), "([^/]*)$", 1))
    priced = lambda s: _is_object(s) & (F.coalesce(F.try_variant_get(_get(s, "price"), "$", "string"), F.lit("")) != "")
    chosen = F.filter(_as_list(specs), lambda s: priced(s) & (kind(s).isin(*LIST_PRICE_TYPES) if listed else ~kind(s).isin(*LIST_PRICE_TYPES)))
    return F.get(chosen, F.lit(0))


def json_ld_products(pages: DataFrame) -> DataFrame:
    """schema.org Product nodes of pages (page_id, url, html) with their fields and raw offers, in reading order (`path`)."""
    # references are resolved while the page is one row, so its nodes do not travel with every product
    product = lambda n, nodes: F.struct(
        _path(n["path"]).alias("path"), n["node"].alias("node"), resolve(_first(_get(n["node"], "brand")), nodes).alias("brand_node"),
        resolve(_first(_get(n["node"], "image")), nodes).alias("image_node"), F.transform(_as_list(_get(n["node"], "offers")), lambda o: resolve(o, nodes)).alias("offers"))
    found = lambda nodes: F.transform(F.filter(nodes, lambda n: F.array_contains(_types(n["node"]), "Product")), lambda n: product(n, nodes))
    rows = (pages.select("page_id", F.col("url").alias("page_url"), F.explode(let(_walked(F.col("html")), found)).alias("n"))
            .select("page_id", "page_url", "n.*"))
    head = F.get("offers", F.lit(0))
    rows = rows.withColumn("offer", F.when(_is_object(head), F.try_variant_get(head, "$", "map<string,variant>")))
    offer = F.col("offer")
    rows = rows.withColumns({
        "current": _price_spec(offer["priceSpecification"], False), "listed": _price_spec(offer["priceSpecification"], True),
        "stated": F.when(F.map_contains_key(offer, "price"), json_price(offer["price"])).otherwise(json_price(offer["lowPrice"])), "own": _text(offer["priceCurrency"]),
        "brand_text": F.coalesce(_text(F.col("brand_node")), _text(_get(F.col("brand_node"), "name"))),
        "image_text": F.coalesce(_text(F.col("image_node")), blank_to_null(_text(_get(F.col("image_node"), "url"))), _text(_get(F.col("image_node"), "contentUrl"))),
        "name_text": _text(_get(F.col("node"), "name")), "url_text": _text(_get(F.col("node"), "url"))})
    price = F.coalesce("stated", json_price(_get(F.col("current"), "price")))
    currency = F.when(F.col("stated").isNotNull(), F.col("own")).otherwise(F.coalesce(blank_to_null(F.col("own")), _text(_get(F.col("current"), "priceCurrency"))))
    clean = lambda c: blank_to_null(F.trim(c))
    return rows.select(
        "page_id", "page_url", "path", clean("name_text").alias("name"), clean("brand_text").alias("brand"), price.alias("price"),
        F.when(price.isNotNull(), json_price(_get(F.col("listed"), "price"))).alias("list_price"), currency.alias("currency"),
        F.when(clean("image_text").isNotNull(), absolute(F.col("page_url"), clean("image_text"))).alias("image_url"),
        F.when(F.col("url_text").isNotNull(), absolute(F.col("page_url"), F.col("url_text"))).alias("url"),
        _text(_get(F.col("node"), "description")).alias("description"), "offers")


def page_product(products: DataFrame) -> DataFrame:
    """The page's own product: the node whose URL is the page's, else the first one."""
    keep = [c for c in products.columns if c != "page_id"]
    order = F.struct((~F.coalesce(F.col("url") == F.col("page_url"), F.lit(False))).alias("other"), F.col("path"))
    return products.groupBy("page_id").agg(F.min_by(F.struct(*keep), order).alias("p")).select("page_id", "p.*")


def offer_variants(offers: Column) -> Column:
    """Variants of an offers list: one per sku, in order; offers without a sku or a name are skipped, prices are not read."""
    sku, name = lambda o: blank_to_null(F.trim(_text(_get(o, "sku")))), lambda o: blank_to_null(collapse(_text(_get(o, "name"))))
    stock = lambda o: F.when(_text(_get(o, "availability")).isNotNull(), ~F.lower(F.regexp_extract(_text(_get(o, "availability")), "([^/]*)$", 1)).isin(*SOLD_OUT))
    made = F.transform(F.filter(offers, lambda o: _is_object(o) & sku(o).isNotNull() & name(o).isNotNull()),
                       lambda o: F.struct(sku(o).alias("code"), name(o).alias("color"), stock(o).alias("in_stock")))
    return first_per_code(made, "array<struct<code:string,color:string,in_stock:boolean>>")


def first_per_code(variants: Column, kind: str) -> Column:
    return F.aggregate(variants, F.array().cast(kind), lambda acc, v: F.when(F.exists(acc, lambda a: a["code"] == v["code"]), acc).otherwise(F.concat(acc, F.array(v))))


# --- catalog JSON ----------------------------------------------------------------------------------

CATALOG = ("array<struct<handle:string,title:string,vendor:string,price:string,body_html:string,tags:array<string>,"
           "variants:array<struct<sku:string,id:string,price:string,available:boolean,title:string,option1:string,option2:string,option3:string>>,"
           "images:array<struct<src:string>>,featured_image:string,options:array<struct<name:string>>>>")
# Shape words accepted from catalog tags, and the tags that set a flag.
SHAPE_TAGS = ("aviator", "oval", "round", "square", "rectangle", "rectangular", "cat eye", "cateye", "geometric", "octagonal")
NEW_TAGS = ("new", "new arrivals")
LIMITED_TAGS = ("limited", "limited edition", "limited editions")
BESTSELLER_TAGS = ("best seller", "best sellers", "bestseller", "bestsellers", "the icons")
COLOR_OPTIONS = ("color", "colour", "couleur")


@dataclass(frozen=True)
class CatalogConfig:
    """What differs between stores: default brand, other names of it, and the material when no tag states one."""
    default_brand: str | None = None
    brand_aliases: tuple[str, ...] = ()
    default_material: str | None = None
    title_materials: dict[str, str] = field(default_factory=dict)  # regex on the lower-case title -> material
    url_regex: str | None = None


def catalog_products(listings: DataFrame, config: CatalogConfig, start_rank: int = 1) -> DataFrame:
    """Listing rows of catalog documents (page_url, payload = {"products": [...]}): one row per product with a handle."""
    products = F.from_json(F.col("payload"), f"struct<products:{CATALOG}>")["products"]
    handled = F.filter(products, lambda p: F.coalesce(p["handle"], F.lit("")) != "")
    rows = listings.select("page_url", F.posexplode(handled).alias("pos", "p"))
    p = F.col("p")
    raw_url = absolute(F.col("page_url"), F.concat(F.lit("/products/"), p["handle"]))
    vendor = F.coalesce(blank_to_null(p["vendor"]), F.lit(config.default_brand).cast("string"))
    if config.default_brand:
        upper, own = F.upper(F.trim(vendor)), config.default_brand.upper()
        vendor = F.when(upper.startswith(own) | upper.isin(*[a.upper() for a in config.brand_aliases] or [own]), F.lit(config.default_brand)).otherwise(vendor)
    variants = F.coalesce(p["variants"], F.array().cast("array<struct<sku:string,id:string,price:string,available:boolean,title:string,option1:string,option2:string,option3:string>>"))
    first_price = blank_to_null(F.get(variants, F.lit(0))["price"])
    own_price = number_from_text(blank_to_null(p["price"]))
    price = F.when(first_price.isNotNull(), first_price.try_cast("double")).otherwise(F.when(own_price > 1000, own_price / 100).otherwise(own_price))
    names = F.transform(F.coalesce(p["options"], F.array().cast("array<struct<name:string>>")), lambda o: F.lower(F.coalesce(o["name"], F.lit(""))))
    place = F.array_position(F.transform(names, lambda n: n.isin(*COLOR_OPTIONS)), True)
    option = lambda v: blank_to_null(F.when(place == 1, v["option1"]).when(place == 2, v["option2"]).when(place == 3, v["option3"]))
    made = F.transform(variants, lambda v: F.struct(
        F.coalesce(blank_to_null(v["sku"]), v["id"], F.lit("")).alias("code"), F.coalesce(option(v), v["title"]).alias("color"),
        F.coalesce(v["available"], F.lit(True)).alias("in_stock")))
    made = F.filter(made, lambda v: (F.coalesce(v["color"], F.lit("")) != "") & (F.lower(v["color"]) != "default title"))
    tags = F.transform(F.coalesce(p["tags"], F.array().cast("array<string>")), lambda t: F.lower(t))
    any_of = lambda words: F.when(F.exists(tags, lambda t: t.isin(*words)), F.lit(True))
    holds = lambda *words: F.exists(tags, lambda t: F.greatest(*[t.contains(w) for w in words]) if len(words) > 1 else t.contains(words[0]))
    fallback = F.lit(config.default_material).cast("string")
    for pattern, material in config.title_materials.items():
        fallback = F.when(F.lower(F.coalesce(p["title"], F.lit(""))).rlike(pattern), F.lit(material)).otherwise(fallback)
    material = F.when(holds("acetate", "combo"), "acetate").when(holds("metal", "titanium"), "metal").otherwise(fallback)
    shaped = F.transform(tags, lambda t: F.when(t.rlike("^shape[-:]"), F.replace(F.substring(t, 7, 1000), F.lit("-"), F.lit(" "))).otherwise(t))
    words = F.filter(shaped, lambda t: t.isin(*SHAPE_TAGS))
    description = blank_to_null(collapse(F.concat_ws(" ", F.trim(strip_tags(p["body_html"])), F.array_join(words, " "))))
    return rows.select(
        canonical(raw_url, config.url_regex).alias("url"), (F.col("pos") + start_rank).cast("long").alias("rank"), blank_to_null(p["title"]).alias("name"),
        vendor.alias("brand"), price.alias("price"), F.coalesce(F.get(p["images"], F.lit(0))["src"], blank_to_null(p["featured_image"])).alias("image_url"),
        F.when(F.size(variants) > 0, ~F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False)))).alias("out_of_stock"),
        F.when(F.size(made) > 0, made).alias("variants"), material.alias("material"), any_of(NEW_TAGS).alias("is_new"), any_of(LIMITED_TAGS).alias("is_limited"),
        any_of(BESTSELLER_TAGS).alias("is_bestseller"), description.alias("description"))


FAMILY = ("struct<id:string,colorCode:string,color:string,isInStock:boolean,name:string,kind:string,price:string,eyewireMaterial:string,description:string,"
          "primaryShape:string,images:struct<front:string,angle:string,baseTransparent:string>,action:struct<cta:struct<route:string>>,tags:array<struct<label:string>>>")
# Material codes of the family catalog.
FAMILY_ACETATE, FAMILY_METAL = ("HB",), ("GD", "SB", "DM")


def family_products(listings: DataFrame, default_brand: str, url_regex: str | None = None, start_rank: int = 1) -> DataFrame:
    """Listing rows of family documents (page_url, payload = {"items": [[variant, ...], ...]}): the first member describes the family,
    every member with a colour is a variant."""
    families = F.from_json(F.col("payload"), f"struct<items:array<array<{FAMILY}>>>")["items"]
    rows = listings.select("page_url", F.posexplode(F.filter(families, lambda f: F.size(f) > 0)).alias("pos", "fam"))
    v0 = F.get("fam", F.lit(0))
    parts = F.filter(F.split(F.coalesce(v0["action"]["cta"]["route"], F.lit("")), "/"), lambda s: (s != "") & (s != "atc"))
    kind = F.when(v0["kind"] == "sunGlasses", "sunglasses").otherwise("eyeglasses")
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(v0["name"], F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.get(parts, F.lit(0))
    path = F.when((F.size(parts) >= 2) & head.isin("eyeglasses", "sunglasses"), F.concat_ws("/", F.lit(""), head, F.get(parts, F.lit(1)))).otherwise(F.concat_ws("/", F.lit(""), kind, slug))
    made = F.transform(F.filter("fam", lambda v: F.coalesce(v["color"], F.lit("")) != ""), lambda v: F.struct(
        F.coalesce(blank_to_null(v["id"]), v["colorCode"], F.lit("")).alias("code"), v["color"].alias("color"), F.coalesce(v["isInStock"], F.lit(True)).alias("in_stock")))
    text, code = F.lower(F.coalesce(v0["description"], F.lit(""))), F.upper(F.coalesce(v0["eyewireMaterial"], F.lit("")))
    material = F.when(code.isin(*FAMILY_ACETATE) | text.contains("acetate"), "acetate").when(
        code.isin(*FAMILY_METAL) | text.contains("titanium") | text.contains("stainless steel"), "metal")
    labels = F.transform(v0["tags"], lambda t: F.lower(F.coalesce(t["label"], F.lit(""))))
    pictures = [blank_to_null(v0["images"][k]) for k in ("front", "angle", "baseTransparent")]
    return rows.select(
        canonical(absolute(F.col("page_url"), path), url_regex).alias("url"), (F.col("pos") + start_rank).cast("long").alias("rank"),
        blank_to_null(v0["name"]).alias("name"), F.lit(default_brand).alias("brand"),
        F.trim(F.replace(v0["price"], F.lit("$"), F.lit(""))).try_cast("double").alias("price"), F.coalesce(*pictures).alias("image_url"),
        F.when(F.size(made) > 0, made).alias("variants"), F.when(F.size(made) > 0, ~F.exists(made, lambda v: v["in_stock"])).alias("out_of_stock"),
        material.alias("material"), blank_to_null(collapse(F.concat_ws(" ", v0["description"], F.lower(v0["primaryShape"])))).alias("description"),
        F.when(F.array_contains(labels, "made in italy"), F.lit("Italy")).alias("made_in"))


# --- widgets ---------------------------------------------------------------------------------------

def alnum(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, "[^0-9A-Za-z]", ""))


def try_on_layers(html: Column) -> Column:
    """Acetate layers per variant code from a try-on widget's JSON: map from the code's letters and digits to its layers; the first
    mention of a code wins."""
    kind = "struct<frames:array<struct<variants:array<struct<variantLabel:string,sizes:array<struct<frameId:string>>>>>>>"
    frames = F.flatten(F.transform(script_bodies(html, "data-vto-carousel"), lambda s: F.coalesce(F.from_json(s, kind)["frames"], F.from_json(F.lit("[]"), "array<struct<variants:array<struct<variantLabel:string,sizes:array<struct<frameId:string>>>>>>"))))
    variants = F.filter(F.flatten(F.transform(frames, lambda f: F.coalesce(f["variants"], F.from_json(F.lit("[]"), "array<struct<variantLabel:string,sizes:array<struct<frameId:string>>>>")))), lambda v: v["variantLabel"].isNotNull())

    def entries(v: Column) -> Column:
        layers = F.filter(F.transform(F.split(v["variantLabel"], "/"), lambda x: F.trim(x)), lambda x: x != "")
        ids = F.filter(F.transform(v["sizes"], lambda s: F.regexp_extract(s["frameId"], r"(\S+)\s*$", 1)), lambda x: x != "")
        return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.struct(alnum(i).alias("code"), layers.alias("layers")))

    return F.map_from_entries(first_per_code(F.flatten(F.transform(variants, entries)), "array<struct<code:string,layers:array<string>>>"))


def analytics_titles(html: Column) -> Column:
    """Variant id -> title from a storefront's analytics metadata; empty when the block is missing or malformed. The last of two
    equal ids wins."""
    block = F.get(F.regexp_extract_all(html, F.lit(r"(?s)\bvar meta\s*=\s*(\{.*?\});"), F.lit(1)), F.lit(0))
    kind = "struct<product:struct<variants:array<struct<id:string,public_title:string>>>>"
    usable = F.filter(F.from_json(block, kind)["product"]["variants"], lambda v: v["id"].isNotNull() & (v["id"] != "") & v["public_title"].isNotNull())
    last = first_per_code(F.transform(F.reverse(usable), lambda v: F.struct(v["id"].alias("code"), v["public_title"].alias("title"))), "array<struct<code:string,title:string>>")
    return F.coalesce(F.map_from_entries(F.reverse(last)), F.from_json(F.lit("{}"), "map<string,string>"))


def with_layers(variants: Column, layers: Column) -> Column:
    """Variants with the layers known for their code; a single layer says nothing beyond the label."""
    return F.transform(variants, lambda v: let(layers[alnum(v["code"])], lambda ls: F.when(F.size(ls) >= 2, v.withField("layers", ls)).otherwise(v)))


def with_ids(variants: Column, titles: Column, code_regex: str | None = None) -> Column:
    """Variants with the id of the analytics title that states their code (the whole title without a regex)."""
    code = lambda t: F.trim(F.regexp_extract(t, code_regex, 1)) if code_regex else F.trim(t)
    entries = F.map_entries(titles)
    return F.transform(variants, lambda v: let(F.filter(entries, lambda e: code(e["value"]) == v["code"]), lambda hits: F.when(
        v["id"].isNull() & (F.size(hits) > 0), v.withField("id", F.get(hits, F.lit(0))["key"])).otherwise(v)))
