"""The shelf: active products by attribute, prices, markdowns against the store's usual sale, vocabulary coverage.

Tags become one profile per product; a product meets its profile once and is expanded to every cell it counts in, for all shelves, dimensions,
attributes and its store. One aggregate with partial sums holds all figures; store baselines meet that aggregate, never the products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfwave.functions.numbers import ratio, rounded
from shelfwave.functions.text import fold, let
from shelfwave.operators.joins import bounded, placed
from shelfwave.rules import DEFAULT_RULES, Rules

ALL = "all"
# Folded spec labels and the dimension (or dimensions) their values speak about.
SPEC_DIMENSIONS: dict[str, tuple[str, ...]] = {
    "materials": ("material",),
    "material": ("material",),
    "matiere": ("material",),
    "matieres": ("material",),
    "materiau": ("material",),
    "materiaux": ("material",),
    "matiere du cadre": ("material",),
    "front material": ("material",),
    "temple material": ("material",),
    "matiere face": ("material",),
    "matiere branches": ("material",),
    "matiere des branches": ("material",),
    "materiau du cadre": ("material",),
    "matiere de la monture": ("material",),
    "materiau de la monture": ("material",),
    "gender": ("audience",),
    "genre": ("audience",),
    "sexe": ("audience",),
    "le sexe": ("audience",),
    "color": ("color",),
    "colour": ("color",),
    "couleur": ("color",),
    "coloris": ("color",),
    "forme": ("shape",),
    "shape": ("shape",),
    "build": ("shape",),
    "forme lunette": ("shape",),
    "forme de lunette": ("shape",),
    "forme monture": ("shape",),
    "forme de la monture": ("shape",),
    "front type": ("shape",),
    "style": ("style", "audience"),
}


def store_names(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("id").alias("source_id"), F.col("name").alias("store"), "country")


def active_products(products: DataFrame, sources: DataFrame, country: str | None = None) -> DataFrame:
    """Products on their store's shelf with the store's name and country; optionally one market only. One store may hold a large
    part of all products, so the stores are broadcast when their count allows it."""
    stores = store_names(sources)
    if country is not None:
        stores = stores.where(F.col("country") == country)
    return products.where("is_active").join(bounded(stores), "source_id")


def is_creator(country: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """A brand's own catalog: a country is stated and it is not the market's."""
    return (F.coalesce(country, F.lit("")) != "") & (country != rules.market_country)


def of_type(products: DataFrame, tags: DataFrame, product_type: str) -> DataFrame:
    return with_attribute(products, tags, "product_type", product_type)


def with_attribute(products: DataFrame, tags: DataFrame, dimension: str, code: str) -> DataFrame:
    """Products carrying one attribute, each once."""
    ids = tags.where((F.col("dimension") == dimension) & (F.col("code") == code)).select(F.col("product_id").alias("id"))
    return products.join(ids, "id", "left_semi")


def markdown() -> Column:
    """1 - price / list price when both are stated, non-zero and the list price is higher; else 0."""
    price, listed = F.col("price"), F.col("list_price")
    return F.when((price != 0) & (listed != 0) & (listed > price), 1 - price / listed).otherwise(F.lit(0.0))


def store_baselines(active: DataFrame) -> DataFrame:
    """(source_id, baseline): mean markdown of all active products, for stores that publish any list price."""
    return (active.groupBy("source_id")
            .agg(F.avg(markdown()).alias("baseline"), F.coalesce(F.bool_or(F.col("list_price") != 0), F.lit(False)).alias("lists"))
            .where("lists").select("source_id", "baseline"))


def markdown_sums() -> list[Column]:
    """Partial sums of the markdown figures, for any grouping that includes source_id."""
    md = F.col("md")
    return [F.count(F.lit(1)).alias("n"), F.sum(md).alias("md_sum"), F.count_if(md > 0).alias("n_cut"),
            F.sum(F.when(md > 0, md)).alias("cut_sum")]


def markdown_stats(partial: DataFrame, baselines: DataFrame, by: list[str]) -> DataFrame:
    """Roll partial sums up to `by`: compared, discounted, share_discounted, avg_depth, relative_depth. Stores without list
    prices are left out, so a group found only there has no row."""
    rows = partial.join(baselines, "source_id").groupBy(*by).agg(
        F.sum("n").alias("compared"), F.sum("n_cut").alias("discounted"), F.sum("cut_sum").alias("cut_sum"),
        F.sum(F.col("md_sum") - F.col("n") * F.col("baseline")).alias("excess"))
    return rows.select(
        *by, "compared", "discounted", rounded(ratio(F.col("discounted"), F.col("compared")), 4).alias("share_discounted"),
        F.when(F.col("discounted") > 0, rounded(F.col("cut_sum") / F.col("discounted"), 4)).alias("avg_depth"),
        rounded(F.col("excess") / F.col("compared"), 4).alias("relative_depth"))


def attribute_markdown(products: DataFrame, tags: DataFrame, sources: DataFrame, dimension: str, code: str) -> DataFrame:
    """Markdown of the active products carrying one attribute; no row when no store with list prices carries it."""
    active = active_products(products, sources)
    rows = with_attribute(active, tags, dimension, code).withColumn("md", markdown())
    partial = rows.groupBy("source_id").agg(*markdown_sums()).withColumn("dimension", F.lit(dimension)).withColumn("code", F.lit(code))
    return markdown_stats(partial, store_baselines(active), ["dimension", "code"])


def stated_dimensions(raw_specs: Column, labels: dict[str, tuple[str, ...]] = SPEC_DIMENSIONS) -> Column:
    """Distinct dimensions a product's spec labels speak about."""
    table = F.create_map(*[x for k, dims in labels.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in dims]))])
    found = F.transform(F.map_keys(raw_specs), lambda k: F.coalesce(table[fold(k)], F.array().cast("array<string>")))
    return F.coalesce(F.array_distinct(F.flatten(found)), F.array().cast("array<string>"))


def distinct_attributes(tags: DataFrame, *dimensions: str) -> DataFrame:
    """(id, dimension, code) of each product, supplier codes folded away. Placed by product once: the duplicate removal, the
    per-product flags and the join with products all reuse that exchange, and all of them are hash operators."""
    rows = tags.where(F.col("dimension").isin(*dimensions)) if dimensions else tags
    return placed(rows.select(F.col("product_id").alias("id"), "dimension", "code"), "id").distinct()


def product_profiles(tags: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(id, attributes): each tagged product's distinct (dimension, code) of the tracked dimensions and its product types. Supplier codes fold away before the shuffle."""
    rows = tags.where(F.col("dimension").isin(*rules.dimensions, "product_type"))
    return rows.groupBy(F.col("product_id").alias("id")).agg(F.collect_set(F.struct("dimension", "code")).alias("attributes"))


STORE, WHOLE, UNIT, ITEM = 0, 1, 2, 3  # what a cell counts: a store's products, a shelf's, a dimension of a shelf, an attribute of a shelf


def shelf_cells(active: DataFrame, tags: DataFrame, by_type: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(source_id, kind, shelf, dimension, code, currency) with partial sums: every figure of the shelf comes from this one aggregate.

    A product meets its profile once and is expanded to all cells it counts in; products and tags are read once."""
    attributes = F.coalesce("attributes", F.array().cast("array<struct<dimension:string,code:string>>"))
    tracked = F.filter(attributes, lambda a: a["dimension"].isin(*rules.dimensions))
    typed = F.transform(F.filter(attributes, lambda a: (a["dimension"] == "product_type") & a["code"].isin(*rules.product_types)), lambda a: a["code"])
    none, no = F.lit(None).cast("string"), F.lit(False)

    def cell(kind: int, shelf: Column, dimension: Column, code: Column, tagged: Column = no, stated: Column = no) -> Column:
        return F.struct(F.lit(kind).alias("kind"), shelf.alias("shelf"), dimension.alias("dimension"), code.alias("code"), tagged.alias("tagged"), stated.alias("stated"))

    def of(shelf: Column) -> Column:
        unit = lambda d: cell(UNIT, shelf, F.lit(d), none, F.array_contains("tagged", d), F.array_contains("stated", d))
        return F.concat(F.array(cell(WHOLE, shelf, none, none), *[unit(d) for d in rules.dimensions]),
                        F.transform("tracked", lambda a: cell(ITEM, shelf, a["dimension"], a["code"])))

    priced = F.when((F.col("price") > 0) & (F.col("currency") != ""), F.col("currency"))
    profiles = active.join(product_profiles(tags, rules), "id", "left").select(
        "source_id", "price", "list_price", priced.alias("currency"), markdown().alias("md"), stated_dimensions(F.col("flags.raw_specs")).alias("stated"),
        tracked.alias("tracked"), F.transform(tracked, lambda a: a["dimension"]).alias("tagged"), (typed if by_type else F.array(F.lit(ALL))).alias("shelves"))
    cells = F.concat(F.array(cell(STORE, none, none, none)), F.flatten(F.transform("shelves", of)))
    md, listed = F.col("md"), F.coalesce(F.col("list_price") != 0, no)
    return (profiles.select("source_id", "price", "currency", "md", listed.alias("listed"), F.explode(cells).alias("c")).select("*", "c.*")
            .groupBy("source_id", "kind", "shelf", "dimension", "code", F.when(F.col("kind") == ITEM, F.col("currency")).alias("currency"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("currency").isNotNull(), F.col("price"))).alias("price_sum"), F.sum(md).alias("md_sum"),
                 F.count_if(md > 0).alias("n_cut"), F.sum(F.when(md > 0, md)).alias("cut_sum"), F.bool_or("listed").alias("listed"),
                 F.count_if("tagged").alias("tagged"), F.count_if("stated").alias("with_value"), F.count_if(F.col("stated") & ~F.col("tagged")).alias("unmapped")))


def shelf_table(cells: DataFrame) -> DataFrame:
    """(shelf, dimension): products (on the row without a dimension), tagged, with_value, unmapped and `cells`, the sums of each (code, currency).

    The usual markdown of a store, for stores that publish any list price, meets the store's cells; a store has at most some cells for each attribute."""
    store, of_store = F.col("kind") == STORE, Window.partitionBy("source_id")
    total = lambda c: F.sum(F.when(store, F.col(c))).over(of_store)
    baseline = F.when(F.max(F.when(store, F.col("listed"))).over(of_store), total("md_sum") / total("n"))
    rows = cells.withColumn("baseline", baseline).where(~store)
    compared = F.col("baseline").isNotNull()
    sums = rows.groupBy("kind", "shelf", "dimension", "code", "currency").agg(
        F.sum("n").alias("n"), F.sum("price_sum").alias("price_sum"), F.sum(F.when(compared, F.col("n"))).alias("compared"), F.sum(F.when(compared, F.col("n_cut"))).alias("discounted"),
        F.sum(F.when(compared, F.col("cut_sum"))).alias("cut_sum"), F.sum(F.col("md_sum") - F.col("n") * F.col("baseline")).alias("excess"),
        *[F.sum(c).alias(c) for c in ("tagged", "with_value", "unmapped")])
    item = F.when(F.col("kind") == ITEM, F.struct("code", "currency", "n", "price_sum", "compared", "discounted", "cut_sum", "excess"))
    units = lambda c: F.sum(F.when(F.col("kind") == UNIT, F.col(c))).alias(c)
    return sums.groupBy("shelf", "dimension").agg(F.sum(F.when(F.col("kind") == WHOLE, F.col("n"))).alias("products"), units("tagged"), units("with_value"), units("unmapped"),
                                                  F.collect_list(item).alias("cells"))


def _figures(sku: Column, tagged: Column, compared: Column, discounted: Column, cut_sum: Column, excess: Column) -> list[Column]:
    return [ratio(sku, tagged).alias("share"), compared.alias("compared"), discounted.alias("discounted"), rounded(ratio(discounted, compared), 4).alias("share_discounted"),
            F.when(discounted > 0, rounded(cut_sum / discounted, 4)).alias("avg_depth"), rounded(excess / compared, 4).alias("relative_depth")]


def shelf_items(shelf: DataFrame) -> DataFrame:
    """(shelf, dimension, code): distinct products, share of the dimension's tagged products and markdown figures."""
    by = ["shelf", "dimension", "code"]
    names = ("compared", "discounted", "cut_sum", "excess")
    rows = shelf.select("shelf", "dimension", "tagged", F.inline("cells")).groupBy(*by, "tagged").agg(F.sum("n").alias("sku"), *[F.sum(c).alias(c) for c in names])
    return rows.select(*by, "sku", "tagged", *_figures(F.col("sku"), F.col("tagged"), *map(F.col, names)))


def item_figures(shelf_row_cells: Column, tagged: Column, code: Column) -> Column:
    """The figures of one attribute within a row of the shelf table, as a struct; NULL when no product carries it."""
    own = F.filter(shelf_row_cells, lambda c: c["code"] == code)

    def total(cells: Column, name: str) -> Column:
        known = F.filter(F.transform(cells, lambda c: c[name].cast("double")), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))

    return let(own, lambda cells: F.when(F.size(cells) > 0, F.struct(total(cells, "n").cast("long").alias("sku"), *_figures(
        total(cells, "n"), tagged, *[total(cells, c) for c in ("compared", "discounted", "cut_sum", "excess")]))))


def shelf_prices(shelf: DataFrame) -> DataFrame:
    """(shelf, dimension, code, currency): mean price of the products with a positive price and a currency."""
    return (shelf.select("shelf", "dimension", F.inline("cells")).where(F.col("currency").isNotNull())
            .select("shelf", "dimension", "code", "currency", F.col("n").alias("priced"), rounded(F.col("price_sum") / F.col("n"), 2).alias("avg_price")))


def comparable(tagged: Column, with_value: Column, unmapped: Column, rules: Rules = DEFAULT_RULES) -> tuple[Column, Column]:
    """(share of stated values not recognised, whether a dimension's figures can be compared)."""
    share = F.coalesce(ratio(unmapped, with_value), F.lit(0.0))
    return share, (tagged >= rules.min_tagged) & (share <= rules.max_unmapped)


def shelf_grid(spark: SparkSession, by_type: bool, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Every (shelf, dimension) pair, so that a shelf without data shows up as not comparable."""
    shelves = rules.product_types if by_type else (ALL,)
    return spark.createDataFrame([(s, d) for s in shelves for d in rules.dimensions], "shelf string, dimension string")


def shelf_dimensions(shelf: DataFrame, by_type: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(shelf, dimension): tagged products, products stating a value, stated values not recognised, and whether the figures can
    be compared at all."""
    seen = shelf.where(F.col("dimension").isNotNull()).select("shelf", "dimension", "tagged", "with_value", "unmapped")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    rows = shelf_grid(shelf.sparkSession, by_type, rules).join(seen, ["shelf", "dimension"], "left").select(
        "shelf", "dimension", zero("tagged"), zero("with_value"), zero("unmapped"))
    unmapped, good = comparable(F.col("tagged"), F.col("with_value"), F.col("unmapped"), rules)
    return rows.withColumn("unmapped_share", unmapped).withColumn("comparable", good)


def shelf_counts(shelf: DataFrame) -> DataFrame:
    """Products per shelf."""
    return shelf.where(F.col("dimension").isNull()).select("shelf", "products")


def store_summary(active: DataFrame) -> DataFrame:
    """(store, products, updated) of the shelf, by name."""
    return active.groupBy("store").agg(F.count(F.lit(1)).alias("products"), F.max("seen_at").alias("updated")).orderBy("store")


def shelf(products: DataFrame, tags: DataFrame, sources: DataFrame, by_type: bool = False, country: str | None = "market",
          rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The market's shelf table, or that of every store with country=None; baselines are store-wide whatever the shelf."""
    active = active_products(products, sources, rules.market_country if country == "market" else country)
    return shelf_table(shelf_cells(active, tags, by_type, rules))


def tag_counts(tags: DataFrame, approximate: bool = False) -> DataFrame:
    """Tagged products per dimension, largest first."""
    n = F.approx_count_distinct("product_id") if approximate else F.count_distinct("product_id")
    return tags.groupBy("dimension").agg(n.alias("products")).orderBy(F.desc("products"), "dimension")
