"""Retail presence of attributes: counts, prices and a small sample."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.dates import instant
from shelfwave.functions.numbers import ratio, rounded
from shelfwave.operators.catalog import baselines, is_new
from shelfwave.operators.joins import bounded
from shelfwave.operators.pairings import listing_order
from shelfwave.operators.shelf import active_products, distinct_attributes, markdown, store_baselines, store_names, with_attribute
from shelfwave.rules import DEFAULT_RULES, Rules

BY = ["dimension", "code"]


def presence_rows(products: DataFrame, tags: DataFrame, sources: DataFrame, crawls: DataFrame, now: datetime,
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per (attribute, product on the shelf or lately retired), with the flags the header counts."""
    since = now - timedelta(days=rules.new_days)
    gone = ~F.col("is_active") & (F.col("dropped_at") >= instant(since))
    rows = (products.where(F.col("is_active") | gone).join(bounded(store_names(sources).join(baselines(crawls), "source_id", "left"), measured=sources), "source_id")
            .where(F.col("is_active") | F.col("start").isNotNull())
            .select("id", "source_id", "store", "country", "is_active", "price", "currency", "seen_at", markdown().alias("md"),
                    is_new(now, rules).alias("fresh"), F.coalesce("flags.is_bestseller", F.lit(False)).alias("best")))
    attributes = distinct_attributes(tags)
    kind = F.col("dimension") == "product_type"
    types = attributes.groupBy("id").agg(F.bool_or(kind & (F.col("code") == "optical")).alias("optical"),
                                         F.bool_or(kind & (F.col("code") == "sun")).alias("sun"))
    return rows.join(attributes.where(~kind).join(types, "id"), "id")


def presence_cells(rows: DataFrame) -> DataFrame:
    """The one heavy aggregate: (attribute, store, currency)."""
    on = F.col("is_active")
    priced = on & (F.col("price") > 0) & (F.col("currency") != "")
    currency = F.when(priced, F.col("currency"))
    md = F.when(on, F.col("md"))
    return rows.groupBy(*BY, "source_id", "store", "country", currency.alias("currency")).agg(
        F.count_if(on).alias("n"), F.count_if(~on).alias("retired"), F.count_if(on & F.col("best")).alias("bestsellers"),
        F.count_if(on & F.col("fresh")).alias("new"), F.count_if(on & F.col("optical")).alias("optical"),
        F.count_if(on & F.col("sun")).alias("sun"), F.max(F.when(on, F.col("seen_at"))).alias("updated"),
        F.sum(F.when(priced, F.col("price"))).alias("price_sum"), F.min(F.when(priced, F.col("price"))).alias("price_min"),
        F.max(F.when(priced, F.col("price"))).alias("price_max"), F.coalesce(F.sum(md), F.lit(0.0)).alias("md_sum"),
        F.count_if(md > 0).alias("n_cut"), F.sum(F.when(md > 0, md)).alias("cut_sum"))


def presence_header(cells: DataFrame, store_markdowns: DataFrame) -> DataFrame:
    """Per attribute: products, stores, best-sellers, new, retired, markets, shelves, newest observation and markdown. The store
    baselines join the aggregate, so the products are read once."""
    on, compared = F.col("n") > 0, F.col("baseline").isNotNull()
    rows = cells.join(store_markdowns, "source_id", "left").groupBy(*BY).agg(
        F.sum("n").alias("sku"), F.count_distinct(F.when(on, F.col("store"))).alias("stores"), F.sum("bestsellers").alias("bestsellers"),
        F.sum("new").alias("new"), F.sum("retired").alias("retired"),
        F.array_sort(F.collect_set(F.when(on, F.col("country")))).alias("countries"), F.sum("optical").alias("optical"),
        F.sum("sun").alias("sun"), F.max("updated").alias("updated"), F.nullif(F.sum(F.when(compared, F.col("n"))), F.lit(0)).alias("compared"),
        F.sum(F.when(compared, F.col("n_cut"))).alias("discounted"), F.sum(F.when(compared, F.col("cut_sum"))).alias("cut_sum"),
        F.sum(F.col("md_sum") - F.col("n") * F.col("baseline")).alias("excess"))
    return rows.select(
        *BY, "sku", "stores", "bestsellers", "new", "retired", "countries", "optical", "sun", "updated", "compared",
        F.when(F.col("compared").isNotNull(), F.col("discounted")).alias("discounted"),
        rounded(ratio(F.col("discounted"), F.col("compared")), 4).alias("share_discounted"),
        F.when(F.col("discounted") > 0, rounded(F.col("cut_sum") / F.col("discounted"), 4)).alias("avg_depth"),
        rounded(F.col("excess") / F.col("compared"), 4).alias("relative_depth"))


def presence_prices(cells: DataFrame) -> DataFrame:
    """Per attribute and currency, most priced products first: mean, lowest, highest, number."""
    return (cells.where(F.col("currency").isNotNull()).groupBy(*BY, "currency")
            .agg(F.sum("n").alias("priced"), F.sum("price_sum").alias("s"), F.min("price_min").alias("min"), F.max("price_max").alias("max"))
            .select(*BY, "currency", "priced", rounded(F.col("s") / F.col("priced"), 2).alias("avg"), "min", "max")
            .orderBy(*BY, F.desc("priced"), "currency"))


def presence(products: DataFrame, tags: DataFrame, sources: DataFrame, crawls: DataFrame, now: datetime,
             rules: Rules = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """(header, prices) of every attribute in one pass."""
    cells = presence_cells(presence_rows(products, tags, sources, crawls, now, rules))
    return presence_header(cells, store_baselines(active_products(products, sources))), presence_prices(cells)


def _store_order() -> list[Column]:
    return [F.col("out"), ~F.col("best"), ~F.col("fresh"), F.col("place"), F.col("name"), F.col("id")]


def presence_sample(products: DataFrame, tags: DataFrame, sources: DataFrame, crawls: DataFrame, dimension: str, code: str,
                    now: datetime, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A few products of one attribute, round-robin over the stores (in stock, best-sellers and new arrivals first). When fewer
    than `new_slots` of them are new, the last slots go to in-stock new arrivals not shown yet.

    Both candidate lists are top-k per store or overall, cut before the shuffle; only those few rows meet at the end."""
    size, slots = rules.sample_size, rules.new_slots
    rows = (with_attribute(active_products(products, sources), tags, dimension, code)
            .join(bounded(baselines(crawls)), "source_id", "left")
            .select("id", "store", "name", "brand", "price", "currency", "url", listing_order().alias("place"),
                    F.coalesce("flags.out_of_stock", F.lit(False)).alias("out"), F.coalesce("flags.is_bestseller", F.lit(False)).alias("best"),
                    is_new(now, rules).alias("fresh")))
    turn = F.row_number().over(Window.partitionBy("store").orderBy(*_store_order()))
    first = rows.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", "store").limit(size)
    arrivals = rows.where(F.col("fresh") & ~F.col("out")).orderBy("store", *_store_order()).limit(size + slots)
    # from here on at most 2 * size + slots rows
    shown = first.withColumn("slot", F.row_number().over(Window.orderBy("turn", "store"))).drop("turn")
    missing = F.lit(slots) - shown.select(F.count_if("fresh").alias("n")).scalar()
    extra = (arrivals.join(shown.select("id"), "id", "left_anti")
             .withColumn("e", F.row_number().over(Window.orderBy("store", *_store_order()))).where(F.col("e") <= missing))
    n_extra = extra.select(F.count(F.lit(1)).alias("n")).scalar()
    head = shown.where(F.col("slot") <= F.lit(size) - n_extra)
    n_head = head.select(F.count(F.lit(1)).alias("n")).scalar()
    tail = extra.withColumn("slot", F.col("e") + n_head).drop("e")
    return head.unionByName(tail).orderBy("slot")
