"""Colour pairings from combination codes such as "blue+tortoiseshell"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.numbers import ratio
from shelfwave.operators.shelf import active_products, distinct_attributes
from shelfwave.rules import DEFAULT_RULES, Rules


def listing_order() -> Column:
    """A store's own order; a missing or zero rank goes last."""
    return F.when(F.col("rank").isNull() | (F.col("rank") == 0), F.lit(10 ** 9)).otherwise(F.col("rank"))


def pairing_rows(products: DataFrame, tags: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """One row per (product, colour, partner); partner is NULL on the row that counts the colour's own frame. A code is at
    most 40 characters, so the partners written out of one row are few."""
    layers = F.array_distinct(F.split("code", r"\+"))
    partners = F.flatten(F.transform(layers, lambda a: F.transform(
        F.array_append(F.filter(layers, lambda b: b != a), F.lit(None)), lambda b: F.struct(a.alias("color"), b.alias("partner")))))
    combos = (distinct_attributes(tags, "lamination").select("id", F.explode(partners).alias("p"))
              .select("id", "p.color", "p.partner").distinct())
    active = active_products(products, sources).select(
        "id", "store", "name", "url", listing_order().alias("place"), F.coalesce("flags.is_bestseller", F.lit(False)).alias("best"))
    codes = known.select(F.col("code").alias("partner")).distinct().withColumn("known", F.lit(True))
    rows = active.join(combos, "id").join(codes, "partner", "left")
    return rows.where(F.col("partner").isNull() | F.col("known")).drop("known")


def pairing_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("color", "partner").agg(F.count(F.lit(1)).alias("frames"), F.count_if("best").alias("bestsellers"))


def pairing_examples(rows: DataFrame, size: int = 2) -> DataFrame:
    """Up to `size` best-sellers of each pair, by the store's rank then name; the limit is applied before the shuffle."""
    w = Window.partitionBy("color", "partner").orderBy("place", "name", "url")
    return (rows.where("best").withColumn("n", F.row_number().over(w)).where(F.col("n") <= size)
            .select("color", "partner", "n", "name", "url", "store"))


def all_pairings(rows: DataFrame, limit: int = DEFAULT_RULES.pairing_limit) -> DataFrame:
    """Partners of every colour, the first `limit` by frames, best-sellers and code, with their share of the colour's
    frames and their best-seller rate."""
    counts = pairing_counts(rows)
    own = counts.where(F.col("partner").isNull()).select("color", F.col("frames").alias("color_frames"))
    w = Window.partitionBy("color").orderBy(F.desc("frames"), F.desc("bestsellers"), "partner")
    return (counts.where(F.col("partner").isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
            .join(own, "color")
            .select("color", "partner", "place", "frames", "bestsellers", ratio(F.col("frames"), F.col("color_frames")).alias("share"),
                    ratio(F.col("bestsellers"), F.col("frames")).alias("bestseller_rate")))


def color_pairings(rows: DataFrame, color: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    return all_pairings(rows.where(F.col("color") == color), rules.pairing_limit)


def color_stores(rows: DataFrame) -> DataFrame:
    """Stores that carry each colour in a combination."""
    return rows.where(F.col("partner").isNull()).select("color", "store").distinct()
