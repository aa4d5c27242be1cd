"""Press signal against shelf: opportunities and stock risks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from shelfwave.operators.shelf import ALL, comparable, item_figures, shelf
from shelfwave.rules import DEFAULT_RULES, Rules


def shelf_gaps(snapshots: DataFrame, shelf: DataFrame, week: date, by_type: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per gap of a shelf table: kind is opportunity (rising or peaking and rare on the shelf) or risk (declining, and well stocked or
    being cleared deeper than its stores' usual sale). Only comparable dimensions take part; attributes that exist on
    sunglasses only are no gap of the optical shelf."""
    shelves = rules.product_types if by_type else (ALL,)
    rows = (snapshots.where(F.col("week") == F.lit(week)).select("dimension", "code", "status", "momentum")
            .withColumn("shelf", F.explode(F.array(*[F.lit(s) for s in shelves]))))
    sun_only = F.lit(False)
    for dimension, code in rules.sun_only:
        sun_only = sun_only | ((F.col("dimension") == dimension) & (F.col("code") == code))
    good = shelf.where(F.col("dimension").isNotNull() & comparable(F.col("tagged"), F.col("with_value"), F.col("unmapped"), rules)[1])
    rows = (rows.where(~((F.col("shelf") == "optical") & sun_only)).join(good.select("shelf", "dimension", "tagged", "cells"), ["shelf", "dimension"])
            .withColumn("item", item_figures(F.col("cells"), F.col("tagged"), F.col("code"))).drop("cells"))
    clearance = F.coalesce(F.col("item.relative_depth") >= rules.clearance, F.lit(False))
    share = F.coalesce("item.share", F.lit(0.0))
    kind = (F.when(F.col("status").isin("en_hausse", "au_pic") & (share < rules.opportunity_share), "opportunity")
            .when((F.col("status") == "en_baisse") & ((share >= rules.risk_share) | clearance), "risk"))
    return rows.select("shelf", "dimension", "code", kind.alias("kind"), "status", "momentum",
                       F.coalesce("item.sku", F.lit(0)).alias("sku"), share.alias("share"), F.col("item.relative_depth").alias("relative_depth"),
                       clearance.alias("clearance")).where(F.col("kind").isNotNull())


def ranked(gaps: DataFrame) -> DataFrame:
    """Opportunities by momentum, risks by share, strongest first."""
    weight = F.when(F.col("kind") == "opportunity", F.col("momentum")).otherwise(F.col("share"))
    return gaps.orderBy("kind", F.desc(weight), "dimension", "code", "shelf")


def skipped_dimensions(dimensions: DataFrame) -> DataFrame:
    return dimensions.where(~F.col("comparable")).select("shelf", "dimension", "tagged", "unmapped_share")


def gaps_by_type(snapshots: DataFrame, products: DataFrame, tags: DataFrame, sources: DataFrame, week: date,
                 rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Gaps of the optical and the sunglasses shelf in one pass, markdown baselines staying store-wide."""
    return shelf_gaps(snapshots, shelf(products, tags, sources, by_type=True, rules=rules), week, True, rules)


def with_labels(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Label and colour of each attribute; a code the dictionary does not know keeps NULLs (see `unknown_codes`)."""
    return rows.join(dictionary.select("dimension", "code", "label", "hex", "multicolor"), ["dimension", "code"], "left")


def unknown_codes(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    return rows.select("dimension", "code").distinct().join(dictionary, ["dimension", "code"], "left_anti")


def grouped_by_attribute(gaps: DataFrame) -> DataFrame:
    """One row per kind and attribute: the shelves it is a gap on (at most one per product type) and whether it is absent from
    all of them, when there are several."""
    return gaps.groupBy("kind", "dimension", "code").agg(
        F.array_sort(F.collect_list("shelf")).alias("shelves"), F.max("momentum").alias("momentum"),
        ((F.count(F.lit(1)) > 1) & F.every(F.col("sku") == 0)).alias("absent_everywhere"))
