"""Plans several registered queries start from."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwave.operators import mentions as M, scoring, series
from shelfwave.sources import samples as S

WEEK = date(2001, 9, 24)
WEEKS = 12
START = date(2001, 7, 9)


def kinds(spark: SparkSession, sf: str) -> DataFrame:
    return M.mention_kinds(S.mentions(spark, sf), S.documents(spark, sf), S.sources(spark, sf))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return M.enrich(S.mentions(spark, sf), S.documents(spark, sf), S.sources(spark, sf))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return series.weekly_counts(kinds(spark, sf), START)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.compute_snapshots(kinds(spark, sf), S.search_interest(spark, sf), S.TODAY, WEEKS)


def text_day(column: str = "week"):
    return F.col(column).cast("string").alias(column)
