"""Weekly series: weighted counts from mentions, search means, dense grids."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.dates import week_array, week_start
from shelfwave.rules import DEFAULT_RULES, Rules

KEY = ["dimension", "code"]


def source_weight(kind: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Weight of a mention in tenths, by the kind of its source."""
    out = F.lit(rules.default_weight)
    for name, weight in rules.source_weights.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def stance_sums(weight: Column, stance: Column) -> list[Column]:
    """The three known stances and the volume; the volume counts every stance, even an unknown one."""
    one = lambda name: F.sum(F.when(stance == name, weight).otherwise(F.lit(0))).alias(name)
    return [one("rising"), one("neutral"), one("declining"), F.sum(weight).alias("volume")]


def weekly_counts(enriched: DataFrame, since: date | None = None, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(dimension, code, week, rising, neutral, declining, volume) in tenths from mentions with their source's kind.

    The one heavy aggregate of the scoring: `since` reaches the scan, and partial sums keep a popular attribute from
    becoming a hot task."""
    rows = enriched if since is None else enriched.where(F.col("occurred_on") >= F.lit(since))
    return rows.groupBy(*KEY, week_start(F.col("occurred_on")).alias("week")).agg(
        *stance_sums(source_weight(F.col("kind"), rules), F.col("stance")))


def weekly_search(interest: DataFrame, since: date | None = None) -> DataFrame:
    """Mean search value per attribute and week, all languages and countries pooled."""
    rows = interest if since is None else interest.where(F.col("week") >= F.lit(since))
    return rows.groupBy(*KEY, week_start(F.col("week")).alias("week")).agg(F.avg("value").alias("search"))


def dense_grid(counts: DataFrame, search: DataFrame | None, weeks: list[date]) -> DataFrame:
    """Every attribute with mentions or search values x every week: 0 where there were no mentions, NULL where there was
    no search value.

    Both inputs are already one row per attribute and week, so a series is folded into two calendar-sized maps and
    unfolded again. That is one exchange on the series key, which the scoring windows then reuse."""
    measures = ["rising", "neutral", "declining", "volume"]
    none = F.lit(None).cast("double").alias("search")
    rows = counts.select(*KEY, "week", *measures, none)
    if search is not None:
        rows = rows.unionByName(search.select(*KEY, "week", *[F.lit(None).cast("long").alias(m) for m in measures], "search"))
    mapped = lambda keep, value: F.map_from_entries(F.collect_list(F.when(keep, F.struct(F.col("week"), value))))
    folded = rows.groupBy(*KEY).agg(
        mapped(F.col("volume").isNotNull() & F.col("week").isin(weeks), F.struct(*measures)).alias("c"),
        mapped(F.col("search").isNotNull() & F.col("week").isin(weeks), F.col("search")).alias("s"))
    cells = folded.select(*KEY, F.explode(week_array(weeks)).alias("week"), "c", "s")
    cell = F.col("c")[F.col("week")]
    return cells.select(*KEY, "week", *[F.coalesce(cell[m], F.lit(0)).cast("long").alias(m) for m in measures],
                        F.col("s")[F.col("week")].alias("search"))


def daily_to_weekly(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Daily values -> weekly means labelled by their Monday; a keyword that is 0 everywhere is left out.

    One shuffle: the per-week sums are aggregated again per keyword for the silence test."""
    weekly = daily.groupBy(*keys, week_start(F.col("day")).alias("week")).agg(
        F.avg("value").alias("value"), F.max("value").alias("peak"))
    loud = weekly.groupBy(*keys).agg(F.max("peak").alias("peak")).where(F.col("peak") > 0).select(*keys)
    return weekly.drop("peak").join(loud, keys, "left_semi")


def missing_pairs(items: DataFrame, interest: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(dimension, code, lang, geo) pairs with no stored value yet; demo rows do not count."""
    wanted = items.select(*KEY, F.explode(F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(geo).alias("geo"))
                                                    for lang, geo in pairs])).alias("pair")).select(*KEY, "pair.lang", "pair.geo")
    have = interest.where(~F.col("is_demo")).select("code", "lang", "geo").distinct()
    return wanted.join(have, ["code", "lang", "geo"], "left_anti").select(*KEY, "lang", "geo")
