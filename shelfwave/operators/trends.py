"""Readers of the snapshot table: report week, leaders, streaks, shares, sparklines, demand."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.dates import last_weeks, monday
from shelfwave.functions.numbers import js_round, rounded
from shelfwave.operators.series import KEY
from shelfwave.rules import DEFAULT_RULES, STATUS_FR, Rules


def report_week(snapshots: DataFrame, today: date) -> DataFrame:
    """One row: the latest complete scored week, or the latest one when none is complete."""
    current = F.lit(monday(today))
    return snapshots.agg(F.coalesce(F.max(F.when(F.col("week") < current, F.col("week"))), F.max("week")).alias("week"))


def resolve_week(snapshots: DataFrame, requested: date) -> DataFrame:
    """One row: the Monday of the requested day and whether it was scored."""
    week = monday(requested)
    return snapshots.where(F.col("week") == F.lit(week)).agg(
        F.lit(week).alias("week"), (F.count(F.lit(1)) > 0).alias("known"))


def scored_weeks(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("week").distinct().orderBy(F.desc("week"))


def at_week(snapshots: DataFrame, week: date) -> DataFrame:
    return snapshots.where(F.col("week") == F.lit(week))


def between(snapshots: DataFrame, end: date, weeks: int) -> DataFrame:
    return snapshots.where((F.col("week") >= F.lit(end - timedelta(weeks=weeks - 1))) & (F.col("week") <= F.lit(end)))


def decline_reason() -> Column:
    """Why a row is en_baisse: its volume fell, or its coverage calls it fading; NULL for any other status."""
    return F.when(F.col("status") == "en_baisse", F.when(F.col("momentum") <= -0.25, "volume").otherwise("tonalite"))


def with_reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("decline_reason", decline_reason())


def top_rising(snapshots: DataFrame, week: date, top: int = 5) -> DataFrame:
    """The first `top` rows of each dimension by momentum; too-little-data rows last, declining ones left out."""
    rows = at_week(snapshots, week).where((F.col("mentions") > 0) & (F.col("status") != "en_baisse"))
    w = Window.partitionBy("dimension").orderBy((F.col("status") == "faible").cast("int"), F.desc("momentum"), "code")
    return with_reason(rows).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def decline_severity() -> Column:
    return F.least(F.col("momentum"), -F.coalesce(F.col("decline_share"), F.lit(0.0)))


def top_declining(snapshots: DataFrame, week: date, top: int = 5) -> DataFrame:
    """The `top` worst declines: a fall of volume and a share of fading coverage rank on one scale."""
    rows = at_week(snapshots, week).where(F.col("status") == "en_baisse")
    return (with_reason(rows).withColumn("severity", decline_severity())
            .orderBy("severity", "dimension", "code").limit(top))


def week_columns(value: Column, weeks: list[date], default: Column) -> Column:
    """Array with one element per week, oldest first, as a plain conditional aggregate."""
    return F.array(*[F.coalesce(F.max(F.when(F.col("week") == F.lit(w), value)), default) for w in weeks])


def sparklines(snapshots: DataFrame, end: date, weeks: int = DEFAULT_RULES.spark_weeks) -> DataFrame:
    """Mentions of the last weeks as an array; a missing week is 0."""
    return between(snapshots, end, weeks).groupBy(*KEY).agg(
        week_columns(F.col("mentions"), last_weeks(end, weeks), F.lit(0.0)).alias("spark"))


def rising_streaks(snapshots: DataFrame, end: date, weeks: int = 12) -> DataFrame:
    """Consecutive weeks en_hausse ending at `end`; a missing week breaks the run."""
    flags = week_columns((F.col("status") == "en_hausse").cast("int"), last_weeks(end, weeks), F.lit(0))
    broken = F.array_max(F.transform(F.col("flags"), lambda f, i: F.when(f == 0, i).otherwise(-1)))
    return (between(snapshots, end, weeks).groupBy(*KEY).agg(flags.alias("flags"))
            .select(*KEY, (F.lit(weeks - 1) - broken).cast("long").alias("streak")))


def in_tenths(mentions: Column) -> Column:
    """Weighted mentions as the whole tenths they are. Sums of these are exact in any order; sums of the doubles are not."""
    return F.rint(mentions * 10).cast("long")


def share_of(mentions: Column, total: Column) -> Column:
    """One division of whole tenths; a total of 0 counts as 1 mention."""
    return in_tenths(mentions) / F.when(total == 0, F.lit(10)).otherwise(total)


def share_of_voice(snapshots: DataFrame, end: date, weeks: int = 1) -> DataFrame:
    """Share of each attribute in its dimension's mentions of the week; a total of 0 counts as 1."""
    rows = between(snapshots, end, weeks)
    totals = rows.groupBy("dimension", "week").agg(F.sum(in_tenths(F.col("mentions"))).alias("total"))
    return rows.join(totals, ["dimension", "week"]).withColumn("share", share_of(F.col("mentions"), F.col("total"))).drop("total")


def palette(snapshots: DataFrame, week: date, dimension: str) -> DataFrame:
    """Attributes with a positive share of the week, largest first."""
    rows = share_of_voice(snapshots.where(F.col("dimension") == dimension), week)
    return rows.where(F.col("share") > 0).select("code", "share").orderBy(F.desc("share"), "code")


def four_week_volume(snapshots: DataFrame, week: date) -> DataFrame:
    """Weighted mentions over the four weeks ending with `week`."""
    return between(snapshots, week, 4).groupBy(*KEY).agg((F.sum(in_tenths(F.col("mentions"))) / 10).alias("volume_4w"))


def must_cite(snapshots: DataFrame, week: date, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Rising or peaking attributes of the focus dimension with enough volume, strongest momentum first."""
    rows = at_week(snapshots, week).where(
        (F.col("dimension") == rules.must_cite_dimension) & F.col("status").isin("en_hausse", "au_pic"))
    volume = four_week_volume(snapshots.where(F.col("dimension") == rules.must_cite_dimension), week)
    return (rows.join(volume, KEY).where(in_tenths(F.col("volume_4w")) >= rules.must_cite_min)
            .orderBy(F.desc("momentum"), "code"))


def series_stats(snapshots: DataFrame, end: date, weeks: int = 12) -> DataFrame:
    """Per attribute: this week, change from the week before, mean of the four weeks before (needs five weeks), latest
    and first known search value and their difference (needs two)."""
    week_list = last_weeks(end, weeks)
    known = F.filter(F.col("searches"), lambda v: v.isNotNull())
    last = F.get(F.col("values"), F.lit(weeks - 1))
    before = F.get(F.col("values"), F.lit(weeks - 2)) if weeks >= 2 else last
    four = [F.get(F.col("values"), F.lit(k)) for k in range(weeks - 5, weeks - 1)] if weeks >= 5 else []
    mean4 = rounded(sum(four[1:], four[0]) / F.lit(4.0), 2) if four else F.lit(None).cast("double")
    rows = between(snapshots, end, weeks).groupBy(*KEY).agg(
        week_columns(F.col("mentions"), week_list, F.lit(0.0)).alias("values"),
        week_columns(F.col("search"), week_list, F.lit(None).cast("double")).alias("searches"))
    return (rows.withColumn("known", known)
            .select(*KEY, last.alias("this_week"), (last - before).alias("change"), mean4.alias("avg_4w"),
                    F.get("known", F.size("known") - 1).alias("search_latest"),
                    F.when(F.size("known") >= 2, F.get("known", F.size("known") - 1) - F.get("known", F.lit(0))).alias("search_change")))


def week_changes(snapshots: DataFrame) -> DataFrame:
    """Week-over-week difference of every stored row; NULL in a series' first week."""
    w = Window.partitionBy(*KEY).orderBy("week")
    return snapshots.withColumn("change", F.col("mentions") - F.lag("mentions").over(w))


def signal_counts(snapshots: DataFrame, week: date, top: int = 5) -> DataFrame:
    """Report header: en_hausse rows among the leaders shown, and the number of declines shown."""
    rising = top_rising(snapshots, week, top).agg(F.count_if(F.col("status") == "en_hausse").alias("n"))
    falling = top_declining(snapshots, week, top).agg(F.count(F.lit(1)).alias("n"))
    return (rising.select(F.lit("rising").alias("signal"), "n")
            .unionByName(falling.select(F.lit("declining").alias("signal"), "n")))


def trend_table(snapshots: DataFrame, end: date, weeks: int = 12, dimension: str | None = None) -> DataFrame:
    """One row per attribute seen in the period: weekly arrays, the last week's figures (momentum 0 and stable when the
    last week is missing) and its share of its dimension."""
    rows = snapshots if dimension is None else snapshots.where(F.col("dimension") == dimension)
    week_list = last_weeks(end, weeks)
    last = lambda column: F.max(F.when(F.col("week") == F.lit(end), F.col(column)))
    series = between(rows, end, weeks).groupBy(*KEY).agg(
        week_columns(F.col("mentions"), week_list, F.lit(0.0)).alias("mentions"),
        week_columns(F.col("search"), week_list, F.lit(None).cast("double")).alias("search"),
        F.coalesce(last("momentum"), F.lit(0.0)).alias("momentum"), F.coalesce(last("status"), F.lit("stable")).alias("status"),
        last("tone").alias("tone"), last("decline_share").alias("decline_share"), F.coalesce(last("mentions"), F.lit(0.0)).alias("current"))
    totals = series.groupBy("dimension").agg(F.sum(in_tenths(F.col("current"))).alias("total"))
    return with_reason(series.join(totals, "dimension").withColumn("share", share_of(F.col("current"), F.col("total"))).drop("total"))


# --- search demand ---------------------------------------------------------------------------------

def demand_values(interest: DataFrame) -> DataFrame:
    """(dimension, code, week, fr, world): the last stored row wins when several languages share a cell."""
    home = F.col("geo") != ""
    pick = lambda keep: rounded(F.max_by(F.when(keep, F.col("value")), F.when(keep, F.col("id"))), 1)
    return interest.groupBy("dimension", "code", "week").agg(pick(home).alias("fr"), pick(~home).alias("world"))


def demand_weeks(interest: DataFrame) -> DataFrame:
    """Distinct weeks of each dimension with their position from the end (0 = newest)."""
    w = Window.partitionBy("dimension").orderBy(F.desc("week"))
    return interest.select("dimension", "week").distinct().withColumn("from_end", (F.row_number().over(w) - 1).cast("long"))


def demand_grid(interest: DataFrame) -> DataFrame:
    """Every searched attribute x every week of its dimension. The weeks of a dimension are a calendar-sized list."""
    weeks = interest.select("dimension", "week").distinct().groupBy("dimension").agg(F.collect_list("week").alias("weeks"))
    cells = interest.select(*KEY).distinct().join(weeks, "dimension").select(*KEY, F.explode("weeks").alias("week"))
    return cells.join(demand_values(interest), [*KEY, "week"], "left")


def demand_change(interest: DataFrame) -> DataFrame:
    """Mean of the last four weeks against the four before, NULLs ignored. A series without a positive value counts as
    absent; the home market is used when it has one, else the world."""
    values = demand_values(interest).join(demand_weeks(interest), ["dimension", "week"])

    def means(column: str) -> list[Column]:
        return [F.max(column).alias(f"{column}_peak"), F.avg(F.when(F.col("from_end") < 4, F.col(column))).alias(f"{column}_recent"),
                F.avg(F.when(F.col("from_end").between(4, 7), F.col(column))).alias(f"{column}_base")]

    rows = values.groupBy(*KEY).agg(*means("fr"), *means("world"))
    home, abroad = F.col("fr_peak") > 0, F.col("world_peak") > 0
    chosen = lambda part: F.when(home, F.col(f"fr_{part}")).when(abroad, F.col(f"world_{part}"))
    percent = js_round((F.col("recent") - F.col("base")) / F.col("base") * 100)
    sign = F.when(percent > 0, "+").when(percent < 0, "−").otherwise("")
    text = (F.when(F.col("recent").isNull() | F.col("base").isNull(), "—")
            .when(F.col("base") == 0, F.when(F.col("recent") > 0, "nouveau").otherwise("—"))
            .otherwise(F.concat(sign, F.abs(percent).cast("string"), F.lit(" %"))))
    return (rows.select(*KEY, F.when(home, "home").otherwise("world").alias("geo"), chosen("recent").alias("recent"), chosen("base").alias("base"))
            .withColumn("change", text))


def demand_list(interest: DataFrame, trends: DataFrame) -> DataFrame:
    """Searched attributes plus press-only ones with enough data (in dimensions that are searched at all), by momentum;
    an attribute without a trend row sorts as -9."""
    searched = interest.select(*KEY).distinct().withColumn("searched", F.lit(True))
    dims = interest.select("dimension").distinct()
    rows = trends.select(*KEY, "momentum", "status").join(searched, KEY, "full_outer").join(dims, "dimension", "left_semi")
    kept = rows.where(F.coalesce("searched", F.lit(False)) | (F.col("status") != "faible"))
    return kept.select(*KEY, F.coalesce("searched", F.lit(False)).alias("searched"),
                       F.coalesce("momentum", F.lit(-9.0)).alias("momentum")).orderBy("dimension", F.desc("momentum"), "code")


def status_label(status: Column) -> Column:
    out = status
    for code, label in STATUS_FR.items():
        out = F.when(status == code, F.lit(label)).otherwise(out)
    return out

