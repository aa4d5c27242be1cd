"""Momentum, pace, tone and status of weekly series.

Volumes arrive in integer tenths. Every threshold on volumes is compared in cross-multiplied integers, so equality at a
threshold does not depend on the order of floating-point sums; only the search-blended momentum is a double.

The least-squares slope over the last n rows of a frame is 6*A / (n*(n*n-1)) with
A = 2*sum(i*v) - (2*i_last - n + 1)*sum(v), i the row number: exact, and one pass of running sums."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.dates import last_weeks, monday
from shelfwave.functions.numbers import rounded, tenths
from shelfwave.operators.series import KEY, dense_grid, weekly_counts, weekly_search
from shelfwave.rules import DEFAULT_RULES, Rules


def _series(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def slope_terms(value: Column, index: Column, frame: Window, last: Column) -> tuple[Column, Column]:
    """(A, n) of the exact slope over a frame whose newest row has index `last`."""
    n = F.count(value).over(frame)
    total = F.coalesce(F.sum(value).over(frame), F.lit(0))
    weighted = F.coalesce(F.sum(index * value).over(frame), F.lit(0))
    return F.lit(2) * weighted - (F.lit(2) * last - n + F.lit(1)) * total, n


def slope(a: Column, n: Column) -> Column:
    """Least-squares change per row from the terms above; 0 below two points."""
    return F.when(n >= 2, F.lit(6.0) * a / (n * (n * n - F.lit(1)))).otherwise(F.lit(0.0))


def series_frames(series: DataFrame, keys: list[str], order: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """All running sums of a dense series; one exchange and one sort serve every frame."""
    w = _series(keys, order)
    rows = series.withColumn("i", (F.row_number().over(w) - F.lit(1)).cast("long"))
    before = w.rowsBetween(-rules.baseline_weeks, -1)
    peak = w.rowsBetween(1 - rules.peak_window, 0)
    now = w.rowsBetween(1 - rules.pace_weeks, 0)
    prior = w.rowsBetween(1 - 2 * rules.pace_weeks, -rules.pace_weeks)
    tone = w.rowsBetween(1 - rules.tone_weeks, 0)
    v, i = F.col("volume"), F.col("i")
    a8, n8 = slope_terms(v, i, peak, i)
    a4, n4 = slope_terms(v, i, now, i)
    ap, np_ = slope_terms(v, i, prior, i - F.lit(rules.pace_weeks))
    return rows.select(
        "*", F.coalesce(F.sum(v).over(before), F.lit(0)).alias("base_sum"), F.count(v).over(before).alias("base_n"),
        F.max(v).over(peak).alias("high"), a8.alias("a8"), n8.alias("n8"), a4.alias("a4"), n4.alias("n4"),
        ap.alias("ap"), np_.alias("np"), F.sum(v).over(w.rowsBetween(1 - rules.sample_weeks, 0)).alias("sample"),
        F.sum("rising").over(tone).alias("r4"), F.sum("neutral").over(tone).alias("n4_neutral"),
        F.sum("declining").over(tone).alias("d4"))


def search_growth(keys: list[str], order: str, rules: Rules = DEFAULT_RULES) -> Column:
    """Growth of the non-NULL search values against up to four earlier ones; NULL unless the row has a value and at
    least two were seen. The known values of a series are a window of their own inside the same hash partition."""
    known = F.col("search").isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(order)
    base = F.avg("search").over(w.rowsBetween(-rules.baseline_weeks, -1))
    return F.when(known & (F.row_number().over(w) >= 2),
                  (F.col("search") - base) / F.greatest(base, F.lit(rules.search_floor)))


def volume_growth() -> Column:
    """(current - base mean) / max(base mean, 1.0), 0 in the first week."""
    n, s = F.col("base_n"), F.col("base_sum")
    return F.when(n == 0, F.lit(0.0)).otherwise(
        (F.col("volume") * n - s).cast("double") / F.greatest(s, F.lit(10) * n).cast("double"))


def classify() -> Column:
    """Status from momentum and shape of the last eight weeks, before the tone and sample overrides."""
    n, s, v = F.col("base_n"), F.col("base_sum"), F.col("volume")
    gain, floor = F.lit(4) * (v * n - s), F.greatest(s, F.lit(10) * n)
    blended, m = F.col("search_growth").isNotNull(), F.col("raw_momentum")
    up = F.when(blended, m >= 0.25).otherwise((n > 0) & (gain >= floor))
    down = F.when(blended, m <= -0.25).otherwise((n > 0) & (gain <= -floor))
    n8, a8, high = F.col("n8"), F.col("a8"), F.col("high")
    flat = ((F.lit(10) * v < F.lit(9) * high) | (F.lit(6) * a8 < F.lit(10) * n8 * (n8 + 1))
            | (F.lit(24) * a8 < high * n8 * (n8 + 1)))
    prior = F.greatest(F.col("ap"), F.lit(0))
    sustained = F.when(F.col("np") >= 4, F.lit(2) * F.col("a4") >= prior).when(
        F.col("np") == 3, F.lit(4) * F.col("a4") >= F.lit(5) * prior).otherwise(F.lit(True))
    return (F.when(up, F.lit("en_hausse")).when(down, F.lit("en_baisse"))
            .when((v <= 0) | (n8 < 4), F.lit("stable")).when(flat, F.lit("stable"))
            .when((m > 0) & (F.col("a4") > 0) & sustained, F.lit("en_hausse")).otherwise(F.lit("au_pic")))


def score_series(series: DataFrame, keys: list[str] = KEY, order: str = "week", with_search: bool = True,
                 with_tone: bool = True, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Momentum, status, tone and decline share of every row of dense series, from data up to that row only.

    Input: keys, order, rising, neutral, declining, volume (tenths) and search. `with_tone` off leaves the stances out of
    the status, as for series that have volumes only."""
    growth_of_search = search_growth(keys, order, rules) if with_search else F.lit(None).cast("double")
    frames = series_frames(series.withColumn("search_growth", growth_of_search), keys, order, rules)
    growth = volume_growth()
    blend = F.lit(1 - rules.search_blend) * growth + F.lit(rules.search_blend) * F.col("search_growth")
    total, d4 = F.col("r4") + F.col("n4_neutral") + F.col("d4"), F.col("d4")
    heard = total >= rules.min_tone
    fading = heard & (F.lit(2) * d4 >= total) if with_tone else F.lit(False)
    status = (F.when(F.col("sample") < rules.min_sample, F.lit("faible")).when(fading, F.lit("en_baisse"))
              .otherwise(classify()))
    return (frames.withColumn("raw_momentum", F.when(F.col("search_growth").isNotNull(), blend).otherwise(growth))
            .select(*keys, order, "rising", "neutral", "declining", "volume", "search",
                    rounded(F.col("raw_momentum"), 4).alias("momentum"), status.alias("status"),
                    F.when(heard, rounded((F.col("r4") - d4).cast("double") / total.cast("double"), 4)).alias("tone"),
                    F.when(heard, rounded(d4.cast("double") / total.cast("double"), 4)).alias("decline_share")))


def compute_snapshots(enriched: DataFrame, interest: DataFrame | None, today: date, weeks: int = 12,
                      rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The scored snapshot table of the last `weeks` weeks. A mention or search value dated after the last week still
    makes its attribute appear, with zeros."""
    week_list = last_weeks(monday(today), weeks)
    counts = weekly_counts(enriched, week_list[0], rules)
    search = None if interest is None else weekly_search(interest, week_list[0])
    scored = score_series(dense_grid(counts, search, week_list), with_search=interest is not None, rules=rules)
    return scored.select(*KEY, "week", tenths(F.col("volume")).alias("mentions"), "search", "momentum", "status", "tone",
                         "decline_share")
