"""Weekly series, scores and their readers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfwave.operators import mentions as M, scoring, series, trends as T
from shelfwave.operators.series import KEY
from shelfwave.plans.catalogue.shared import START, WEEK, WEEKS, counts, enriched, kinds, snapshots, text_day
from shelfwave.plans.oracle_views import with_views
from shelfwave.plans.registry import query
from shelfwave.functions.dates import last_weeks
from shelfwave.rules import Rules
from shelfwave.sources import samples as S


@query("weekly_stance_counts", with_views("weekly", """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, CAST(r AS BIGINT) AS rising, CAST(n AS BIGINT) AS neutral,
       CAST(d AS BIGINT) AS declining, CAST(v AS BIGINT) AS volume FROM weekly"""))
def weekly_stance_counts(spark, sf):
    return counts(spark, sf).select(*KEY, text_day(), "rising", "neutral", "declining", "volume")


@query("weekly_search_mean", with_views("search weekly_search", """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, round(s, 6) AS search FROM weekly_search"""))
def weekly_search_mean(spark, sf):
    return series.weekly_search(S.search_interest(spark, sf), START).select(*KEY, text_day(), F.round("search", 6).alias("search"))


@query("daily_values_to_weekly", """
WITH d AS (SELECT event_type AS dimension, 'u' || (user_id % 8) AS code, CAST(ts AS DATE) AS day,
                  CASE WHEN event_type = 'error' THEN 0.0 ELSE floor(value) END AS v FROM events)
SELECT dimension, code, 'en' AS lang, '' AS geo, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week,
       round(sum(v) / count(*), 6) AS value
FROM d WHERE (dimension, code) IN (SELECT (dimension, code) FROM d GROUP BY dimension, code HAVING max(v) > 0)
GROUP BY dimension, code, 5""")
def daily_values_to_weekly(spark, sf):
    out = series.daily_to_weekly(S.daily_search(spark, sf), ["dimension", "code", "lang", "geo"])
    return out.select(*KEY, "lang", "geo", text_day(), F.round("value", 6).alias("value"))


@query("missing_search_pairs", with_views("dict search", """
SELECT dict.dimension, dict.code, p.lang, p.geo FROM dict
CROSS JOIN (VALUES ('fr', 'FR'), ('en', ''), ('it', 'FR')) p(lang, geo)
WHERE NOT EXISTS (SELECT 1 FROM search s WHERE s.code = dict.code AND s.lang = p.lang AND s.geo = p.geo AND s.id % 50 <> 0)"""))
def missing_search_pairs(spark, sf):
    return series.missing_pairs(S.dictionary(spark, sf), S.search_interest(spark, sf), [("fr", "FR"), ("en", ""), ("it", "FR")])


@query("series_grid", with_views("grid", """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, CAST(r AS BIGINT) AS rising, CAST(n AS BIGINT) AS neutral,
       CAST(d AS BIGINT) AS declining, CAST(v AS BIGINT) AS volume, round(s, 6) AS search FROM grid"""))
def series_grid(spark, sf):
    search = series.weekly_search(S.search_interest(spark, sf), START)
    grid = series.dense_grid(counts(spark, sf), search, last_weeks(WEEK, WEEKS))
    return grid.select(*KEY, text_day(), "rising", "neutral", "declining", "volume", F.round("search", 6).alias("search"))


@query("series_growth_and_slopes", with_views("grid", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY dimension, code ORDER BY wk) - 1 AS i FROM grid),
y AS (SELECT *,
  avg(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS base,
  count(*) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS n8,
  max(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS high,
  regr_slope(v, i) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS s8,
  regr_slope(v, i) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s4,
  count(*) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS np,
  regr_slope(v, i) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS sp FROM x)
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, CAST(high AS BIGINT) AS high,
  round(CASE WHEN i = 0 THEN 0 ELSE (v - base) / greatest(base, 10) END, 6) AS growth,
  round(CASE WHEN i = 0 THEN 0 ELSE s8 * (n8 - 1) END, 5) AS fitted_rise,
  round(CASE WHEN i = 0 THEN 0 ELSE s4 END, 5) AS recent,
  round(CASE WHEN np >= 3 THEN sp WHEN i = 0 THEN 0 ELSE s4 END, 5) AS prior FROM y"""))
def series_growth_and_slopes(spark, sf):
    search = series.weekly_search(S.search_interest(spark, sf), START)
    frames = scoring.series_frames(series.dense_grid(counts(spark, sf), search, last_weeks(WEEK, WEEKS)), KEY, "week")
    recent = scoring.slope(F.col("a4"), F.col("n4"))
    prior = F.when(F.col("np") >= 3, scoring.slope(F.col("ap"), F.col("np"))).otherwise(recent)
    return frames.select(*KEY, text_day(), "high", F.round(scoring.volume_growth(), 6).alias("growth"),
                         F.round(scoring.slope(F.col("a8"), F.col("n8")) * (F.col("n8") - 1), 5).alias("fitted_rise"),
                         F.round(recent, 5).alias("recent"), F.round(prior, 5).alias("prior"))


SNAPSHOT_SQL = """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, mentions, round(search, 6) AS search, momentum, status, tone, decline_share
FROM snaps"""


@query("trend_snapshots", with_views("snaps", SNAPSHOT_SQL))
def trend_snapshots(spark, sf):
    return snapshots(spark, sf).select(*KEY, text_day(), "mentions", F.round("search", 6).alias("search"), "momentum",
                                       "status", "tone", "decline_share")


@query("trend_snapshots_volume_only", with_views("ment docs sources weekly", """
WITH k AS (SELECT DISTINCT dimension, code FROM weekly),
g AS (SELECT k.dimension, k.code, c.wk, coalesce(v, 0) AS v FROM k
      CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2001-07-09', DATE '2001-09-24', INTERVAL 7 DAY)) AS DATE) AS wk) c
      LEFT JOIN weekly USING (dimension, code, wk)),
f AS (SELECT *, sum(v) OVER (PARTITION BY dimension, code ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS bs,
      count(*) OVER (PARTITION BY dimension, code ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS bn FROM g)
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, v / 10.0 AS mentions,
  CASE WHEN bn = 0 THEN 0.0 ELSE round_even(CAST(v * bn - bs AS DOUBLE) / CAST(greatest(bs, 10 * bn) AS DOUBLE) * 10000.0, 0) / 10000.0 + 0.0 END AS momentum
FROM f"""))
def trend_snapshots_volume_only(spark, sf):
    return scoring.compute_snapshots(kinds(spark, sf), None, S.TODAY, WEEKS).select(*KEY, text_day(), "mentions", "momentum")


@query("top_rising_by_dimension", with_views("snaps", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY status = 'faible', momentum DESC, code) AS place
           FROM snaps WHERE wk = DATE '2001-09-24' AND mentions > 0 AND status <> 'en_baisse')
SELECT dimension, code, mentions, momentum, status, tone, place FROM r WHERE place <= 5"""))
def top_rising_by_dimension(spark, sf):
    return T.top_rising(snapshots(spark, sf), WEEK, 5).select(*KEY, "mentions", "momentum", "status", "tone", "place")


@query("top_declining", with_views("snaps", """
SELECT dimension, code, momentum, decline_share, least(momentum, -coalesce(decline_share, 0.0)) AS severity,
       CASE WHEN momentum <= -0.25 THEN 'volume' ELSE 'tonalite' END AS decline_reason
FROM snaps WHERE wk = DATE '2001-09-24' AND status = 'en_baisse' ORDER BY severity, dimension, code LIMIT 12"""))
def top_declining(spark, sf):
    return T.top_declining(snapshots(spark, sf), WEEK, 12).select(*KEY, "momentum", "decline_share", "severity", "decline_reason")


@query("decline_reasons", with_views("snaps", """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, CASE WHEN status = 'en_baisse' THEN CASE WHEN momentum <= -0.25 THEN 'volume'
       ELSE 'tonalite' END END AS decline_reason FROM snaps"""))
def decline_reasons(spark, sf):
    return T.with_reason(snapshots(spark, sf)).select(*KEY, text_day(), "decline_reason")


@query("report_week", with_views("snaps", """
SELECT CAST(coalesce(max(CASE WHEN wk < DATE '2001-09-24' THEN wk END), max(wk)) AS VARCHAR) AS week FROM snaps"""))
def report_week(spark, sf):
    return T.report_week(snapshots(spark, sf), S.TODAY).select(text_day())


@query("requested_week", with_views("snaps", """
SELECT '2001-08-20' AS week, count(*) > 0 AS known FROM snaps WHERE wk = DATE '2001-08-20'"""))
def requested_week(spark, sf):
    return T.resolve_week(snapshots(spark, sf), date(2001, 8, 23)).select(text_day(), "known")


@query("scored_weeks", with_views("snaps", "SELECT DISTINCT CAST(wk AS VARCHAR) AS week FROM snaps"))
def scored_weeks(spark, sf):
    return T.scored_weeks(snapshots(spark, sf)).select(text_day())


@query("sparklines", with_views("snaps", """
SELECT dimension, code, string_agg(CAST(CAST(round(mentions * 10) AS BIGINT) AS VARCHAR), '|' ORDER BY wk) AS spark
FROM snaps WHERE wk >= DATE '2001-08-06' AND wk <= DATE '2001-09-24' GROUP BY dimension, code"""))
def sparklines(spark, sf):
    return T.sparklines(snapshots(spark, sf), WEEK).select(
        *KEY, F.array_join(F.transform("spark", lambda v: F.round(v * 10).cast("long").cast("string")), "|").alias("spark"))


@query("rising_streaks", with_views("snaps", """
SELECT dimension, code, CAST(12 - 1 - coalesce(max(CASE WHEN status <> 'en_hausse' THEN date_diff('day', DATE '2001-07-09', wk) // 7 END), -1)
       AS BIGINT) AS streak FROM snaps GROUP BY dimension, code"""))
def rising_streaks(spark, sf):
    return T.rising_streaks(snapshots(spark, sf), WEEK, WEEKS)


@query("share_of_voice", with_views("snaps", """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, round(CAST(round(mentions * 10) AS BIGINT) / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS share
FROM (SELECT *, sum(CAST(round(mentions * 10) AS BIGINT)) OVER (PARTITION BY dimension, wk) AS t FROM snaps)"""))
def share_of_voice(spark, sf):
    return T.share_of_voice(snapshots(spark, sf), WEEK, WEEKS).select(*KEY, text_day(), F.round("share", 6).alias("share"))


@query("palette_of_the_week", with_views("snaps", """
SELECT code, round(CAST(round(mentions * 10) AS BIGINT) / sum(CAST(round(mentions * 10) AS BIGINT)) OVER (), 6) AS share FROM snaps
WHERE wk = DATE '2001-09-24' AND dimension = 'PROMO' QUALIFY mentions > 0"""))
def palette_of_the_week(spark, sf):
    return T.palette(snapshots(spark, sf), WEEK, "PROMO").select("code", F.round("share", 6).alias("share"))


@query("four_week_volume", with_views("snaps", """
SELECT dimension, code, round(sum(CAST(round(mentions * 10) AS BIGINT)) / 10, 4) AS volume_4w FROM snaps WHERE wk > DATE '2001-08-27' AND wk <= DATE '2001-09-24'
GROUP BY dimension, code"""))
def four_week_volume(spark, sf):
    return T.four_week_volume(snapshots(spark, sf), WEEK).select(*KEY, F.round("volume_4w", 4).alias("volume_4w"))


@query("must_cite_attributes", with_views("snaps", """
WITH v AS (SELECT dimension, code, sum(CAST(round(mentions * 10) AS BIGINT)) / 10 AS volume_4w FROM snaps WHERE wk > DATE '2001-07-23' AND wk <= DATE '2001-08-20' GROUP BY 1, 2)
SELECT s.code, s.momentum, s.status, round(volume_4w, 4) AS volume_4w FROM snaps s JOIN v USING (dimension, code)
WHERE wk = DATE '2001-08-20' AND dimension = 'PROMO' AND status IN ('en_hausse', 'au_pic') AND round(volume_4w, 6) >= 10"""))
def must_cite_attributes(spark, sf):
    rows = T.must_cite(snapshots(spark, sf), date(2001, 8, 20), Rules(must_cite_dimension="PROMO"))
    return rows.select("code", "momentum", "status", F.round("volume_4w", 4).alias("volume_4w"))


@query("series_stats", with_views("snaps", """
WITH l AS (SELECT dimension, code, list(mentions ORDER BY wk) AS m, list(search ORDER BY wk) FILTER (search IS NOT NULL) AS s FROM snaps GROUP BY 1, 2)
SELECT dimension, code, m[12] AS this_week, round(m[12] - m[11], 6) AS change,
       round_even((m[8] + m[9] + m[10] + m[11]) / 4 * 100, 0) / 100 AS avg_4w, round(s[-1], 6) AS search_latest,
       CASE WHEN len(s) >= 2 THEN round(s[-1] - s[1], 6) END AS search_change FROM l"""))
def series_stats(spark, sf):
    return T.series_stats(snapshots(spark, sf), WEEK, WEEKS).select(
        *KEY, "this_week", F.round("change", 6).alias("change"), "avg_4w",
        F.round("search_latest", 6).alias("search_latest"), F.round("search_change", 6).alias("search_change"))


@query("week_over_week", with_views("snaps", """
SELECT dimension, code, CAST(wk AS VARCHAR) AS week, round(mentions - lag(mentions) OVER (PARTITION BY dimension, code ORDER BY wk), 6) AS change FROM snaps"""))
def week_over_week(spark, sf):
    return T.week_changes(snapshots(spark, sf)).select(*KEY, text_day(), F.round("change", 6).alias("change"))


@query("signal_counts", with_views("snaps", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY status = 'faible', momentum DESC, code) AS place
           FROM snaps WHERE wk = DATE '2001-09-24' AND mentions > 0 AND status <> 'en_baisse')
SELECT 'rising' AS signal, count(*) FILTER (status = 'en_hausse') AS n FROM r WHERE place <= 5
UNION ALL SELECT 'declining', least(5, count(*)) FROM snaps WHERE wk = DATE '2001-09-24' AND status = 'en_baisse'"""))
def signal_counts(spark, sf):
    return T.signal_counts(snapshots(spark, sf), WEEK)


@query("trend_table", with_views("snaps", """
SELECT dimension, code, string_agg(CAST(CAST(round(mentions * 10) AS BIGINT) AS VARCHAR), '|' ORDER BY wk) AS mentions,
  max(CASE WHEN wk = DATE '2001-09-24' THEN momentum END) AS momentum, max(CASE WHEN wk = DATE '2001-09-24' THEN status END) AS status,
  round(max(CASE WHEN wk = DATE '2001-09-24' THEN CAST(round(mentions * 10) AS BIGINT) END) / any_value(t), 6) AS share
FROM (SELECT *, sum(CASE WHEN wk = DATE '2001-09-24' THEN CAST(round(mentions * 10) AS BIGINT) ELSE 0 END) OVER (PARTITION BY dimension) AS t FROM snaps)
GROUP BY dimension, code"""))
def trend_table(spark, sf):
    return T.trend_table(snapshots(spark, sf), WEEK, WEEKS).select(
        *KEY, F.array_join(F.transform("mentions", lambda v: F.round(v * 10).cast("long").cast("string")), "|").alias("mentions"),
        "momentum", "status", F.round("share", 6).alias("share"))


# --- mentions --------------------------------------------------------------------------------------

@query("mentions_with_sources", with_views("ment docs sources", """
SELECT m.id, m.dimension, m.code, m.stance, m.evidence, CAST(occurred_on AS VARCHAR) AS date, title, docs.url, docs.lang, s.name AS source, s.kind
FROM ment m JOIN docs ON docs.id = m.document_id JOIN sources s ON s.id = docs.source_id
WHERE occurred_on >= DATE '2001-01-01' AND occurred_on <= DATE '2001-06-30' AND docs.lang = 'fr' AND s.kind = 'news' AND dimension = 'SMALL'"""))
def mentions_with_sources(spark, sf):
    rows = M.filter_mentions(enriched(spark, sf), dimension="SMALL", lang="fr", kind="news", since=date(2001, 1, 1), until=date(2001, 6, 30))
    return M.mention_rows(rows).select("id", *KEY, "stance", "evidence", text_day("date"), "title", "url", "lang", "source", "kind")


@query("mentions_page", with_views("ment docs sources", """
SELECT m.id, m.code, CAST(occurred_on AS VARCHAR) AS date, s.name AS source FROM ment m JOIN docs ON docs.id = m.document_id
JOIN sources s ON s.id = docs.source_id WHERE dimension = 'LARGE' ORDER BY occurred_on DESC, m.id DESC LIMIT 20 OFFSET 40"""))
def mentions_page(spark, sf):
    return M.mentions_page(enriched(spark, sf), limit=20, offset=40, dimension="LARGE").select("id", "code", text_day("date"), "source")


DEEP_SQL = with_views("ment docs sources", """
SELECT m.id, m.code, CAST(occurred_on AS VARCHAR) AS date, s.name AS source FROM ment m JOIN docs ON docs.id = m.document_id
JOIN sources s ON s.id = docs.source_id WHERE dimension = 'LARGE' ORDER BY occurred_on DESC, m.id DESC LIMIT 25 OFFSET 700""")


@query("mentions_deep_page", DEEP_SQL)
def mentions_deep_page(spark, sf):
    """A page far down, found by counts of days."""
    return M.deep_page(enriched(spark, sf), limit=25, offset=700, dimension="LARGE").select("id", "code", text_day("date"), "source")


@query("mentions_next_page", DEEP_SQL)
def mentions_next_page(spark, sf):
    """The same page as the rows after the last one of the page before."""
    rows = enriched(spark, sf)
    last = M.deep_page(rows, limit=1, offset=699, dimension="LARGE").select("date", "id").first()
    return M.mentions_after(rows, None if last is None else tuple(last), limit=25, dimension="LARGE").select("id", "code", text_day("date"), "source")


@query("mentions_total", with_views("ment docs sources", """
SELECT count(*) AS total FROM ment m JOIN docs ON docs.id = m.document_id JOIN sources s ON s.id = docs.source_id
WHERE kind = 'press' AND occurred_on >= DATE '2000-01-01'"""))
def mentions_total(spark, sf):
    return M.mentions_total(enriched(spark, sf), kind="press", since=date(2000, 1, 1))


@query("latest_evidence", with_views("ment docs sources", """
SELECT m.id, m.evidence, CAST(occurred_on AS VARCHAR) AS date, docs.url FROM ment m JOIN docs ON docs.id = m.document_id
JOIN sources s ON s.id = docs.source_id WHERE dimension = 'PROMO' AND code = 'red' AND occurred_on <= DATE '2001-09-30'
ORDER BY occurred_on DESC, m.id DESC LIMIT 10"""))
def latest_evidence(spark, sf):
    return M.latest_evidence(enriched(spark, sf), date(2001, 9, 30), dimension="PROMO", code="red").select("id", "evidence", text_day("date"), "url")


@query("documents_with_mentions", with_views("ment docs", """
SELECT id, url FROM docs WHERE id IN (SELECT document_id FROM ment WHERE dimension = 'ECONOMY' AND code = 'hot')"""))
def documents_with_mentions(spark, sf):
    rows = S.mentions(spark, sf).where((F.col("dimension") == "ECONOMY") & (F.col("code") == "hot"))
    return M.documents_with(S.documents(spark, sf), rows).select("id", "url")


@query("document_page", with_views("ment docs sources", """
WITH page AS (SELECT docs.id, docs.url, s.name AS source, CAST(coalesce(published_at, collected_at) AS DATE) AS day
  FROM docs JOIN sources s ON s.id = docs.source_id WHERE status = 'extracted' AND docs.lang = 'fr'
  AND docs.id IN (SELECT document_id FROM ment WHERE dimension = 'SMALL' AND occurred_on >= DATE '2000-01-01')
  ORDER BY coalesce(published_at, collected_at) DESC, docs.id DESC LIMIT 25 OFFSET 5),
f AS (SELECT document_id, dimension, code, arg_min(stance, id) AS stance, arg_min(evidence, id) AS evidence FROM ment
  WHERE document_id IN (SELECT id FROM page) GROUP BY 1, 2, 3)
SELECT page.id, page.url, page.source, CAST(day AS VARCHAR) AS date,
  string_agg(dimension || ':' || code || ':' || stance, ' ' ORDER BY dimension, code) AS attributes,
  arg_min(evidence, code) FILTER (dimension = 'SMALL') AS quote
FROM page JOIN f ON f.document_id = page.id GROUP BY 1, 2, 3, 4"""))
def document_page(spark, sf):
    page = M.document_page(S.documents(spark, sf), S.sources(spark, sf), S.mentions(spark, sf), dimension="SMALL", lang="fr",
                           since=date(2000, 1, 1), limit=25, offset=5)
    return page.select("id", "url", "source", text_day("date"), F.array_join(F.transform("attributes", lambda a: F.concat_ws(
        ":", a["dimension"], a["code"], a["stance"])), " ").alias("attributes"), "quote")


@query("document_total", with_views("ment docs", """
SELECT count(*) AS total FROM docs WHERE status = 'extracted' AND id IN (SELECT document_id FROM ment WHERE dimension = 'SMALL' AND occurred_on >= DATE '2000-01-01')"""))
def document_total(spark, sf):
    return M.document_total(S.documents(spark, sf), S.mentions(spark, sf), dimension="SMALL", since=date(2000, 1, 1))


@query("stance_counts_4w", with_views("ment docs sources", """
SELECT dimension, code, count(*) FILTER (stance = 'rising') AS rising, count(*) FILTER (stance = 'neutral') AS neutral,
  count(*) FILTER (stance = 'declining') AS declining, round(count(*) FILTER (stance = 'rising') / count(*), 6) AS rising_share,
  round(count(*) FILTER (stance = 'declining') / count(*), 6) AS declining_share
FROM ment m JOIN docs ON docs.id = m.document_id JOIN sources s ON s.id = docs.source_id
WHERE occurred_on >= DATE '2001-07-30' AND occurred_on <= DATE '2001-08-26' GROUP BY dimension, code"""))
def stance_counts_4w(spark, sf):
    rows = M.last_four_weeks(enriched(spark, sf), date(2001, 8, 20))
    return M.stance_counts(rows, KEY).select(*KEY, "rising", "neutral", "declining", F.round("rising_share", 6).alias("rising_share"),
                                             F.round("declining_share", 6).alias("declining_share"))


@query("co_mentioned_brands", with_views("ment docs", """
WITH d AS (SELECT brand1, brand2 FROM docs WHERE id IN (SELECT document_id FROM ment WHERE dimension = 'SMALL' AND code = 'old'
           AND occurred_on >= DATE '2001-07-30' AND occurred_on <= DATE '2001-08-26'))
SELECT name, count(*) AS count FROM (SELECT brand1 AS name FROM d UNION ALL SELECT brand2 FROM d) GROUP BY name
ORDER BY count(*) DESC, name LIMIT 10"""))
def co_mentioned_brands(spark, sf):
    rows = M.last_four_weeks(S.mentions(spark, sf), date(2001, 8, 20)).where((F.col("dimension") == "SMALL") & (F.col("code") == "old"))
    return M.co_mentioned_brands(S.documents(spark, sf), rows, 10)


@query("brands_by_attribute", with_views("ment docs", """
WITH p AS (SELECT DISTINCT document_id, dimension, code FROM ment WHERE occurred_on >= DATE '2001-07-30' AND occurred_on <= DATE '2001-08-26'),
b AS (SELECT dimension, code, unnest([brand1, brand2]) AS name FROM p JOIN docs ON docs.id = p.document_id)
SELECT dimension, code, name, count(*) AS count FROM b GROUP BY 1, 2, 3
QUALIFY row_number() OVER (PARTITION BY dimension, code ORDER BY count(*) DESC, name) <= 10"""))
def brands_by_attribute(spark, sf):
    rows = M.last_four_weeks(S.mentions(spark, sf), date(2001, 8, 20))
    return M.brands_by_attribute(S.documents(spark, sf), rows).select(*KEY, "name", "count")


@query("header_counters", with_views("ment docs sources", """
SELECT 'documents' AS metric, count(*) FILTER (status = 'extracted') AS value FROM docs
UNION ALL SELECT 'pending', count(*) FILTER (status = 'pending') FROM docs UNION ALL SELECT 'demo', count(*) FILTER (is_demo) FROM docs
UNION ALL SELECT 'mentions', count(*) FROM ment UNION ALL SELECT 'sources', count(*) FILTER (active) FROM sources"""))
def header_counters(spark, sf):
    return M.counters(S.documents(spark, sf), S.mentions(spark, sf), S.sources(spark, sf))


# --- search demand ---------------------------------------------------------------------------------

DEMAND_SQL = """
WITH c AS (SELECT dimension, code, wk, arg_max(CASE WHEN geo <> '' THEN val END, CASE WHEN geo <> '' THEN id END) AS fr,
                  arg_max(CASE WHEN geo = '' THEN val END, CASE WHEN geo = '' THEN id END) AS world FROM search GROUP BY 1, 2, 3),
v AS (SELECT dimension, code, wk, round_even(fr * 10, 0) / 10 AS fr, round_even(world * 10, 0) / 10 AS world FROM c)"""


@query("demand_grid", with_views("search", DEMAND_SQL + """
SELECT k.dimension, k.code, CAST(w.wk AS VARCHAR) AS week, fr, world FROM (SELECT DISTINCT dimension, code FROM search) k
JOIN (SELECT DISTINCT dimension, wk FROM search) w ON w.dimension = k.dimension
LEFT JOIN v ON v.dimension = k.dimension AND v.code = k.code AND v.wk = w.wk"""))
def demand_grid(spark, sf):
    return T.demand_grid(S.search_interest(spark, sf)).select(*KEY, text_day(), "fr", "world")


@query("demand_change", with_views("search", DEMAND_SQL + """,
w AS (SELECT dimension, wk, row_number() OVER (PARTITION BY dimension ORDER BY wk DESC) - 1 AS p FROM (SELECT DISTINCT dimension, wk FROM search)),
a AS (SELECT dimension, code, max(fr) > 0 AS home, avg(fr) FILTER (p < 4) AS fr1, avg(fr) FILTER (p BETWEEN 4 AND 7) AS fr2,
             max(world) > 0 AS abroad, avg(world) FILTER (p < 4) AS w1, avg(world) FILTER (p BETWEEN 4 AND 7) AS w2 FROM v JOIN w USING (dimension, wk) GROUP BY 1, 2),
b AS (SELECT dimension, code, CASE WHEN home THEN 'home' ELSE 'world' END AS geo, CASE WHEN home THEN fr1 WHEN abroad THEN w1 END AS recent,
             CASE WHEN home THEN fr2 WHEN abroad THEN w2 END AS base FROM a)
SELECT dimension, code, geo, round(recent, 4) AS recent, round(base, 4) AS base, CASE WHEN recent IS NULL OR base IS NULL THEN '—' WHEN base = 0 THEN CASE WHEN recent > 0 THEN 'nouveau' ELSE '—' END
  ELSE CASE WHEN pc > 0 THEN '+' WHEN pc < 0 THEN '−' ELSE '' END || abs(pc) || ' %' END AS change FROM (SELECT *, CAST(floor((recent - base) / nullif(base, 0) * 100 + 0.5) AS BIGINT) AS pc FROM b)"""))
def demand_change(spark, sf):
    return T.demand_change(S.search_interest(spark, sf)).select(*KEY, "geo", F.round("recent", 4).alias("recent"), F.round("base", 4).alias("base"), "change")


@query("demand_list", with_views("search snaps", """
WITH q AS (SELECT DISTINCT dimension, code FROM search),
r AS (SELECT coalesce(t.dimension, q.dimension) AS dimension, coalesce(t.code, q.code) AS code, q.code IS NOT NULL AS searched, momentum, status
      FROM (SELECT * FROM snaps WHERE wk = DATE '2001-09-24') t FULL JOIN q ON q.dimension = t.dimension AND q.code = t.code)
SELECT dimension, code, searched, coalesce(momentum, -9.0) AS momentum FROM r
WHERE dimension IN (SELECT dimension FROM q) AND (searched OR status <> 'faible')"""))
def demand_list(spark, sf):
    return T.demand_list(S.search_interest(spark, sf), T.at_week(snapshots(spark, sf), WEEK))
