"""Ingest, sinks and composite reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from shelfwave.functions import dates as D, numbers as N
from shelfwave.operators import catalog as C, gaps as G, ingest as I, shelf as H
from shelfwave.plans import reports as R
from shelfwave.plans.catalogue import trend_queries as _trends  # noqa: F401  registers what sql_of names
from shelfwave.plans.catalogue.shared import WEEK, WEEKS, snapshots
from shelfwave.plans.catalogue.shelf_queries import (ACTIVE, BASE, COVERAGE_TYPED, GAP_KIND, GAP_SNAPS, ITEM_SELECT, ITEMS, RULES, SCOPE, SINCE,
                                                     gap_snapshots, scope, tables)
from shelfwave.plans.oracle_views import with_views
from shelfwave.plans.registry import query, sql_of
from shelfwave.rules import Rules
from shelfwave.session import cut_lineage
from shelfwave.sources import samples as S, sinks
from shelfwave.sources.tables import UNIQUE_KEYS

LABELS = {"color": "Couleur", "shape": "Forme", "material": "Matière"}


# --- ingest ----------------------------------------------------------------------------------------

@query("new_documents", with_views("docs", """
SELECT 'doc:' || k AS url, substr(arg_min(repeat('t', 490) || s, s), 1, 500) AS title FROM (SELECT l_orderkey * 2 AS k, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS s FROM lineitem)
WHERE 'doc:' || k NOT IN (SELECT url FROM docs) GROUP BY k"""))
def new_documents(spark, sf):
    line = S.load(spark, sf, "lineitem")
    seq = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    batch = line.select(F.concat(F.lit("doc:"), F.col("l_orderkey") * 2).alias("url"), F.concat(F.repeat(F.lit("t"), F.lit(490)), seq.cast("string")).alias("title"), seq.alias("seq"))
    return I.new_documents(batch, S.documents(spark, sf)).select("url", F.col("title"))


@query("source_upsert", with_views("sources", """
SELECT url, kind, active FROM sources UNION ALL SELECT 'https://store' || k || '.example', 'press', true FROM (SELECT DISTINCT c_custkey AS k FROM customer)
WHERE 'https://store' || k || '.example' NOT IN (SELECT url FROM sources)"""))
def source_upsert(spark, sf):
    wanted = S.load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("press").alias("kind"), F.concat(F.lit("https://store"), F.col("c_custkey"), F.lit(".example")).alias("url"),
                                                  F.lit("fr").alias("lang"), F.lit(None).cast("string").alias("country"))
    return I.with_sources(S.sources(spark, sf), wanted).select("url", "kind", "active")


@query("listed_sources", with_views("sources", """
WITH n AS (SELECT id, kind, CASE WHEN kind = 'press' THEN id % 3 = 0 ELSE active END AS active, active AS was FROM sources) SELECT id, kind, active, active <> was AS changed FROM n"""))
def listed_sources(spark, sf):
    rows = S.sources(spark, sf)
    return I.sync_listed_sources(rows, rows.where(F.pmod("id", F.lit(3)) == 0)).select("id", "kind", "active", "changed")


def sitemaps(spark, sf):
    """Sitemap texts of at most a thousand entries, an entry per order."""
    o = S.load(spark, sf, "orders")
    entry = F.concat(F.lit("<url>\n <loc> https://s.example/"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "news/").otherwise("shop/"), F.lit("a-b-"), F.col("o_orderkey"), F.lit("?x=1&amp;y=2 </loc>"),
                     F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.concat(F.lit("<lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "T10:30:00Z").otherwise(""), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    return o.groupBy(F.pmod("o_custkey", F.lit(10)).cast("long").alias("source_id"), F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(
        F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), ""), F.lit("</urlset>")).alias("xml"))


LOC = "'https://s.example/' || CASE WHEN o_orderkey % 2 = 0 THEN 'news/' ELSE 'shop/' END || 'a-b-' || o_orderkey || '?x=1&y=2'"
ENTRY = f"""en AS (SELECT o_custkey % 10 AS source_id, o_orderkey, {LOC} AS loc, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL '10 hours 30 minutes' ELSE INTERVAL '0 hours' END END AS lastmod FROM orders)"""


@query("sitemap_entries", f"WITH {ENTRY} SELECT source_id, loc, strftime(lastmod, '%Y-%m-%d %H:%M') AS lastmod FROM en")
def sitemap_entries(spark, sf):
    return I.sitemap_entries(sitemaps(spark, sf)).select("source_id", "loc", F.date_format("lastmod", "yyyy-MM-dd HH:mm").alias("lastmod"))


def ordered_entries(spark, sf):
    """Entries with a position that is unique in their source."""
    return I.sitemap_entries(sitemaps(spark, sf)).withColumn("pos", F.regexp_extract("loc", r"a-b-(\d+)", 1).cast("long"))


def nested_sitemaps(spark, sf):
    """(loc, xml): the sitemap texts under two levels of indexes. Indexes name themselves and each other again, one child was never landed, and every fifth
    text is named by none."""
    leaves = sitemaps(spark, sf).select("source_id", "part", F.concat(F.lit("https://s.example/map?s="), "source_id", F.lit("&p="), "part").alias("loc"), "xml")
    refs = lambda locs: F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(locs, lambda c: F.concat(F.lit("<sitemap> <loc> "), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></sitemap>"))), ""), F.lit("</sitemapindex>"))
    root = lambda s: F.concat(F.lit("https://s.example/root?s="), s)
    middle = (leaves.where(F.pmod("part", F.lit(5)) != 4).groupBy("source_id", F.concat(F.lit("https://s.example/index?s="), "source_id", F.lit("&k="), F.pmod("part", F.lit(3))).alias("loc"))
              .agg(F.collect_list(F.col("loc")).alias("locs")).select("source_id", "loc", refs(F.concat("locs", F.array(root(F.col("source_id")), F.col("loc"), F.lit("https://s.example/lost")))).alias("xml")))
    roots = middle.groupBy("source_id").agg(F.collect_list("loc").alias("locs")).select("source_id", root(F.col("source_id")).alias("loc"), refs("locs").alias("xml"))
    return roots.select("source_id", "loc"), leaves.select("loc", "xml").unionByName(middle.select("loc", "xml")).unionByName(roots.select("loc", "xml"))


@query("sitemap_tree", f"WITH {ENTRY} SELECT source_id, loc, strftime(lastmod, '%Y-%m-%d %H:%M') AS lastmod FROM en WHERE o_orderkey // 1000 % 5 <> 4")
def sitemap_tree(spark, sf):
    roots, landed = nested_sitemaps(spark, sf)
    return I.sitemap_entries(I.sitemap_texts(roots, landed)).select("source_id", "loc", F.date_format("lastmod", "yyyy-MM-dd HH:mm").alias("lastmod"))


@query("sitemap_documents", f"""
WITH {ENTRY}, c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY lastmod DESC, o_orderkey) AS checked FROM en WHERE lastmod >= TIMESTAMP '2001-03-01' AND contains(loc, 'news/') AND o_orderkey % 4 <> 0),
p AS (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY checked) AS added FROM c WHERE checked <= 40 AND o_orderkey % 7 <> 0 AND NOT o_orderkey % 6 = 2)
SELECT source_id, loc, CASE WHEN o_orderkey % 8 = 6 THEN 'T' || o_orderkey ELSE 'a b ' || o_orderkey || '?x=1&y=2' END AS title FROM p WHERE added <= 15""")
def sitemap_documents(spark, sf):
    orders = S.load(spark, sf, "orders")
    key = F.col("o_orderkey")
    loc = F.concat(F.lit("https://s.example/"), F.when(F.pmod(key, F.lit(2)) == 0, "news/").otherwise("shop/"), F.lit("a-b-"), key, F.lit("?x=1&y=2"))
    configs = S.sources(spark, sf).select(F.col("id").alias("source_id"), D.instant(datetime(2001, 3, 1)).alias("since"), F.array(F.lit("news/")).alias("include"), F.lit(40).alias("max_checked"), F.lit(15).alias("max_new"))
    stored = orders.where(F.pmod(key, F.lit(4)) == 0).select(loc.alias("url"))
    pages = orders.where(F.pmod(key, F.lit(7)) != 0).select(loc.alias("loc"), F.when(F.pmod(key, F.lit(6)) == 2, D.instant(datetime(1999, 1, 1))).alias("page_date"),
                                                           F.when(F.pmod(key, F.lit(8)) == 6, F.concat(F.lit("T"), key)).alias("title"), F.lit("new frames").alias("text"))
    rows = I.sitemap_documents(I.sitemap_candidates(ordered_entries(spark, sf), configs, stored), pages, r"\bframes?\b")
    return rows.select("source_id", "loc", "title")


def archive(spark, sf):
    key = F.col("o_orderkey")
    return S.load(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(10)).alias("source_id"), key.alias("pos"),
                                              F.when(F.pmod(key, F.lit(3)) == 0, F.col("o_orderdate")).cast("timestamp").alias("lastmod"),
                                              F.when(F.pmod(key, F.lit(11)) != 0, F.col("o_orderdate")).cast("timestamp").alias("page_date"))


ARCHIVE = """it AS (SELECT o_custkey % 10 AS source_id, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS published FROM orders
  WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '1998-06-01')),
ol AS (SELECT *, coalesce(published < TIMESTAMP '1998-06-01', false) AS old FROM it),
rn AS (SELECT *, sum(CASE WHEN old THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS run FROM ol),
sp AS (SELECT *, max(CASE WHEN run = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pos) AS stopped FROM rn)"""


@query("archive_items", f"WITH {ARCHIVE} SELECT source_id, pos FROM ol WHERE NOT old")
def archive_items(spark, sf):
    return I.archive_items(archive(spark, sf), datetime(1998, 6, 1)).select("source_id", "pos")


@query("archive_items_until_old", f"WITH {ARCHIVE} SELECT source_id, pos FROM sp WHERE NOT old AND stopped = 0")
def archive_items_until_old(spark, sf):
    return I.archive_items(archive(spark, sf), datetime(1998, 6, 1), 5).select("source_id", "pos")


@query("parsed_dates", """
SELECT o_orderkey, strftime(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL '9 hours' WHEN 2 THEN o_orderdate WHEN 3 THEN NULL ELSE o_orderdate + INTERVAL '7 hours' END, '%Y-%m-%d %H:%M') AS iso,
  strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '8 hours' END, '%Y-%m-%d %H:%M') AS compact FROM orders""")
def parsed_dates(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(F.pmod(k, F.lit(5)) == 0, day).when(F.pmod(k, F.lit(5)) == 1, F.concat(day, F.lit("T09:00:00Z"))).when(F.pmod(k, F.lit(5)) == 2, F.concat(day, F.lit(" at noon")))
            .when(F.pmod(k, F.lit(5)) == 3, "2001-13-45").otherwise(F.concat(F.lit(" "), day, F.lit("T09:00:00+02:00"))))
    compact = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.pmod(k, F.lit(2)) == 0, "T080000Z").otherwise("080000"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return S.load(spark, sf, "orders").select("o_orderkey", show(D.parse_iso(text)).alias("iso"), show(D.parse_compact(compact)).alias("compact"))


@query("interest_upsert", with_views("search", """
WITH b AS (SELECT * FROM search WHERE id % 3 = 0)
SELECT s.dimension, s.dimension || ':' || s.code AS code, s.lang, s.geo, CAST(s.wk AS VARCHAR) AS week, round(CASE WHEN s.id % 3 = 0 THEN s.val + 1 ELSE s.val END, 6) AS value,
  CASE WHEN s.id % 3 = 0 THEN 'new ' || s.dimension || ':' || s.code ELSE s.code END AS keyword FROM search s"""))
def interest_upsert(spark, sf):
    """The key has no dimension, so each code names its own."""
    rows = S.search_interest(spark, sf).withColumn("code", F.concat_ws(":", "dimension", "code"))
    batch = rows.where(F.pmod("id", F.lit(3)) == 0).withColumn("value", F.col("value") + 1).withColumn("keyword", F.concat(F.lit("new "), F.col("code"))).withColumn("id", F.lit(-1).cast("long"))
    return I.upserted_interest(rows, batch).select("dimension", "code", "lang", "geo", F.col("week").cast("string").alias("week"), F.round("value", 6).alias("value"), "keyword")


@query("demo_free_mentions", with_views("ment docs", "SELECT ment.id FROM ment WHERE document_id NOT IN (SELECT id FROM docs WHERE is_demo)"))
def demo_free_mentions(spark, sf):
    return I.without_demo(S.documents(spark, sf), S.mentions(spark, sf), S.search_interest(spark, sf))[1].select("id")


@query("demo_free_documents", with_views("docs", "SELECT id FROM docs WHERE NOT is_demo"))
def demo_free_documents(spark, sf):
    return I.without_demo(S.documents(spark, sf), S.mentions(spark, sf), S.search_interest(spark, sf))[0].select("id")


@query("demo_free_interest", with_views("search", "SELECT id, dimension, code, lang, geo, CAST(wk AS VARCHAR) AS week FROM search WHERE id % 50 <> 0"))
def demo_free_interest(spark, sf):
    rows = I.without_demo(S.documents(spark, sf), S.mentions(spark, sf), S.search_interest(spark, sf))[2]
    return rows.select("id", "dimension", "code", "lang", "geo", F.col("week").cast("string").alias("week"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return I.duplicate_keys(S.load(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("duplicate_tag_keys", with_views("tags", """
SELECT product_id, dimension, code, supplier_code, 2 AS rows FROM tags WHERE dimension = 'material'"""))
def duplicate_tag_keys(spark, sf):
    tags = S.product_tags(spark, sf).select("product_id", "dimension", "code", "supplier_code")
    return I.duplicate_keys(tags.unionByName(tags.where(F.col("dimension") == "material")), UNIQUE_KEYS["product_tags"])


# --- text and export -------------------------------------------------------------------------------

@query("french_numbers", """
SELECT DISTINCT l_quantity AS q, replace(printf('%.1f', l_quantity), '.', ',') AS one, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole,
  CASE WHEN l_quantity > 25 THEN '+' WHEN l_quantity < 25 THEN '−' ELSE '' END || CAST(abs(CAST(l_quantity AS BIGINT) - 25) AS VARCHAR) || chr(8239) || '%' AS pct FROM lineitem""")
def french_numbers(spark, sf):
    q = F.col("l_quantity")
    return S.load(spark, sf, "lineitem").select(q).distinct().select(q.alias("q"), N.fr_number(q).alias("one"), N.fr_integer(q).alias("whole"), N.fr_percent((q - 25) / 100, True).alias("pct"))


EXPORT = with_views("snaps dict", """
WITH r AS (SELECT s.*, label, sum(CAST(round(mentions * 10) AS BIGINT)) OVER () / 10 AS t FROM snaps s JOIN dict USING (dimension, code) WHERE wk = DATE '2001-08-20' AND dimension = 'PROMO')
SELECT label AS attribut, code AS code, CAST(wk AS VARCHAR) AS semaine, replace(printf('%.1f', mentions), '.', ',') AS mentions,
  replace(printf('%.1f', round_even(mentions * 100 / t * 10, 0) / 10), '.', ',') AS part, CAST(CAST(round_even(momentum * 100, 0) AS BIGINT) AS VARCHAR) AS momentum,
  CASE status WHEN 'en_hausse' THEN 'En hausse' WHEN 'au_pic' THEN 'Au pic' WHEN 'stable' THEN 'Stable' WHEN 'en_baisse' THEN 'En baisse' ELSE 'Peu de données' END AS statut,
  coalesce(CAST(CAST(round_even(decline_share * 100, 0) AS BIGINT) AS VARCHAR), '') AS recul, coalesce(replace(printf('%.1f', search), '.', ','), '') AS recherche FROM r""")


@query("spreadsheet_export", EXPORT)
def spreadsheet_export(spark, sf):
    rows = sinks.export_rows(snapshots(spark, sf), S.dictionary(spark, sf), "PROMO", date(2001, 8, 20))
    names = ["attribut", "code", "semaine", "mentions", "part", "momentum", "statut", "recul", "recherche"]
    return rows.select(*[F.col(f"`{h}`").alias(n) for h, n in zip(sinks.CSV_HEADER, names, strict=True)])


# --- reports ---------------------------------------------------------------------------------------

@query("overview_leaders", with_views("snaps dict", """
WITH sp AS (SELECT dimension, code, string_agg(CAST(CAST(round(mentions * 10) AS BIGINT) AS VARCHAR), '|' ORDER BY wk) AS spark FROM snaps WHERE wk >= DATE '2001-08-06' GROUP BY 1, 2)
SELECT s.dimension, s.code, place, label, hex, spark FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY status = 'faible', momentum DESC, code) AS place FROM snaps
  WHERE wk = DATE '2001-09-24' AND mentions > 0 AND status <> 'en_baisse') s JOIN sp USING (dimension, code) JOIN dict USING (dimension, code) WHERE place <= 3"""))
def overview_leaders(spark, sf):
    frames = R.overview(S.documents(spark, sf), S.mentions(spark, sf), S.sources(spark, sf), snapshots(spark, sf), S.dictionary(spark, sf), WEEK, 3)
    return frames["rising"].select("dimension", "code", "place", "label", "hex", F.array_join(F.transform("spark", lambda v: F.round(v * 10).cast("long").cast("string")), "|").alias("spark"))


@query("dimension_trends", with_views("snaps dict", """
WITH own AS (SELECT * FROM snaps WHERE dimension = 'ECONOMY'), l AS (SELECT * FROM own WHERE wk = DATE '2001-09-24'), t AS (SELECT sum(CAST(round(mentions * 10) AS BIGINT)) AS t FROM l),
a AS (SELECT code, string_agg(CAST(CAST(round(mentions * 10) AS BIGINT) AS VARCHAR), '|' ORDER BY wk) AS mentions, string_agg(coalesce(CAST(CAST(floor(search * 1000 + 0.5) AS BIGINT) AS VARCHAR), '-'), '|' ORDER BY wk) AS search FROM own GROUP BY code)
SELECT 'ECONOMY' AS dimension, a.code, a.mentions, a.search, momentum, status, tone, decline_share, l.mentions AS current, round(CAST(round(l.mentions * 10) AS BIGINT) / t, 6) AS share,
  CASE WHEN status = 'en_baisse' THEN CASE WHEN momentum <= -0.25 THEN 'volume' ELSE 'tonalite' END END AS decline_reason, label, hex, multicolor
FROM a JOIN l USING (code) CROSS JOIN t JOIN dict ON dict.dimension = 'ECONOMY' AND dict.code = a.code"""))
def dimension_trends(spark, sf):
    joined = lambda c, digits: F.array_join(F.transform(c, lambda v: F.coalesce(F.floor(v * 10 ** digits + 0.5).cast("long").cast("string"), F.lit("-"))), "|").alias(c)
    return R.dimension_trends(snapshots(spark, sf), S.dictionary(spark, sf), "ECONOMY", WEEK, WEEKS).select(
        "dimension", "code", joined("mentions", 1), joined("search", 3), "momentum", "status", "tone", "decline_share", "current", F.round("share", 6).alias("share"), "decline_reason", "label", "hex", "multicolor")


@query("detail_search", with_views("search", """
WITH v AS (SELECT wk, arg_max(val, id) FILTER (geo <> '') AS fr, arg_max(val, id) FILTER (geo = '') AS world FROM search WHERE code = 'red' GROUP BY wk)
SELECT CAST(g.wk AS VARCHAR) AS week, round_even(fr * 10, 0) / 10 AS fr, round_even(world * 10, 0) / 10 AS world FROM (SELECT CAST(unnest(generate_series(DATE '2001-07-09', DATE '2001-09-24', INTERVAL 7 DAY)) AS DATE) AS wk) g LEFT JOIN v USING (wk)"""))
def detail_search(spark, sf):
    return R.detail_search(S.search_interest(spark, sf), "red", WEEK, WEEKS).withColumn("week", F.col("week").cast("string"))


def detail(spark, sf):
    products, tags, sources = tables(spark, sf)
    return R.attribute_detail(S.documents(spark, sf), S.mentions(spark, sf), sources, snapshots(spark, sf), S.search_interest(spark, sf), products, tags,
                              S.store_crawls(spark, sf), S.dictionary(spark, sf), "PROMO", "red", WEEK, S.CATALOG_NOW)


@query("attribute_detail", with_views("snaps", """
WITH s AS (SELECT * FROM snaps WHERE dimension = 'PROMO' AND code = 'red'), l AS (SELECT list(mentions ORDER BY wk) AS m FROM s),
t AS (SELECT sum(CAST(round(mentions * 10) AS BIGINT)) / 10 AS t FROM snaps WHERE dimension = 'PROMO' AND wk = DATE '2001-09-24')
SELECT momentum, status, mentions AS this_week, round(mentions / CASE WHEN t = 0 THEN 1 ELSE t END, 4) AS share, round_even((m[8] + m[9] + m[10] + m[11]) / 4 * 100, 0) / 100 AS avg_4w FROM s, l, t WHERE wk = DATE '2001-09-24'"""))
def attribute_detail(spark, sf):
    frames = detail(spark, sf)
    keyed = frames["current"].select("dimension", "code", "momentum", "status").join(frames["stats"].select("dimension", "code", "this_week", "avg_4w"), ["dimension", "code"])
    return keyed.join(frames["share"].select("dimension", "code", F.round("share", 4).alias("share")), ["dimension", "code"]).select("momentum", "status", "this_week", "share", "avg_4w")


# --- the other frames of the composite reports ------------------------------------------------------

def overview_frames(spark, sf):
    return R.overview(S.documents(spark, sf), S.mentions(spark, sf), S.sources(spark, sf), snapshots(spark, sf), S.dictionary(spark, sf), WEEK, 3)


@query("overview_counters", sql_of("header_counters"))
def overview_counters(spark, sf):
    return overview_frames(spark, sf)["counters"]


@query("overview_declining", with_views("snaps dict", """
WITH sp AS (SELECT dimension, code, string_agg(CAST(CAST(round(mentions * 10) AS BIGINT) AS VARCHAR), '|' ORDER BY wk) AS spark FROM snaps WHERE wk >= DATE '2001-08-06' GROUP BY 1, 2)
SELECT s.dimension, s.code, label, CASE WHEN momentum <= -0.25 THEN 'volume' ELSE 'tonalite' END AS decline_reason, spark FROM (SELECT * FROM snaps WHERE wk = DATE '2001-09-24' AND status = 'en_baisse'
  ORDER BY least(momentum, -coalesce(decline_share, 0.0)), dimension, code LIMIT 3) s JOIN sp USING (dimension, code) JOIN dict USING (dimension, code)"""))
def overview_declining(spark, sf):
    rows = overview_frames(spark, sf)["declining"]
    return rows.select("dimension", "code", "label", "decline_reason", F.array_join(F.transform("spark", lambda v: F.round(v * 10).cast("long").cast("string")), "|").alias("spark"))


def retail_frames(spark, sf):
    return R.retail_overview(gap_snapshots(spark, sf), *tables(spark, sf), S.dictionary(spark, sf), WEEK)


@query("retail_overview_stores", sql_of("store_summary"))
def retail_overview_stores(spark, sf):
    return retail_frames(spark, sf)["stores"].select("store", "products", F.to_date("updated").cast("string").alias("updated"))


@query("retail_overview_types", sql_of("shelf_products_by_type"))
def retail_overview_types(spark, sf):
    return retail_frames(spark, sf)["types"]


@query("retail_overview_skipped", sql_of("skipped_dimensions"))
def retail_overview_skipped(spark, sf):
    return retail_frames(spark, sf)["skipped"].withColumn("unmapped_share", F.round("unmapped_share", 6))


def monitor_frames(spark, sf):
    products, tags, sources = tables(spark, sf)
    return R.catalog_monitor(S.stores(spark, sf), sources, S.store_crawls(spark, sf), products, tags, S.dictionary(spark, sf), S.CATALOG_NOW)


@query("catalog_monitor_totals", f"SELECT CAST(sum(new) AS BIGINT) AS new_total, CAST(sum(retired) AS BIGINT) AS retired_total FROM ({sql_of('new_by_store')})")
def catalog_monitor_totals(spark, sf):
    return monitor_frames(spark, sf)["totals"]


@query("retail_overview_gaps", with_views("prod tags sources snaps dict", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}, {COVERAGE_TYPED}, {GAP_SNAPS}, {GAP_KIND}
SELECT shelf, kind, gk.dimension, gk.code, sku FROM gk WHERE kind IS NOT NULL"""))
def retail_overview_gaps(spark, sf):
    frames = R.retail_overview(gap_snapshots(spark, sf), *tables(spark, sf), S.dictionary(spark, sf), WEEK, RULES)
    return frames["gaps"].select("shelf", "kind", "dimension", "code", "sku")


@query("catalog_monitor_top", with_views("prod crawls sources tags", f"""
WITH {SCOPE}, a AS (SELECT prod.id, first_seen_at > start AND first_seen_at >= {SINCE} AS fresh FROM prod JOIN sc USING (source_id) WHERE is_active),
t AS (SELECT DISTINCT product_id, dimension, code FROM tags WHERE dimension IN ('shape', 'color', 'material'))
SELECT dimension, code, count(*) FILTER (fresh) AS new FROM a JOIN t ON t.product_id = a.id GROUP BY 1, 2 ORDER BY new DESC, list_position(['shape', 'color', 'material'], dimension), code LIMIT 6"""))
def catalog_monitor_top(spark, sf):
    products, tags, sources = tables(spark, sf)
    frames = R.catalog_monitor(S.stores(spark, sf), sources, S.store_crawls(spark, sf), products, tags, S.dictionary(spark, sf), S.CATALOG_NOW)
    return frames["top"].select("dimension", "code", "new")


LINE = """CASE dimension WHEN 'PROMO' THEN 'Promo' ELSE dimension END || ' | ' || label || ' | ' || printf('%.1f', mentions) || ' | ' || CAST(round_even(v4, 0) AS BIGINT) || ' | ' ||
  CASE WHEN momentum < 0 THEN '-' ELSE '+' END || CAST(abs(round_even(momentum * 100, 0)) AS BIGINT) || '% | ' || status || ' | ' || coalesce(CAST(round_even(decline_share * 100, 0) AS BIGINT) || '%', 'n/d')"""


@query("press_brief", with_views("snaps dict ment docs", f"""
WITH v AS (SELECT dimension, code, sum(CAST(round(mentions * 10) AS BIGINT)) / 10 AS v4 FROM snaps WHERE wk > DATE '2001-07-23' AND wk <= DATE '2001-08-20' GROUP BY 1, 2),
r AS (SELECT s.*, label, round(v4, 6) AS v4, {LINE.replace('v4', 'round(v4, 6)')} AS line FROM snaps s JOIN v USING (dimension, code) JOIN dict USING (dimension, code) WHERE wk = DATE '2001-08-20'),
k AS (SELECT 1 AS section, row_number() OVER (ORDER BY momentum DESC, dimension, code) AS ord, line FROM r WHERE (mentions > 0 OR coalesce(s, 0) <> 0) AND status <> 'faible'
  UNION ALL SELECT 2, row_number() OVER (ORDER BY momentum DESC, dimension, code), line FROM r WHERE dimension = 'PROMO' AND status IN ('en_hausse', 'au_pic') AND v4 >= 10
  UNION ALL SELECT 3, row_number() OVER (ORDER BY momentum DESC, dimension, code), line FROM r WHERE (mentions > 0 OR coalesce(s, 0) <> 0) AND status = 'faible'
  UNION ALL SELECT 4, row_number() OVER (ORDER BY day DESC, summary_fr), '- ' || summary_fr FROM (SELECT summary_fr, max(occurred_on) AS day FROM docs JOIN ment ON document_id = docs.id
    WHERE occurred_on >= DATE '2001-08-20' AND summary_fr IS NOT NULL GROUP BY 1 ORDER BY day DESC, summary_fr LIMIT 12))
SELECT section, CAST(ord AS BIGINT) AS ord, line FROM k
UNION ALL SELECT section, 0, title FROM (VALUES (1, '{R.SCORES_TITLE}'), (2, '{R.MUST_CITE_TITLE.format(Rules().must_cite_min // 10)}'), (3, '{R.WEAK_TITLE}'), (4, 'Extraits de sources:')) t(section, title)
  WHERE section IN (SELECT section FROM k)""".replace("coalesce(s, 0)", "coalesce(search, 0)")))
def press_brief(spark, sf):
    return R.press_brief(snapshots(spark, sf), S.mentions(spark, sf), S.documents(spark, sf), S.dictionary(spark, sf), date(2001, 8, 20), {"PROMO": "Promo"}, Rules(must_cite_dimension="PROMO"))


@query("shelf_brief", with_views("prod tags sources", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}, {COVERAGE_TYPED},
pc AS (SELECT shelf, dimension, code, string_agg(p || ' ' || currency, ' / ' ORDER BY currency) AS money FROM (SELECT shelf, dimension, code, currency, CAST(round_even(round_even(avg(price) * 100, 0) / 100, 0) AS BIGINT) AS p FROM rows_typed WHERE price > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
b AS (SELECT it.*, tagged, money, row_number() OVER (PARTITION BY shelf, dimension ORDER BY sku DESC, code) AS ord FROM it JOIN dm USING (shelf, dimension) LEFT JOIN pc USING (shelf, dimension, code) WHERE comparable)
SELECT shelf, dimension, ord, CASE dimension WHEN 'color' THEN 'Couleur' WHEN 'shape' THEN 'Forme' ELSE 'Matière' END || ' | ' || code || ' | ' || sku || ' | ' || CAST(round_even(sku / tagged * 100, 0) AS BIGINT) || ' % | ' || money || ' | ' ||
  coalesce(CASE WHEN round(relative_depth, 4) < 0 THEN '-' ELSE '+' END || CAST(abs(round_even(round(relative_depth, 4) * 100, 0)) AS BIGINT) || ' pts vs habituelle', 'n/d') AS line FROM b WHERE ord <= 6
UNION ALL SELECT shelf, dimension, 0, CASE dimension WHEN 'color' THEN 'Couleur' WHEN 'shape' THEN 'Forme' WHEN 'material' THEN 'Matière' ELSE dimension END || ' : couverture insuffisante (' ||
  CASE WHEN tagged < 20 THEN tagged || ' références renseignées' ELSE 'vocabulaire des boutiques non reconnu pour ' || CAST(round_even(unmapped_share * 100, 0) AS BIGINT) || ' % des valeurs' END || '), pas de comparaison.' FROM dm WHERE NOT comparable"""))
def shelf_brief(spark, sf):
    cells = cut_lineage(H.shelf(*tables(spark, sf), by_type=True))  # landed once, as items, prices and dimensions all read it
    rows = R.shelf_lines(H.shelf_items(cells), H.shelf_prices(cells), H.shelf_dimensions(cells, True), S.dictionary(spark, sf), LABELS)
    return rows.withColumn("ord", F.col("ord").cast("long"))


@query("gap_brief", with_views("prod tags sources snaps", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}, {COVERAGE_TYPED}, {GAP_SNAPS}, {GAP_KIND},
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'opportunity' THEN momentum ELSE share END DESC, dimension, code, shelf) AS ord FROM gk WHERE kind IS NOT NULL),
x AS (SELECT *, CASE shelf WHEN 'sun' THEN 'solaire' ELSE 'optique' END AS ty, code || ' (' || CASE dimension WHEN 'color' THEN 'Couleur' ELSE 'Forme' END || ')' AS nm,
  CASE WHEN momentum < 0 THEN '-' ELSE '+' END || CAST(abs(round_even(momentum * 100, 0)) AS BIGINT) || '%' AS mo, CAST(round_even(share * 100, 0) AS BIGINT) || ' %' AS sh FROM o WHERE ord <= 3)
SELECT kind, ord, CASE WHEN kind = 'opportunity' THEN 'Opportunité (' || ty || ') : ' || nm || ' — ' || CASE status WHEN 'en_hausse' THEN 'en hausse' ELSE 'au pic' END || ' dans la presse (' || mo || '), ' || sku || ' référence(s) en rayon (' || sh || ')'
  ELSE 'Risque de stock (' || ty || ') : ' || nm || ' — en baisse dans la presse (' || mo || '), ' || sku || ' références en rayon (' || sh || ')' ||
  CASE WHEN clearance THEN ', déstockage : remise +' || CAST(abs(round_even(relative_depth * 100, 0)) AS BIGINT) || ' pts vs habituelle' ELSE '' END END AS line FROM x"""))
def gap_brief(spark, sf):
    rows = G.gaps_by_type(gap_snapshots(spark, sf), *tables(spark, sf), WEEK, RULES)
    return R.gap_lines(rows, S.dictionary(spark, sf), LABELS).withColumn("ord", F.col("ord").cast("long"))


@query("catalog_brief", with_views("prod crawls sources tags", f"""
WITH {SCOPE}, a AS (SELECT prod.id, first_seen_at > start AND first_seen_at >= {SINCE} AS fresh FROM prod JOIN sc USING (source_id) WHERE is_active),
t AS (SELECT DISTINCT product_id, dimension, code FROM tags WHERE dimension IN ('shape', 'color', 'material')), n AS (SELECT count(*) FILTER (fresh) AS f, count(*) AS c FROM a),
g AS (SELECT dimension, code, count(*) FILTER (fresh) AS new, count(*) AS cat FROM a JOIN t ON t.product_id = a.id GROUP BY 1, 2 HAVING count(*) FILTER (fresh) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY new DESC, code) AS ord FROM g, n WHERE f >= 10)
SELECT dimension, ord, CASE dimension WHEN 'color' THEN 'Couleur' WHEN 'shape' THEN 'Forme' ELSE 'Matière' END || ' | ' || code || ' | ' || new || ' | ' || CAST(round_even(round(new / f, 4) * 100, 0) AS BIGINT) || ' % | ' || CAST(round_even(round(cat / c, 4) * 100, 0) AS BIGINT) || ' %' AS line FROM r WHERE ord <= 4"""))
def catalog_brief(spark, sf):
    products, tags, _ = tables(spark, sf)
    return R.catalog_lines(products, tags, scope(spark, sf), S.dictionary(spark, sf), LABELS, S.CATALOG_NOW).withColumn("ord", F.col("ord").cast("long"))


@query("catalog_store_line", with_views("prod crawls sources", f"""
WITH {SCOPE}, x AS (SELECT store, count(*) FILTER (is_active AND first_seen_at > start AND first_seen_at >= {SINCE}) AS new, count(*) FILTER (NOT is_active) AS retired
FROM prod JOIN sc USING (source_id) WHERE is_active OR dropped_at >= {SINCE} GROUP BY store)
SELECT string_agg(store || ' : ' || new || ' nouveauté(s), ' || retired || ' retirée(s)', ' ; ' ORDER BY store) AS line FROM x"""))
def catalog_store_line(spark, sf):
    return R.catalog_store_line(C.new_by_store(S.products(spark, sf), scope(spark, sf), S.CATALOG_NOW))
