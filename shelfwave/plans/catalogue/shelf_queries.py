"""Shelf, gaps, pairings, presence and catalog status."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwave.operators import catalog as C, gaps as G, pairings as P, presence as R, shelf as H
from shelfwave.operators.trends import at_week
from shelfwave.plans.catalogue.shared import WEEK, snapshots
from shelfwave.plans.oracle_views import with_views
from shelfwave.plans.registry import query
from shelfwave.rules import Rules
from shelfwave.sources import samples as S

RULES = Rules(opportunity_share=0.2, risk_share=0.1, clearance=0.001)


def tables(spark, sf):
    return S.products(spark, sf), S.product_tags(spark, sf), S.sources(spark, sf)


ACTIVE = """act AS (SELECT prod.*, sources.name AS store, country, kind FROM prod JOIN sources ON sources.id = prod.source_id WHERE is_active),
tn AS (SELECT * FROM act WHERE country = 'TN')"""
BASE = """bl AS (SELECT source_id, avg(md) AS baseline FROM {0} GROUP BY source_id HAVING bool_or(coalesce(list_price, 0) <> 0))"""


@query("active_products", with_views("prod sources", f"WITH {ACTIVE} SELECT id, source_id, store, name, round(price, 4) AS price FROM tn"))
def active_products(spark, sf):
    products, _, sources = tables(spark, sf)
    return H.active_products(products, sources, "TN").select("id", "source_id", "store", "name", F.round("price", 4).alias("price"))


@query("products_of_type", with_views("prod tags", """
SELECT id, name FROM prod WHERE is_active AND id IN (SELECT product_id FROM tags WHERE dimension = 'product_type' AND code = 'sun')"""))
def products_of_type(spark, sf):
    products, tags, _ = tables(spark, sf)
    return H.of_type(products.where("is_active"), tags, "sun").select("id", "name")


@query("creator_sources", with_views("sources", """
SELECT id, coalesce(country, '') <> '' AND country <> 'TN' AS creator FROM sources WHERE coalesce(country, '') <> ''
UNION ALL SELECT id, false FROM sources WHERE coalesce(country, '') = ''"""))
def creator_sources(spark, sf):
    return S.sources(spark, sf).select("id", F.coalesce(H.is_creator(F.col("country")), F.lit(False)).alias("creator"))


@query("store_markdown_baselines", with_views("prod sources", f"""
WITH {ACTIVE}, {BASE.format('act')} SELECT source_id, round(baseline, 6) AS baseline FROM bl"""))
def store_markdown_baselines(spark, sf):
    products, _, sources = tables(spark, sf)
    return H.store_baselines(H.active_products(products, sources)).select("source_id", F.round("baseline", 6).alias("baseline"))


@query("attribute_markdown", with_views("prod tags sources", f"""
WITH {ACTIVE}, {BASE.format('act')}
SELECT 'color' AS dimension, 'red' AS code, count(*) AS compared, count(*) FILTER (md > 0) AS discounted,
  round(count(*) FILTER (md > 0) / count(*), 4) AS share_discounted, round(avg(md) FILTER (md > 0), 4) AS avg_depth,
  round(avg(md - baseline), 4) + 0.0 AS relative_depth
FROM act JOIN bl USING (source_id) WHERE id IN (SELECT product_id FROM tags WHERE dimension = 'color' AND code = 'red')"""))
def attribute_markdown(spark, sf):
    return H.attribute_markdown(*tables(spark, sf), "color", "red")


ITEMS = """t AS (SELECT DISTINCT product_id, dimension, code FROM tags WHERE dimension IN ('shape', 'color', 'material', 'style')),
ty AS (SELECT product_id, code AS shelf FROM tags WHERE dimension = 'product_type'),
rows_all AS (SELECT 'all' AS shelf, t.dimension, t.code, tn.* FROM tn JOIN t ON t.product_id = tn.id),
rows_typed AS (SELECT ty.shelf, t.dimension, t.code, tn.* FROM tn JOIN t ON t.product_id = tn.id JOIN ty ON ty.product_id = tn.id)"""
ITEM_SELECT = """it AS (SELECT shelf, dimension, code, count(DISTINCT r.id) AS sku, nullif(count(bl.source_id), 0) AS compared,
  CASE WHEN count(bl.source_id) > 0 THEN count(*) FILTER (md > 0 AND bl.source_id IS NOT NULL) END AS discounted, avg(md) FILTER (md > 0 AND bl.source_id IS NOT NULL) AS avg_depth,
  avg(md - baseline) AS relative_depth FROM {0} r LEFT JOIN bl USING (source_id) GROUP BY 1, 2, 3),
tg AS (SELECT shelf, dimension, count(DISTINCT id) AS tagged FROM {0} GROUP BY 1, 2)"""


@query("shelf_by_attribute", with_views("prod tags sources", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_all')}
SELECT dimension, code, sku, tagged, round(sku / tagged, 6) AS share, compared, discounted, round(discounted / compared, 4) AS share_discounted,
  round(avg_depth, 4) AS avg_depth, round(relative_depth, 4) + 0.0 AS relative_depth FROM it JOIN tg USING (shelf, dimension)"""))
def shelf_by_attribute(spark, sf):
    return H.shelf_items(H.shelf(*tables(spark, sf))).select("dimension", "code", "sku", "tagged", F.round("share", 6).alias("share"), "compared", "discounted",
                        "share_discounted", "avg_depth", "relative_depth")


@query("shelf_by_type", with_views("prod tags sources", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}
SELECT shelf, dimension, code, sku, tagged, round(sku / tagged, 6) AS share, compared, round(relative_depth, 4) + 0.0 AS relative_depth
FROM it JOIN tg USING (shelf, dimension)"""))
def shelf_by_type(spark, sf):
    return H.shelf_items(H.shelf(*tables(spark, sf), by_type=True)).select("shelf", "dimension", "code", "sku", "tagged", F.round("share", 6).alias("share"), "compared", "relative_depth")


@query("shelf_prices", with_views("prod tags sources", f"""
WITH {ACTIVE}, {ITEMS} SELECT dimension, code, currency, count(*) AS priced, round_even(avg(price) * 100, 0) / 100 AS avg_price FROM rows_all
WHERE price > 0 GROUP BY 1, 2, 3"""))
def shelf_prices(spark, sf):
    return H.shelf_prices(H.shelf(*tables(spark, sf))).select("dimension", "code", "currency", "priced", "avg_price")


COVERAGE = """st AS (SELECT id, 'color' AS dimension FROM tn WHERE p_size % 2 = 0 UNION ALL SELECT id, 'material' FROM tn WHERE p_size % 3 = 0
  UNION ALL SELECT id, 'style' FROM tn WHERE p_size % 5 = 0),
sv AS (SELECT {0} AS shelf, st.dimension, count(*) AS with_value, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.product_id = st.id AND t.dimension = st.dimension)) AS unmapped
  FROM st {1} GROUP BY 1, 2),
gr AS (SELECT shelf, dimension FROM (VALUES {2}) s(shelf) CROSS JOIN (VALUES ('shape'), ('color'), ('material'), ('style')) d(dimension)),
dm AS (SELECT shelf, dimension, coalesce(tagged, 0) AS tagged, coalesce(with_value, 0) AS with_value, coalesce(unmapped, 0) AS unmapped,
  coalesce(unmapped / nullif(with_value, 0), 0.0) AS unmapped_share,
  coalesce(tagged, 0) >= 20 AND coalesce(unmapped / nullif(with_value, 0), 0.0) <= 0.3 AS comparable
  FROM gr LEFT JOIN tg USING (shelf, dimension) LEFT JOIN sv USING (shelf, dimension))"""
COVERAGE_ALL = COVERAGE.format("'all'", "", "('all')")
COVERAGE_TYPED = COVERAGE.format("ty.shelf", "JOIN ty ON ty.product_id = st.id", "('optical'), ('sun')")


@query("vocabulary_coverage", with_views("prod tags sources", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_all')}, {COVERAGE_ALL}
SELECT dimension, tagged, with_value, unmapped, round(unmapped_share, 6) AS unmapped_share, comparable FROM dm"""))
def vocabulary_coverage(spark, sf):
    return H.shelf_dimensions(H.shelf(*tables(spark, sf))).select("dimension", "tagged", "with_value", "unmapped", F.round("unmapped_share", 6).alias("unmapped_share"), "comparable")


@query("store_summary", with_views("prod sources", f"WITH {ACTIVE} SELECT store, count(*) AS products, CAST(CAST(max(seen_at) AS DATE) AS VARCHAR) AS updated FROM tn GROUP BY store"))
def store_summary(spark, sf):
    products, _, sources = tables(spark, sf)
    return H.store_summary(H.active_products(products, sources, "TN")).select("store", "products", F.to_date("updated").cast("string").alias("updated"))


@query("tag_counts", with_views("tags", "SELECT dimension, count(DISTINCT product_id) AS products FROM tags GROUP BY dimension"))
def tag_counts(spark, sf):
    return H.tag_counts(S.product_tags(spark, sf))


# Press rows in shelf terms: one part type stands for the colours, one word for the shapes.
GAP_SNAPS = """gs AS (SELECT 'color' AS dimension, code, status, momentum FROM snaps WHERE wk = DATE '2001-09-24' AND dimension = 'PROMO'
  UNION ALL SELECT 'shape', dimension, status, momentum FROM snaps WHERE wk = DATE '2001-09-24' AND code = 'red')"""


def gap_snapshots(spark, sf):
    rows = at_week(snapshots(spark, sf), WEEK)
    shape = F.col("code") == "red"
    color = F.col("dimension") == "PROMO"
    pairs = F.filter(F.array(F.when(color, F.struct(F.lit("color").alias("d"), F.col("code").alias("c"))),
                             F.when(shape, F.struct(F.lit("shape").alias("d"), F.col("dimension").alias("c")))), lambda x: x.isNotNull())
    return rows.where(color | shape).select(F.explode(pairs).alias("p"), "week", "status", "momentum", "mentions", "search", "tone", "decline_share") \
        .select(F.col("p.d").alias("dimension"), F.col("p.c").alias("code"), "week", "status", "momentum", "mentions", "search", "tone", "decline_share")


GAP_KIND = """gp AS (SELECT dm.shelf, gs.dimension, gs.code, gs.status, gs.momentum, coalesce(sku, 0) AS sku, coalesce(sku / tg.tagged, 0.0) AS share,
  round(relative_depth, 4) + 0.0 AS relative_depth, coalesce(round(relative_depth, 4) >= 0.001, false) AS clearance
  FROM gs JOIN dm ON dm.dimension = gs.dimension AND dm.comparable LEFT JOIN it ON it.shelf = dm.shelf AND it.dimension = gs.dimension AND it.code = gs.code
  LEFT JOIN tg ON tg.shelf = dm.shelf AND tg.dimension = dm.dimension),
gk AS (SELECT *, CASE WHEN status IN ('en_hausse', 'au_pic') AND share < 0.2 THEN 'opportunity'
  WHEN status = 'en_baisse' AND (share >= 0.1 OR clearance) THEN 'risk' END AS kind FROM gp)"""


@query("shelf_gaps", with_views("prod tags sources snaps", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_all')}, {COVERAGE_ALL}, {GAP_SNAPS}, {GAP_KIND}
SELECT kind, dimension, code, status, momentum, sku, round(share, 6) AS share, relative_depth, clearance FROM gk WHERE kind IS NOT NULL"""))
def shelf_gaps(spark, sf):
    cells = H.shelf(*tables(spark, sf), rules=RULES)
    rows = G.ranked(G.shelf_gaps(gap_snapshots(spark, sf), cells, WEEK, rules=RULES))
    return rows.select("kind", "dimension", "code", "status", "momentum", "sku", F.round("share", 6).alias("share"), "relative_depth", "clearance")


@query("shelf_gaps_by_type", with_views("prod tags sources snaps", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}, {COVERAGE_TYPED}, {GAP_SNAPS}, {GAP_KIND}
SELECT shelf, kind, dimension, code, sku, round(share, 6) AS share, clearance FROM gk WHERE kind IS NOT NULL"""))
def shelf_gaps_by_type(spark, sf):
    rows = G.gaps_by_type(gap_snapshots(spark, sf), *tables(spark, sf), WEEK, RULES)
    return rows.select("shelf", "kind", "dimension", "code", "sku", F.round("share", 6).alias("share"), "clearance")


@query("gaps_grouped", with_views("prod tags sources snaps", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}, {COVERAGE_TYPED}, {GAP_SNAPS}, {GAP_KIND}
SELECT kind, dimension, code, string_agg(shelf, '+' ORDER BY shelf) AS shelves, count(*) > 1 AND bool_and(sku = 0) AS absent_everywhere
FROM gk WHERE kind IS NOT NULL GROUP BY 1, 2, 3"""))
def gaps_grouped(spark, sf):
    rows = G.grouped_by_attribute(G.gaps_by_type(gap_snapshots(spark, sf), *tables(spark, sf), WEEK, RULES))
    return rows.select("kind", "dimension", "code", F.array_join("shelves", "+").alias("shelves"), "absent_everywhere")


@query("skipped_dimensions", with_views("prod tags sources", f"""
WITH {ACTIVE}, {BASE.format('tn')}, {ITEMS}, {ITEM_SELECT.format('rows_typed')}, {COVERAGE_TYPED}
SELECT shelf, dimension, tagged, round(unmapped_share, 6) AS unmapped_share FROM dm WHERE NOT comparable"""))
def skipped_dimensions(spark, sf):
    return G.skipped_dimensions(H.shelf_dimensions(H.shelf(*tables(spark, sf), by_type=True), True)).withColumn("unmapped_share", F.round("unmapped_share", 6))


@query("shelf_products_by_type", with_views("prod tags sources", f"WITH {ACTIVE}, {ITEMS} SELECT shelf, count(*) AS products FROM tn JOIN ty ON ty.product_id = tn.id GROUP BY shelf"))
def shelf_products_by_type(spark, sf):
    return H.shelf_counts(H.shelf(*tables(spark, sf), by_type=True))


@query("gap_labels", with_views("snaps dict", """
SELECT s.dimension, s.code, momentum, label, hex, multicolor FROM snaps s LEFT JOIN dict USING (dimension, code)
WHERE wk = DATE '2001-09-24'"""))
def gap_labels(spark, sf):
    rows = at_week(snapshots(spark, sf), WEEK).select("dimension", "code", "momentum")
    return G.with_labels(rows, S.dictionary(spark, sf))


@query("unknown_codes", with_views("tags dict", """
SELECT DISTINCT dimension, code FROM tags WHERE (dimension, code) NOT IN (SELECT ('color', code) FROM dict UNION SELECT ('shape', dimension) FROM dict)"""))
def unknown_codes(spark, sf):
    """The dictionary knows colours and shapes only, as words and types of the parts."""
    known = S.dictionary(spark, sf)
    pairs = F.array(F.struct(F.lit("color").alias("dimension"), F.col("code").alias("code")), F.struct(F.lit("shape").alias("dimension"), F.col("dimension").alias("code")))
    return G.unknown_codes(S.product_tags(spark, sf), known.select(F.inline(pairs)).distinct())


# --- pairings --------------------------------------------------------------------------------------

PAIRS = f"""{ACTIVE}, lam AS (SELECT DISTINCT product_id, string_split(code, '+') AS ls FROM tags WHERE dimension = 'lamination'),
p AS (SELECT DISTINCT act.*, a.color, b.partner FROM lam JOIN act ON act.id = lam.product_id
  CROSS JOIN LATERAL (SELECT unnest(ls) AS color) a CROSS JOIN LATERAL (SELECT unnest(ls) AS partner) b
  WHERE a.color <> b.partner AND b.partner IN (SELECT code FROM dict WHERE code <> 'old')),
o AS (SELECT DISTINCT act.*, a.color FROM lam JOIN act ON act.id = lam.product_id CROSS JOIN LATERAL (SELECT unnest(ls) AS color) a)"""


def pairing_rows(spark, sf):
    known = S.dictionary(spark, sf).where(F.col("code") != "old")
    return P.pairing_rows(*tables(spark, sf), known)


@query("color_pairings", with_views("prod tags sources dict", f"""
WITH {PAIRS}, c AS (SELECT color, partner, count(*) AS frames, count(*) FILTER (is_bestseller) AS bestsellers FROM p GROUP BY 1, 2),
f AS (SELECT color, count(*) AS color_frames FROM o GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY color ORDER BY frames DESC, bestsellers DESC, partner) AS place FROM c)
SELECT color, partner, place, frames, bestsellers, round(frames / color_frames, 6) AS share, round(bestsellers / frames, 6) AS bestseller_rate
FROM r JOIN f USING (color) WHERE place <= 8"""))
def color_pairings(spark, sf):
    return P.all_pairings(pairing_rows(spark, sf)).withColumn("share", F.round("share", 6)).withColumn("bestseller_rate", F.round("bestseller_rate", 6))


@query("one_color_pairings", with_views("prod tags sources dict", f"""
WITH {PAIRS} SELECT partner, count(*) AS frames, count(*) FILTER (is_bestseller) AS bestsellers FROM p WHERE color = 'red' GROUP BY 1
ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8"""))
def one_color_pairings(spark, sf):
    return P.color_pairings(pairing_rows(spark, sf), "red").select("partner", "frames", "bestsellers")


@query("pairing_examples", with_views("prod tags sources dict", f"""
WITH {PAIRS}, u AS (SELECT id, color, partner, store, name, url, rank, is_bestseller FROM p UNION ALL SELECT id, color, NULL, store, name, url, rank, is_bestseller FROM o)
SELECT color, coalesce(partner, '') AS partner, n, name, url, store FROM (SELECT *, row_number() OVER (PARTITION BY color, partner
  ORDER BY coalesce(nullif(rank, 0), 1000000000), name, url) AS n FROM u WHERE is_bestseller) WHERE n <= 2"""))
def pairing_examples(spark, sf):
    return P.pairing_examples(pairing_rows(spark, sf)).withColumn("partner", F.coalesce("partner", F.lit("")))


@query("pairing_stores", with_views("prod tags sources dict", f"WITH {PAIRS} SELECT DISTINCT color, store FROM o"))
def pairing_stores(spark, sf):
    return P.color_stores(pairing_rows(spark, sf))


# --- catalog history -------------------------------------------------------------------------------

STARTS = "st AS (SELECT source_id, min(finished_at) AS start FROM crawls WHERE status = 'ok' GROUP BY source_id)"
NOW = "TIMESTAMP '2000-07-15 00:00:00'"
SINCE = "TIMESTAMP '2000-06-15 00:00:00'"


@query("crawl_baselines", with_views("crawls", f"WITH {STARTS} SELECT source_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM st"))
def crawl_baselines(spark, sf):
    return C.baselines(S.store_crawls(spark, sf)).select("source_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("new_products", with_views("prod crawls", f"""
WITH {STARTS} SELECT id, source_id FROM prod JOIN st USING (source_id) WHERE is_active AND first_seen_at > start AND first_seen_at >= {SINCE}"""))
def new_products(spark, sf):
    return C.new_products(S.products(spark, sf), C.baselines(S.store_crawls(spark, sf)), S.CATALOG_NOW).select("id", "source_id")


@query("retired_products", with_views("prod crawls", f"""
WITH {STARTS} SELECT id, source_id FROM prod JOIN st USING (source_id) WHERE NOT is_active AND dropped_at >= {SINCE}"""))
def retired_products(spark, sf):
    return C.retired_products(S.products(spark, sf), C.baselines(S.store_crawls(spark, sf)), S.CATALOG_NOW).select("id", "source_id")


SCOPE = f"""{STARTS}, sc AS (SELECT id AS source_id, name AS store, start FROM sources JOIN st ON st.source_id = sources.id
  WHERE kind = 'store' AND coalesce(country, '') <> '' AND country <> 'TN')"""


def scope(spark, sf):
    return C.creator_scope(S.sources(spark, sf), C.baselines(S.store_crawls(spark, sf)))


@query("new_by_store", with_views("prod crawls sources", f"""
WITH {SCOPE} SELECT store, count(*) FILTER (is_active AND first_seen_at > start AND first_seen_at >= {SINCE}) AS new,
  count(*) FILTER (NOT is_active) AS retired, count(*) FILTER (is_active) AS catalog
FROM prod JOIN sc USING (source_id) WHERE is_active OR dropped_at >= {SINCE} GROUP BY store"""))
def new_by_store(spark, sf):
    return C.new_by_store(S.products(spark, sf), scope(spark, sf), S.CATALOG_NOW)


@query("new_by_attribute", with_views("prod crawls sources tags", f"""
WITH {SCOPE}, a AS (SELECT prod.id, first_seen_at > start AND first_seen_at >= {SINCE} AS fresh FROM prod JOIN sc USING (source_id) WHERE is_active),
t AS (SELECT DISTINCT product_id, dimension, code FROM tags WHERE dimension IN ('shape', 'color', 'material')),
n AS (SELECT count(*) FILTER (fresh) AS n_new, count(*) AS n_all FROM a)
SELECT dimension, code, count(*) FILTER (fresh) AS new, count(*) AS catalog, CASE WHEN any_value(n_new) >= 10 THEN round(count(*) FILTER (fresh) / any_value(n_new), 4) END AS share_new,
  CASE WHEN any_value(n_new) >= 10 THEN round(count(*) / any_value(n_all), 4) END AS share_catalog
FROM a JOIN t ON t.product_id = a.id CROSS JOIN n GROUP BY 1, 2 HAVING count(*) FILTER (fresh) > 0"""))
def new_by_attribute(spark, sf):
    return C.new_by_attribute(S.products(spark, sf), S.product_tags(spark, sf), scope(spark, sf), S.CATALOG_NOW)


HEADS = """hd AS (SELECT source_id, max(finished_at) FILTER (status = 'ok') AS ok_at, min(finished_at) FILTER (status = 'ok') AS start,
  arg_max(struct_pack(note := drop_skipped), (finished_at, id)) FILTER (status = 'ok') AS okrow,
  arg_max(struct_pack(status, finished_at, error, problem), (finished_at, id)) FILTER (coalesce(error, '') NOT LIKE 'interrupted%') AS tr
  FROM crawls GROUP BY source_id)"""
STATUS = f"""{HEADS}, pc AS (SELECT p.source_id, count(*) FILTER (is_active) AS products,
  count(*) FILTER (is_active AND first_seen_at > start AND first_seen_at >= TIMESTAMP '2001-07-06') AS new,
  count(*) FILTER (NOT is_active AND dropped_at >= TIMESTAMP '2001-07-06' AND start IS NOT NULL) AS retired
  FROM prod p LEFT JOIN hd USING (source_id) GROUP BY p.source_id),
j AS (SELECT s.*, src.id AS source_id, coalesce(products, 0) AS products, coalesce(new, 0) AS new, coalesce(retired, 0) AS retired, ok_at, okrow, tr,
  coalesce(tr.status <> 'ok' AND (ok_at IS NULL OR tr.finished_at > ok_at), false) AS newer
  FROM stores s LEFT JOIN sources src ON src.url = s.base_url LEFT JOIN hd ON hd.source_id = src.id LEFT JOIN pc ON pc.source_id = src.id),
ss AS (SELECT *, CASE WHEN newer THEN tr.status WHEN ok_at IS NULL THEN CASE WHEN products > 0 THEN 'manual' ELSE 'never' END
  WHEN TIMESTAMP '2001-08-05' - ok_at > to_days(CAST(crawl_every_days * 2 AS INTEGER)) THEN 'late' ELSE 'ok' END AS status,
  CASE WHEN newer THEN CASE WHEN tr.status = 'incomplete' THEN tr.problem ELSE substr(coalesce(tr.error, ''), 1, 200) END END AS detail, okrow.note AS note FROM j)"""


def status_rows(spark, sf):
    return C.store_status(S.stores(spark, sf), S.sources(spark, sf), S.store_crawls(spark, sf), S.products(spark, sf), S.STATUS_NOW)


@query("store_status", with_views("stores crawls prod", f"""
WITH {STATUS} SELECT domain, products, new, retired, status, detail, note, ok_at IS NOT NULL AS has_history FROM ss"""))
def store_status(spark, sf):
    return status_rows(spark, sf).select("domain", "products", "new", "retired", "status", "detail", "note", "has_history")


@query("stores_needing_attention", with_views("stores crawls prod", f"""
WITH {STATUS} SELECT domain, status, note FROM ss WHERE status IN ('late', 'incomplete', 'failed') OR note IS NOT NULL"""))
def stores_needing_attention(spark, sf):
    return C.needing_attention(status_rows(spark, sf)).select("domain", "status", "note")


@query("due_stores", with_views("stores crawls", f"""
WITH {HEADS}, j AS (SELECT s.domain, src.id AS sid, crawl_every_days AS c, ok_at, tr, epoch(TIMESTAMP '2001-08-05' - ok_at) / 3600.0 AS ok_h,
  epoch(TIMESTAMP '2001-08-05' - tr.finished_at) / 3600.0 AS tr_h FROM stores s LEFT JOIN sources src ON src.url = s.base_url LEFT JOIN hd ON hd.source_id = src.id),
a AS (SELECT *, CASE WHEN ok_h < 48 THEN CAST(round_even(ok_h, 0) AS BIGINT) || ' h ago' ELSE CAST(round_even(ok_h / 24, 0) AS BIGINT) || ' d ago' END AS ok_ago,
  CASE WHEN tr_h < 48 THEN CAST(round_even(tr_h, 0) AS BIGINT) || ' h ago' ELSE CAST(round_even(tr_h / 24, 0) AS BIGINT) || ' d ago' END AS tr_ago,
  coalesce(ok_h < c * 24 - 12, false) AS fresh, coalesce(tr.status <> 'ok' AND tr_h < 20, false) AS wait FROM j)
SELECT domain, sid IS NULL OR (NOT fresh AND NOT wait) AS due, CASE WHEN sid IS NULL THEN 'never crawled'
  WHEN fresh THEN 'complete crawl ' || ok_ago || ', every ' || c || ' d' WHEN wait THEN tr.status || ' crawl ' || tr_ago || ', retry after 20 h'
  WHEN ok_at IS NULL THEN CASE WHEN tr IS NOT NULL THEN 'no complete crawl yet' ELSE 'never crawled' END
  ELSE 'last complete crawl ' || ok_ago || CASE WHEN tr.status <> 'ok' THEN ' (retrying a ' || tr.status || ' crawl)' ELSE '' END END AS reason FROM a"""))
def due_stores(spark, sf):
    return C.due_stores(S.stores(spark, sf), S.sources(spark, sf), S.store_crawls(spark, sf), S.STATUS_NOW).select("domain", "due", "reason")


@query("crawl_outcomes", with_views("crawls", """
WITH x AS (SELECT count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'incomplete' OR (status = 'ok' AND drop_skipped IS NOT NULL)) AS attention, count(*) AS n FROM crawls)
SELECT n - failed - attention AS ok, attention, failed, CASE WHEN failed > 0 THEN 1 WHEN attention > 0 THEN 2 ELSE 0 END AS code FROM x"""))
def crawl_outcomes(spark, sf):
    return C.outcome_summary(S.store_crawls(spark, sf))


# --- presence --------------------------------------------------------------------------------------

PRES = f"""{STARTS}, ta AS (SELECT DISTINCT product_id, dimension, code FROM tags WHERE dimension <> 'product_type'),
ty AS (SELECT product_id, code AS ptype FROM tags WHERE dimension = 'product_type'),
al AS (SELECT prod.*, sources.name AS store, country, start, coalesce(first_seen_at > start AND first_seen_at >= {SINCE}, false) AS fresh FROM prod
  JOIN sources ON sources.id = prod.source_id LEFT JOIN st USING (source_id) WHERE is_active OR (dropped_at >= {SINCE} AND start IS NOT NULL)),
pr AS (SELECT al.*, ta.dimension, ta.code, ptype FROM al JOIN ta ON ta.product_id = al.id JOIN ty ON ty.product_id = al.id)"""


@query("retail_presence", with_views("prod tags sources crawls", f"""
WITH {PRES}, bl AS (SELECT source_id, avg(md) AS baseline FROM al WHERE is_active GROUP BY source_id HAVING bool_or(coalesce(list_price, 0) <> 0))
SELECT dimension, code, count(*) FILTER (is_active) AS sku, count(DISTINCT store) FILTER (is_active) AS stores, count(*) FILTER (is_active AND is_bestseller) AS bestsellers,
  count(*) FILTER (is_active AND fresh) AS new, count(*) FILTER (NOT is_active) AS retired, count(*) FILTER (is_active AND ptype = 'optical') AS optical,
  array_to_string(list_sort(list(DISTINCT country) FILTER (is_active AND country IS NOT NULL)), '+') AS countries,
  CAST(CAST(max(seen_at) FILTER (is_active) AS DATE) AS VARCHAR) AS updated, nullif(count(baseline) FILTER (is_active), 0) AS compared,
  round(avg(md - baseline) FILTER (is_active), 4) + 0.0 AS relative_depth
FROM pr LEFT JOIN bl USING (source_id) GROUP BY 1, 2"""))
def retail_presence(spark, sf):
    products, tags, sources = tables(spark, sf)
    header, _ = R.presence(products, tags, sources, S.store_crawls(spark, sf), S.CATALOG_NOW)
    return header.select("dimension", "code", "sku", "stores", "bestsellers", "new", "retired", "optical", F.array_join("countries", "+").alias("countries"),
                         F.to_date("updated").cast("string").alias("updated"), "compared", "relative_depth")


@query("retail_prices", with_views("prod tags sources crawls", f"""
WITH {PRES} SELECT dimension, code, currency, count(*) AS priced, round_even(avg(price) * 100, 0) / 100 AS avg, round(min(price), 4) AS min, round(max(price), 4) AS max
FROM pr WHERE is_active AND price > 0 GROUP BY 1, 2, 3"""))
def retail_prices(spark, sf):
    products, tags, sources = tables(spark, sf)
    _, prices = R.presence(products, tags, sources, S.store_crawls(spark, sf), S.CATALOG_NOW)
    return prices.select("dimension", "code", "currency", "priced", "avg", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


@query("retail_sample", with_views("prod tags sources crawls", f"""
WITH {PRES}, w AS (SELECT *, coalesce(nullif(rank, 0), 1000000000) AS place FROM pr WHERE is_active AND dimension = 'color' AND code = 'red'),
q AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY out_of_stock, NOT is_bestseller, NOT fresh, place, name, id) AS turn,
  row_number() OVER (ORDER BY store, out_of_stock, NOT is_bestseller, NOT fresh, place, name, id) AS pos FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY turn, store) AS slot FROM q QUALIFY slot <= 5),
e AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM q WHERE fresh AND NOT out_of_stock AND id NOT IN (SELECT id FROM f)
  QUALIFY k <= 2 - (SELECT count(*) FROM f WHERE fresh))
SELECT slot, id, store, fresh FROM f WHERE slot <= 5 - (SELECT count(*) FROM e)
UNION ALL SELECT k + least(5 - (SELECT count(*) FROM e), (SELECT count(*) FROM f)), id, store, fresh FROM e"""))
def retail_sample(spark, sf):
    products, tags, sources = tables(spark, sf)
    rows = R.presence_sample(products, tags, sources, S.store_crawls(spark, sf), "color", "red", S.CATALOG_NOW)
    return rows.select("slot", "id", "store", "fresh")
