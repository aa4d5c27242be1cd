"""Catalog sync, tag differences and the crawl observation layer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfwave.functions.urls import model_key
from shelfwave.operators import crawl as W, history as H
from shelfwave.plans.oracle_views import with_views
from shelfwave.plans.registry import query
from shelfwave.session import cut_lineage
from shelfwave.sources import samples as S

URL = "CASE WHEN l_partkey % 17 = 0 THEN 'https://shared.example/p/' || l_partkey ELSE 'https://store' || l_suppkey || '.example/p/' || l_partkey END"
SYNC = f"""cat AS (SELECT {URL} AS url, min(l_suppkey) AS source_id, min(p_brand) AS brand, max(l_shipdate) AS seen_at FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate < DATE '2001-01-01' GROUP BY 1),
ca AS (SELECT *, seen_at >= DATE '2000-06-01' AS is_active FROM cat),
obs AS (SELECT {URL} AS url, l_suppkey AS source_id, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS price, p_brand, l_shipdate AS seen
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '2001-01-01'),
lt AS (SELECT source_id, url, max(seq) AS seq FROM obs GROUP BY 1, 2),
lis AS (SELECT DISTINCT l_suppkey AS source_id, {URL} AS url FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' AND l_shipdate < DATE '2001-01-01'
  AND (l_returnflag <> 'R' OR l_suppkey % 3 = 0)),
pres AS (SELECT source_id, url FROM lt UNION SELECT source_id, url FROM lis),
cl AS (SELECT lt.*, coalesce(ca.source_id, min(lt.source_id) OVER (PARTITION BY lt.url)) = lt.source_id AS accepted FROM lt LEFT JOIN ca USING (url)),
dc AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 6 = 1 THEN 'incomplete crawl: /a page 2: not fetched (+1 more)'
    WHEN a > 0 AND p * 10 < a * 7 THEN 'listing shrank ' || a || ' -> ' || p END AS drop_skipped
  FROM (SELECT s_suppkey, (SELECT count(*) FROM pres WHERE pres.source_id = s_suppkey) AS p, (SELECT count(*) FROM ca WHERE ca.source_id = s_suppkey AND is_active) AS a FROM supplier)),
mg AS (SELECT coalesce(ca.url, c.url) AS url, coalesce(ca.source_id, c.source_id) AS source_id, ca.url IS NOT NULL AS old, c.url IS NOT NULL AS new, ca.is_active, ca.brand, c.seq, c.source_id AS nsrc
  FROM ca FULL JOIN (SELECT * FROM cl WHERE accepted) c ON c.url = ca.url),
ac AS (SELECT mg.*, CASE WHEN new AND NOT old THEN 'inserted' WHEN new AND NOT is_active THEN 'reactivated' WHEN new THEN 'updated'
  WHEN is_active AND dc.drop_skipped IS NULL AND pres.url IS NULL THEN 'dropped' ELSE 'kept' END AS action, new AND old AND nsrc % 4 = 0 AS carried
  FROM mg LEFT JOIN pres ON pres.url = mg.url AND pres.source_id = mg.source_id LEFT JOIN dc ON dc.source_id = mg.source_id)"""


def sync_inputs(spark, sf):
    return (S.stored_catalog(spark, sf), S.product_observations(spark, sf), *S.crawl_reports(spark, sf))


def synced(spark, sf):
    return H.sync(*sync_inputs(spark, sf), S.STATUS_NOW)


@query("catalog_sync", f"""
WITH {SYNC} SELECT url, source_id, action, carried, CASE WHEN action = 'dropped' THEN false WHEN new THEN true ELSE is_active END AS is_active FROM ac""")
def catalog_sync(spark, sf):
    return synced(spark, sf).select("url", "source_id", "action", "carried", "is_active")


REPLAYED = [date(2001, 1, 1), date(2001, 4, 1), date(2001, 7, 1), date(2001, 10, 1)]  # the last crawl takes all order lines that are left


def replay_sql() -> str:
    """One step of the sync rules per crawl, each on what the one before left."""
    steps = [f"""c0 AS (SELECT {URL} AS url, min(l_suppkey) AS source_id, max(l_shipdate) >= DATE '2000-06-01' AS is_active FROM lineitem WHERE l_shipdate < DATE '2001-01-01' GROUP BY 1)"""]
    for k, start in enumerate(REPLAYED, 1):
        before = f" AND l_shipdate < DATE '{REPLAYED[k]}'" if k < len(REPLAYED) else ""
        steps.append(f"""o{k} AS (SELECT DISTINCT l_suppkey AS source_id, {URL} AS url FROM lineitem WHERE l_shipdate >= DATE '{start}'{before}),
w{k} AS (SELECT url, source_id FROM (SELECT o.*, coalesce(c.source_id, min(o.source_id) OVER (PARTITION BY o.url)) AS owner FROM o{k} o LEFT JOIN c{k - 1} c USING (url)) WHERE owner = source_id),
d{k} AS (SELECT s_suppkey AS source_id FROM supplier LEFT JOIN (SELECT source_id, count(*) AS p FROM o{k} GROUP BY 1) o ON o.source_id = s_suppkey
  LEFT JOIN (SELECT source_id, count(*) FILTER (is_active) AS a FROM c{k - 1} GROUP BY 1) c ON c.source_id = s_suppkey
  WHERE s_suppkey % 6 <> 1 AND NOT (coalesce(a, 0) > 0 AND coalesce(p, 0) * 10 < a * 7)),
c{k} AS (SELECT coalesce(c.url, w.url) AS url, coalesce(c.source_id, w.source_id) AS source_id,
  CASE WHEN w.url IS NOT NULL THEN true WHEN d.source_id IS NOT NULL AND o.url IS NULL THEN false ELSE c.is_active END AS is_active
  FROM c{k - 1} c FULL JOIN w{k} w ON c.url = w.url LEFT JOIN o{k} o ON o.url = c.url AND o.source_id = c.source_id LEFT JOIN d{k} d ON d.source_id = c.source_id)""")
    return "WITH " + ",\n".join(steps) + f"\nSELECT url, source_id, is_active FROM c{len(REPLAYED)}"


@query("catalog_replay", replay_sql())
def catalog_replay(spark, sf):
    """All crawls after the cut, one quarter each: drops, returns and the guard against the state the crawl before left."""
    reports = S.crawl_reports(spark, sf)[1]
    none = S.stored_catalog(spark, sf).select("source_id", "url").limit(0)
    steps = [(S.product_observations(spark, sf, a, b), none, reports, None) for a, b in zip(REPLAYED, [*REPLAYED[1:], None], strict=True)]
    return H.replay(S.stored_catalog(spark, sf), steps, S.STATUS_NOW).select("url", "source_id", "is_active")


@query("carried_flags", f"""
WITH {SYNC} SELECT url, CASE WHEN carried THEN p.b || ', Metal' ELSE p.b END AS materials, CASE WHEN carried THEN true END AS best
FROM ac JOIN (SELECT DISTINCT url, min(p_brand) AS b FROM obs GROUP BY url) p USING (url) WHERE new AND old""")
def carried_flags(spark, sf):
    rows = synced(spark, sf).where(F.col("action").isin("updated", "reactivated"))
    return rows.select("url", F.col("flags.raw_specs")["Materials"].alias("materials"), F.col("flags.is_bestseller").alias("best"))


@query("sync_summary", f"""
WITH {SYNC} SELECT source_id, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action IN ('updated', 'reactivated')) AS updated,
  count(*) FILTER (action = 'reactivated') AS reactivated, count(*) FILTER (action = 'dropped') AS dropped, count(*) FILTER (carried) AS carried,
  coalesce(any_value(x.n), 0) AS conflicts, any_value(dc.drop_skipped) AS drop_skipped
FROM dc LEFT JOIN ac USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM cl WHERE NOT accepted GROUP BY 1) x USING (source_id) GROUP BY source_id""")
def sync_summary(spark, sf):
    catalog, observations, listed, reports, gaps = sync_inputs(spark, sf)
    changes = H.sync(catalog, observations, listed, reports, gaps, S.STATUS_NOW)
    decisions = H.drop_decisions(catalog, observations, listed, reports, S.STATUS_NOW)
    return H.sync_summary(changes, H.claims(catalog, H.latest_observations(observations)), decisions)


@query("last_observation_wins", f"WITH {SYNC} SELECT source_id, url, seq FROM lt")
def last_observation_wins(spark, sf):
    return H.latest_observations(S.product_observations(spark, sf)).select("source_id", "url", "seq")


@query("tag_changes", with_views("tags", """
WITH a AS (SELECT * FROM tags WHERE dimension <> 'shape' AND NOT (supplier_code LIKE 'D1%')),
b AS (SELECT product_id, dimension, code, supplier_code, CASE WHEN dimension = 'color' THEN 2 ELSE 1 END AS v FROM tags WHERE NOT (dimension = 'material' AND code = 'rod'))
SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.dimension, b.dimension) AS dimension, coalesce(a.code, b.code) AS code, coalesce(a.supplier_code, b.supplier_code) AS supplier_code,
  CASE WHEN a.product_id IS NULL THEN 'added' WHEN b.product_id IS NULL THEN 'removed' WHEN v = 2 THEN 'changed' ELSE 'same' END AS change
FROM (SELECT * FROM a UNION SELECT * FROM tags WHERE dimension <> 'shape' AND supplier_code IS NULL) a
FULL JOIN b ON a.product_id = b.product_id AND a.dimension = b.dimension AND a.code = b.code AND a.supplier_code IS NOT DISTINCT FROM b.supplier_code"""))
def tag_changes(spark, sf):
    tags = S.product_tags(spark, sf)
    stored = tags.where((F.col("dimension") != "shape") & ~F.coalesce(F.col("supplier_code").startswith("D1"), F.lit(False)))
    wanted = tags.where(~((F.col("dimension") == "material") & (F.col("code") == "rod"))).withColumn(
        "rules_version", F.when(F.col("dimension") == "color", F.lit(2)).otherwise(F.lit(1)))
    return H.tag_changes(stored, wanted)


@query("collapsed_tags", with_views("tags", """
WITH t AS (SELECT *, product_id * 100 + CASE WHEN supplier_code LIKE 'D%' THEN 1 ELSE 2 END AS id FROM tags)
SELECT min(id) AS id, product_id, dimension, code, arg_min(coalesce(supplier_code, ''), id) AS supplier_code FROM t GROUP BY product_id, dimension, code"""))
def collapsed_tags(spark, sf):
    rows = S.product_tags(spark, sf).withColumn("id", F.col("product_id") * 100 + F.when(F.col("supplier_code").startswith("D"), 1).otherwise(2))
    return H.collapse_duplicate_tags(rows).select("id", "product_id", "dimension", "code", F.coalesce("supplier_code", F.lit("")).alias("supplier_code"))


@query("activity_backfill", with_views("prod", """
SELECT id, seen_at >= max(seen_at) OVER (PARTITION BY source_id) - INTERVAL 14 DAY AS is_active FROM prod"""))
def activity_backfill(spark, sf):
    return H.activity_backfill(S.products(spark, sf)).select("id", "is_active")


# --- the crawl layer -------------------------------------------------------------------------------

CARDS = """cards AS (SELECT l_suppkey * 100 + (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS crawl_id, p_size % 3 AS entry, l_orderkey % 3 + 1 AS page, l_partkey AS pos,
  'https://store' || l_suppkey || '.example/p/m' || (l_partkey % 50) || '-' || l_partkey AS url, 'm' || (l_partkey % 50) AS model,
  CASE WHEN p_size % 3 > 0 THEN 'cat' || (p_size % 3) END AS category, l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
fi AS (SELECT crawl_id, url, any_value(model) AS model, min((entry, page, pos)) AS f FROM cards GROUP BY 1, 2),
kp AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY crawl_id, model ORDER BY f) = 1),
rk AS (SELECT crawl_id, url, f[1] AS entry, row_number() OVER (PARTITION BY crawl_id ORDER BY f) AS rank FROM kp)"""


def ranks(spark, sf):
    cards = S.listing_cards(spark, sf)
    return W.listing_ranks(W.kept_cards(W.first_appearances(cards, model_key(F.col("url"), r"/p/(m\d+)-"))))


@query("listing_ranks", f"WITH {CARDS} SELECT crawl_id, url, rank FROM rk")
def listing_ranks(spark, sf):
    return ranks(spark, sf).select("crawl_id", "url", "rank")


@query("category_labels", f"""
WITH {CARDS}, c AS (SELECT crawl_id, url, category, min((entry, page, pos)) AS f FROM cards WHERE category IS NOT NULL GROUP BY 1, 2, 3)
SELECT crawl_id, url, string_agg(category, ', ' ORDER BY f) AS categories FROM c GROUP BY 1, 2""")
def category_labels(spark, sf):
    return W.category_labels(S.listing_cards(spark, sf))


PAGES = """pg AS (SELECT crawl_id, entry, '/list' || entry AS start, p + 1 AS page, q > 12 AS fetched, CASE WHEN q > 12 THEN c ELSE 0 END AS cards, t < 0.03 AS has_next, crawl_id % 2 = 0 AS via_next
  FROM (SELECT l_suppkey * 100 + (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS crawl_id, l_linenumber % 2 AS entry, l_orderkey % 4 AS p, count(*) FILTER (l_returnflag <> 'N') AS c,
    max(l_quantity) AS q, min(l_tax) AS t FROM lineitem GROUP BY 1, 2, 3)),
st AS (SELECT *, min(CASE WHEN fetched AND cards = 0 AND page > 1 THEN page END) OVER (PARTITION BY crawl_id, entry) AS stop FROM pg),
rd AS (SELECT * FROM st WHERE stop IS NULL OR page <= stop),
pb AS (SELECT crawl_id, entry, page, CASE WHEN NOT fetched THEN start || ' page ' || page || ': not fetched' WHEN cards = 0 AND page > 1 THEN CASE WHEN via_next THEN start || ' page ' || page || ': listed nothing' END
    WHEN cards = 0 THEN start || ': first page listed nothing' END AS problem FROM rd
  UNION ALL SELECT crawl_id, entry, 99, start || ': stopped at max_pages (4) with more to list' FROM rd WHERE fetched AND cards > 0 AND page = 4 AND (NOT via_next OR has_next))"""


@query("crawl_problems", f"WITH {PAGES} SELECT crawl_id, string_agg(problem, ' | ' ORDER BY entry, page) AS problems FROM pb WHERE problem IS NOT NULL GROUP BY crawl_id")
def crawl_problems(spark, sf):
    return W.crawl_problems(W.listing_problems(S.listing_pages(spark, sf))).select("crawl_id", F.array_join("problems", " | ").alias("problems"))


FACETS = """fc AS (SELECT crawl_id, entry, CASE WHEN l_orderkey % 5 = 0 OR crawl_id % 7 = 0 THEN url || '?x' ELSE url END AS url, CAST(l_linenumber AS VARCHAR) AS variant_id,
    'Return' AS facet, l_returnflag AS label, CAST(NULL AS VARCHAR) AS flag, ascii(l_returnflag) AS ord FROM cards
  UNION ALL SELECT crawl_id, entry, CASE WHEN l_orderkey % 5 = 0 OR crawl_id % 7 = 0 THEN url || '?x' ELSE url END, CAST(l_linenumber AS VARCHAR), 'Best', 'Yes', 'is_bestseller', 0 FROM cards WHERE l_linestatus = 'O'),
fm AS (SELECT fc.*, rk.url IS NOT NULL AS known FROM fc LEFT JOIN rk ON rk.crawl_id = fc.crawl_id AND rk.url = fc.url),
gp AS (SELECT crawl_id, entry, facet, label, any_value(flag) AS flag, any_value(ord) AS ord, CASE WHEN crawl_id % 5 = 0 THEN 'not fetched' WHEN count(*) FILTER (known) = 0 THEN count(*) || ' cards, none matches a listed product' END AS reason
  FROM fm GROUP BY 1, 2, 3, 4)"""


def facet_plan(spark, sf):
    """Ranked listing, landed once, as matches, gaps and flags all read it; facet cards, of which each reads the columns it needs; then the matches,
    the gaps and the pages."""
    order, cards = cut_lineage(ranks(spark, sf)), S.facet_cards(spark, sf)
    pages = S.facet_pages(spark, sf, cards)
    return order, cards, W.facet_matches(cards, order), W.facet_gaps(pages, cards, order), pages


def matched_cards(spark, sf):
    """The matches alone: the ranked listing is read once, so nothing is landed."""
    return W.facet_matches(S.facet_cards(spark, sf), ranks(spark, sf))


@query("facet_gaps", f"WITH {CARDS}, {FACETS} SELECT crawl_id, entry, facet, label, reason FROM gp WHERE reason IS NOT NULL")
def facet_gaps(spark, sf):
    return facet_plan(spark, sf)[3].select("crawl_id", "entry", "facet", "label", "reason")


@query("facet_labels", f"""
WITH {CARDS}, {FACETS} SELECT crawl_id, url, string_agg(label, ', ' ORDER BY label) AS labels FROM (SELECT DISTINCT crawl_id, url, label FROM fm WHERE known AND flag IS NULL) GROUP BY 1, 2""")
def facet_labels(spark, sf):
    return W.facet_labels(matched_cards(spark, sf)).select("crawl_id", "url", F.col("raw_specs")["Return"].alias("labels"))


@query("facet_variant_colors", f"""
WITH {CARDS}, {FACETS} SELECT crawl_id, url, variant_id, arg_min(label, ord) AS label FROM fm WHERE known AND flag IS NULL GROUP BY 1, 2, 3""")
def facet_variant_colors(spark, sf):
    rows = W.variant_colors(matched_cards(spark, sf))
    return rows.select("crawl_id", "url", F.explode("variant_colors").alias("variant_id", "label"))


@query("variant_facet_labels", f"""
WITH {CARDS}, {FACETS}, c AS (SELECT crawl_id, url, arg_min(label, ord) AS label FROM fm WHERE known AND flag IS NULL AND variant_id = '1' GROUP BY 1, 2)
SELECT rk.crawl_id, rk.url, c.label AS first_color, 'kept' AS second_color FROM rk LEFT JOIN c ON c.crawl_id = rk.crawl_id AND c.url = rk.url""")
def variant_facet_labels(spark, sf):
    order, _, matches, _, _ = facet_plan(spark, sf)
    variant = lambda i, color: F.struct(F.lit(i).alias("id"), F.lit(color).cast("string").alias("color"))
    products = order.select("crawl_id", "url", F.array(variant("1", None), variant("2", "kept")).alias("variants"))
    rows = W.with_variant_colors(products, W.variant_colors(matches))
    return rows.select("crawl_id", "url", F.col("variants")[0]["color"].alias("first_color"), F.col("variants")[1]["color"].alias("second_color"))


@query("facet_flags", f"""
WITH {CARDS}, {FACETS}, ps AS (SELECT crawl_id, entry, bool_or(reason IS NOT NULL) AS broken FROM gp WHERE flag IS NOT NULL GROUP BY 1, 2),
hit AS (SELECT DISTINCT crawl_id, url FROM fm WHERE known AND flag IS NOT NULL)
SELECT rk.crawl_id, rk.url, hit.url IS NOT NULL AS value FROM rk LEFT JOIN ps USING (crawl_id, entry) LEFT JOIN hit ON hit.crawl_id = rk.crawl_id AND hit.url = rk.url
WHERE hit.url IS NOT NULL OR (ps.crawl_id IS NOT NULL AND NOT broken)""")
def facet_flags(spark, sf):
    order, _, matches, gaps, pages = facet_plan(spark, sf)
    passed = pages.where(F.col("flag").isNotNull())
    return W.facet_flags(matches, order, gaps, passed).select("crawl_id", "url", "value")


@query("flag_listing", f"WITH {CARDS}, {FACETS} SELECT DISTINCT crawl_id, url, true AS value FROM fm WHERE known AND flag IS NOT NULL")
def flag_listing(spark, sf):
    return W.flag_listing(S.facet_cards(spark, sf).where(F.col("flag").isNotNull()), ranks(spark, sf)).select("crawl_id", "url", "value")


@query("crawl_statuses", f"""
WITH {CARDS}, {FACETS}, {PAGES}, x AS (SELECT crawl_id, count(*) AS n FROM pb WHERE problem IS NOT NULL GROUP BY 1), y AS (SELECT crawl_id, count(*) AS n FROM gp WHERE reason IS NOT NULL GROUP BY 1)
SELECT c.crawl_id, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 'ok' ELSE 'incomplete' END AS status, coalesce(x.n, 0) + coalesce(y.n, 0) AS problems
FROM (SELECT DISTINCT crawl_id FROM cards) c LEFT JOIN x USING (crawl_id) LEFT JOIN y USING (crawl_id)""")
def crawl_statuses(spark, sf):
    crawls = S.listing_cards(spark, sf).select("crawl_id").distinct()
    rows = W.crawl_outcomes(crawls, W.listing_problems(S.listing_pages(spark, sf)), facet_plan(spark, sf)[3])
    return rows.select("crawl_id", "status", F.size("problems").cast("long").alias("problems"))
