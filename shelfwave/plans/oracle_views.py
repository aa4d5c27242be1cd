"""The sample adapters as ANSI SQL, written independently of the Spark code: the base of every oracle query."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["sources"] = """
SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name,
       CASE s_nationkey % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'press' WHEN 2 THEN 'news' ELSE 'social' END AS kind,
       'https://store' || s_suppkey || '.example' AS url,
       CASE WHEN s_nationkey % 4 = 1 THEN 'en' ELSE 'fr' END AS lang,
       CASE WHEN r_name = 'AFRICA' THEN 'TN' WHEN r_name = 'EUROPE' THEN NULL ELSE 'X' || n_regionkey END AS country,
       s_acctbal >= 0 AS active
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["docs"] = """
SELECT o_orderkey AS id, o_custkey % 10 AS source_id, 'doc:' || o_orderkey AS url, 'Order ' || o_orderkey AS title,
       CASE WHEN o_custkey % 3 = 0 THEN 'en' ELSE 'fr' END AS lang,
       CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderdate END AS published_at,
       o_orderdate + INTERVAL 1 DAY AS collected_at,
       CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) < '3' THEN 'pending'
            WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '3%' THEN 'irrelevant' ELSE 'extracted' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'résumé ' || o_orderkey END AS summary_fr,
       'Brand#' || (o_custkey % 25) AS brand1, 'House#' || (o_custkey % 7) AS brand2,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN NULL WHEN '2' THEN 'v1' WHEN '3' THEN 'v2' ELSE 'v1+color@v2' END
           AS prompt_version,
       o_custkey % 50 = 0 AS is_demo
FROM orders"""

VIEWS["ment"] = """
SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, l_orderkey AS document_id,
       p_type AS dimension, split_part(p_name, ' ', 1) AS code,
       CASE l_returnflag WHEN 'A' THEN 'rising' WHEN 'R' THEN 'declining' ELSE 'neutral' END AS stance,
       p_name || ' ' || l_suppkey AS evidence, CAST(l_shipdate AS DATE) AS occurred_on
FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS["search"] = """
SELECT max(l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS id, p_type AS dimension,
       split_part(p_name, ' ', 1) AS code,
       CASE l_linenumber % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'de' END AS lang,
       CASE WHEN l_linenumber % 2 = 1 THEN 'FR' ELSE '' END AS geo,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS wk, sum(l_quantity) / count(*) AS val
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O'
GROUP BY p_type, split_part(p_name, ' ', 1), 4, 5, 6"""

VIEWS["prod"] = """
SELECT l_suppkey * 10000000000 + l_partkey AS id, l_suppkey AS source_id, l_partkey AS part_id, p_size,
       'https://store' || l_suppkey || '.example/p/' || l_partkey AS url, p_name AS name, p_brand AS brand,
       top * (1 - cut) AS price, CASE WHEN l_suppkey % 5 <> 0 THEN top END AS list_price,
       CASE n_regionkey WHEN 0 THEN 'TND' WHEN 1 THEN 'USD' WHEN 3 THEN 'EUR' ELSE 'GBP' END AS currency,
       CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS rank,
       p_retailprice > 980 AS is_bestseller, p_partkey % 3 = 0 AS out_of_stock,
       last_day AS seen_at, first_day AS first_seen_at, last_day >= DATE '2000-07-01' AS is_active,
       CASE WHEN last_day < DATE '2000-07-01' THEN last_day END AS dropped_at,
       CASE WHEN l_suppkey % 5 <> 0 AND top > top * (1 - cut) AND top * (1 - cut) > 0 THEN 1 - (top * (1 - cut)) / top ELSE 0.0 END AS md
FROM (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS top, max(l_discount) AS cut, min(l_shipdate) AS first_day,
             max(l_shipdate) AS last_day FROM lineitem GROUP BY l_suppkey, l_partkey)
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["tags"] = """
WITH pk AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
     d AS (SELECT a.p_partkey, a.p_size, a.p_type, split_part(a.p_name, ' ', 1) AS w1, split_part(a.p_name, ' ', 2) AS w2,
                  split_part(b.p_name, ' ', 1) AS w3 FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1),
     t AS (SELECT p_partkey, 'color' AS dimension, w1 AS code, CASE WHEN p_size % 4 = 0 THEN 'C' || p_size END AS supplier_code
           FROM d WHERE p_partkey % 10 < 8
           UNION ALL SELECT p_partkey, 'color', w1, 'D' || p_size FROM d WHERE p_partkey % 10 < 8 AND p_size % 4 = 0
           UNION ALL SELECT p_partkey, 'material', w2, NULL FROM d WHERE p_partkey % 7 <> 0
           UNION ALL SELECT p_partkey, 'shape', p_type, NULL FROM d
           UNION ALL SELECT p_partkey, 'product_type', CASE WHEN p_partkey % 2 = 0 THEN 'optical' ELSE 'sun' END, NULL FROM d
           UNION ALL SELECT p_partkey, 'lamination', least(w1, w3) || '+' || greatest(w1, w3), NULL FROM d
                     WHERE w3 IS NOT NULL AND w1 <> w3 AND p_partkey % 3 = 0)
SELECT l_suppkey * 10000000000 + l_partkey AS product_id, dimension, code, supplier_code
FROM pk JOIN t ON l_partkey = p_partkey"""

VIEWS["crawls"] = """
SELECT o_orderkey AS id, o_custkey % 100 AS source_id,
       o_orderdate + to_seconds(o_orderkey % 86400) AS finished_at,
       CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'incomplete' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'listing shrank 100 -> ' || (o_orderkey % 70) END AS drop_skipped,
       CASE WHEN o_orderstatus = 'O' THEN '/sun page ' || (o_orderkey % 9) || ': not fetched' END AS problem,
       CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN
            CASE WHEN o_orderpriority = '5-LOW' THEN 'interrupted: the process ended' ELSE 'Timeout after ' || (o_orderkey % 60) END
       END AS error
FROM orders"""

VIEWS["stores"] = """
SELECT 'store' || id || '.example' AS domain, name,
       CASE WHEN id % 13 = 12 THEN 'https://new' || id || '.example' ELSE url END AS base_url, country,
       3 + id % 20 AS crawl_every_days
FROM sources"""

VIEWS["dict"] = """
SELECT DISTINCT p_type AS dimension, split_part(p_name, ' ', 1) AS code,
       upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS label,
       '#' || substr(md5(split_part(p_name, ' ', 1)), 1, 6) AS hex, split_part(p_name, ' ', 1) = 'hot' AS multicolor
FROM part"""

# Weekly stance counts in tenths over the 12 weeks ending 2001-09-24, dense grid, and the scored snapshots.
VIEWS["weekly"] = """
SELECT dimension, code, CAST(date_trunc('week', occurred_on) AS DATE) AS wk,
       sum(CASE WHEN stance = 'rising' THEN w ELSE 0 END) AS r, sum(CASE WHEN stance = 'neutral' THEN w ELSE 0 END) AS n,
       sum(CASE WHEN stance = 'declining' THEN w ELSE 0 END) AS d, sum(w) AS v
FROM (SELECT m.*, CASE s.kind WHEN 'store' THEN 15 WHEN 'social' THEN 6 ELSE 10 END AS w
      FROM ment m JOIN docs ON docs.id = m.document_id JOIN sources s ON s.id = docs.source_id
      WHERE occurred_on >= DATE '2001-07-09')
GROUP BY dimension, code, 3"""

VIEWS["weekly_search"] = """
SELECT dimension, code, wk, sum(val) / count(*) AS s FROM search WHERE wk >= DATE '2001-07-09' GROUP BY dimension, code, wk"""

VIEWS["grid"] = """
SELECT k.dimension, k.code, g.wk, coalesce(r, 0) AS r, coalesce(n, 0) AS n, coalesce(d, 0) AS d, coalesce(v, 0) AS v, s
FROM (SELECT dimension, code FROM weekly UNION SELECT dimension, code FROM weekly_search) k
CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2001-07-09', DATE '2001-09-24', INTERVAL 7 DAY)) AS DATE) AS wk) g
LEFT JOIN weekly w ON w.dimension = k.dimension AND w.code = k.code AND w.wk = g.wk
LEFT JOIN weekly_search ws ON ws.dimension = k.dimension AND ws.code = k.code AND ws.wk = g.wk"""

VIEWS["scored"] = """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY dimension, code ORDER BY wk) - 1 AS i FROM grid),
frames AS (
  SELECT *,
    coalesce(sum(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS bs,
    count(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS bn,
    max(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS high,
    count(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS n8,
    sum(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS sv8,
    sum(i * v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS siv8,
    count(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n4,
    sum(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS sv4,
    sum(i * v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS siv4,
    count(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS np,
    coalesce(sum(v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING), 0) AS svp,
    coalesce(sum(i * v) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING), 0) AS sivp,
    sum(r) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r4,
    sum(n) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS nn4,
    sum(d) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS d4
  FROM numbered),
srch AS (
  SELECT dimension, code, i,
    row_number() OVER (PARTITION BY dimension, code ORDER BY i) AS seen,
    sum(s) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
      / count(s) OVER (PARTITION BY dimension, code ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS sb
  FROM numbered WHERE s IS NOT NULL),
m AS (
  SELECT f.*, srch.seen >= 2 AS blended, sb,
    CASE WHEN bn = 0 THEN 0.0 ELSE CAST(v * bn - bs AS DOUBLE) / CAST(greatest(bs, 10 * bn) AS DOUBLE) END AS vol_growth,
    CAST(2 * siv8 - (2 * i - n8 + 1) * sv8 AS BIGINT) AS a8, CAST(2 * siv4 - (2 * i - n4 + 1) * sv4 AS BIGINT) AS a4,
    CAST(2 * sivp - (2 * (i - 4) - np + 1) * svp AS BIGINT) AS ap, r4 + nn4 + d4 AS total4
  FROM frames f LEFT JOIN srch USING (dimension, code, i)),
mm AS (
  SELECT *, CASE WHEN blended THEN 0.7 * vol_growth + 0.3 * ((s - sb) / greatest(sb, 5.0)) ELSE vol_growth END AS mom,
    CASE WHEN blended THEN 0.7 * vol_growth + 0.3 * ((s - sb) / greatest(sb, 5.0)) >= 0.25
         ELSE bn > 0 AND 4 * (v * bn - bs) >= greatest(bs, 10 * bn) END AS up,
    CASE WHEN blended THEN 0.7 * vol_growth + 0.3 * ((s - sb) / greatest(sb, 5.0)) <= -0.25
         ELSE bn > 0 AND 4 * (v * bn - bs) <= -greatest(bs, 10 * bn) END AS down
  FROM m)
SELECT dimension, code, wk, v, r, n, d, s, mom,
  CASE WHEN sv4 < 50 THEN 'faible'
       WHEN total4 >= 30 AND 2 * d4 >= total4 THEN 'en_baisse'
       WHEN up THEN 'en_hausse' WHEN down THEN 'en_baisse'
       WHEN v <= 0 OR n8 < 4 THEN 'stable'
       WHEN 10 * v < 9 * high OR 6 * a8 < 10 * n8 * (n8 + 1) OR 24 * a8 < high * n8 * (n8 + 1) THEN 'stable'
       WHEN mom > 0 AND a4 > 0 AND CASE WHEN np >= 4 THEN 2 * a4 >= greatest(ap, 0) WHEN np = 3 THEN 4 * a4 >= 5 * greatest(ap, 0)
                                        ELSE true END THEN 'en_hausse'
       ELSE 'au_pic' END AS status,
  CASE WHEN total4 >= 30 THEN CAST(r4 - d4 AS DOUBLE) / total4 END AS tone,
  CASE WHEN total4 >= 30 THEN CAST(d4 AS DOUBLE) / total4 END AS decline_share
FROM mm"""

# The snapshot table as stored: rounded figures.
VIEWS["snaps"] = """
SELECT dimension, code, wk, v / 10.0 AS mentions, s AS search, round_even(mom * 10000.0, 0) / 10000.0 + 0.0 AS momentum, status,
       round_even(tone * 10000.0, 0) / 10000.0 + 0.0 AS tone, round_even(decline_share * 10000.0, 0) / 10000.0 + 0.0 AS decline_share
FROM scored"""

DEPENDS: dict[str, tuple[str, ...]] = {
    "stores": ("sources",), "weekly": ("ment", "docs", "sources"), "weekly_search": ("search",),
    "grid": ("weekly", "weekly_search"), "scored": ("grid",), "snaps": ("scored",),
}


def with_views(names: str, body: str) -> str:
    """`WITH <views and what they need> body`; names are separated by blanks."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in DEPENDS.get(name, ()):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
