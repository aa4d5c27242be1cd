from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwave.operators import crawl as W, ingest as I, markup as K, products as P

PAGES = "crawl_id long, entry int, start string, page int, fetched boolean, cards int, has_next boolean, max_pages int, paginated boolean, via_next boolean"


def pages(spark, *listings):
    """Each listing: (via_next, max_pages, [(fetched, cards, has_next), ...]) -> one crawl each."""
    rows = [(k, 0, "/l", n, f, c, h, cap, True, via) for k, (via, cap, ps) in enumerate(listings) for n, (f, c, h) in enumerate(ps, start=1)]
    return spark.createDataFrame(rows, PAGES)


def test_reasons_a_listing_is_incomplete(spark):
    got = W.crawl_problems(W.listing_problems(pages(
        spark, (True, 9, [(True, 5, True), (True, 3, False)]), (True, 9, [(False, 0, False)]), (True, 9, [(True, 0, False)]), (True, 9, [(True, 5, True), (True, 0, False)]),
        (False, 9, [(True, 5, False), (True, 0, False), (True, 4, False)]), (True, 2, [(True, 5, True), (True, 5, True)]), (True, 2, [(True, 5, True), (True, 5, False)]), (False, 2, [(True, 5, False), (True, 5, False)])))).collect()
    assert {r.crawl_id: r.problems for r in got} == {
        1: ["/l page 1: not fetched"], 2: ["/l: first page listed nothing"], 3: ["/l page 2: listed nothing"], 5: ["/l: stopped at max_pages (2) with more to list"],
        7: ["/l: stopped at max_pages (2) with more to list"]}


def test_ranks_models_and_categories(spark, rows):
    cards = spark.createDataFrame([(1, 0, 1, 1, "u/lagoon-48", "Sun"), (1, 0, 1, 2, "u/lagoon-50", "Sun"), (1, 0, 2, 1, "u/plain", "Sun"), (1, 1, 1, 1, "u/lagoon-48", "Men"), (1, 1, 1, 2, "u/cinder-40", "Men"), (1, 1, 2, 1, "u/plain", "Sun")],
                                  "crawl_id long, entry int, page int, pos int, url string, category string")
    key = F.when(F.col("url").rlike(r"/(\w+)-\d+$"), F.regexp_extract("url", r"/(\w+)-\d+$", 1))
    ranks = W.listing_ranks(W.kept_cards(W.first_appearances(cards, key)))
    assert rows(ranks, "url", "rank") == [("u/cinder-40", 3), ("u/lagoon-48", 1), ("u/plain", 2)]
    assert rows(W.category_labels(cards), "url", "categories") == [("u/cinder-40", "Men"), ("u/lagoon-48", "Sun, Men"), ("u/lagoon-50", "Sun"), ("u/plain", "Sun")]


@pytest.fixture()
def facets(spark):
    ranks = spark.createDataFrame([(1, "a", None, 0, 1), (1, "b", None, 0, 2), (1, "c", None, 0, 3)], "crawl_id long, url string, model string, entry int, rank long")
    cards = spark.createDataFrame([(1, 0, "a", "v1", "Mat", "Metal", None, True, 0), (1, 0, "a", "v1", "Mat", "Acetate", None, True, 1), (1, 0, "zz", "v9", "Mat", "Wood", None, True, 2), (1, 0, "b", None, "Best", "Yes", "is_bestseller", False, 0)],
                                  "crawl_id long, entry int, url string, variant_id string, facet string, label string, flag string, per_variant boolean, ord int")

    def pass_of(ok):
        rows = [(1, 0, "Mat", "Metal", None, True, 0, 1, True), (1, 0, "Mat", "Wood", None, True, 2, 1, True), (1, 0, "Best", "Yes", "is_bestseller", False, 0, 1, ok)]
        return spark.createDataFrame(rows, "crawl_id long, entry int, facet string, label string, flag string, per_variant boolean, ord int, page int, fetched boolean")
    return ranks, cards, pass_of


def test_facet_labels_gaps_and_three_valued_flags(facets, rows):
    ranks, cards, pass_of = facets
    matches = W.facet_matches(cards, ranks)
    assert [(r.url, r.raw_specs) for r in W.facet_labels(matches).collect()] == [("a", {"Mat": "Metal, Acetate"})]
    assert [(r.url, r.variant_colors) for r in W.variant_colors(matches).collect()] == [("a", {"v1": "Metal"})]
    for ok, reasons, flags in ((True, [("Wood", "1 cards, none matches a listed product")], [("a", False), ("b", True), ("c", False)]),
                               (False, [("Wood", "1 cards, none matches a listed product"), ("Yes", "not fetched")], [("b", True)])):
        gaps = W.facet_gaps(pass_of(ok), cards, ranks)
        assert rows(gaps, "label", "reason") == reasons
        assert rows(W.facet_flags(matches, ranks, gaps, pass_of(ok).where("flag IS NOT NULL")), "url", "value") == flags


def test_archive_stops_after_five_old_items_in_a_row(spark):
    day = lambda d: datetime(2026, 9, d)
    dates = [20, 1, 1, 19, 1, 1, 1, 1, None, 1, 1, 1, 1, 1, 18]
    items = spark.createDataFrame([(1, k, None, None if d is None else day(d)) for k, d in enumerate(dates)], "source_id long, pos long, lastmod timestamp, page_date timestamp")
    assert sorted(r.pos for r in I.archive_items(items, day(10)).collect()) == [0, 3, 8, 14]
    assert sorted(r.pos for r in I.archive_items(items, day(10), 5).collect()) == [0, 3, 8]  # an undated item breaks the run of four


def page(spark, *scripts, url="https://s.test/p/a"):
    html = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    return spark.createDataFrame([(1, url, f"<html>{html}</html>")], "page_id long, url string, html string")


def product_row(spark, node, *more):
    return K.page_product(K.json_ld_products(page(spark, "{oops", json.dumps([node, *more])))).first()


def test_json_ld_prices(spark):
    spec = [{"priceType": "https://schema.org/ListPrice", "price": "120"}, {"price": "90,5", "priceCurrency": "TND"}]
    row = product_row(spark, {"@type": "Product", "name": " A ", "brand": ["Acme"], "offers": [{"priceSpecification": spec}]})
    assert (row.name, row.brand, row.price, row.list_price, row.currency) == ("A", "Acme", 90.5, 120.0, "TND")
    row = product_row(spark, {"@type": ["Thing", "Product"], "offers": {"lowPrice": 45, "priceCurrency": "EUR"}, "image": {"contentUrl": "i.jpg"}, "url": "/p/b"})
    assert (row.price, row.list_price, row.currency, row.image_url, row.url, row.name) == (45.0, None, "EUR", "https://s.test/p/i.jpg", "https://s.test/p/b", None)
    assert product_row(spark, {"@type": "Product", "name": "B", "offers": {"price": "n/a"}}).price is None


def test_json_ld_graph_references_and_own_product(spark):
    graph = {"@graph": [{"@type": "Brand", "@id": "#b", "name": "Acme"}, {"@type": "Product", "name": "other", "url": "/p/x"},
                        {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "own", "url": "/p/a", "brand": {"@id": "#b"}}}]}]}
    rows = K.json_ld_products(page(spark, json.dumps(graph)))
    assert [r.name for r in rows.orderBy("path").collect()] == ["other", "own"]
    own = K.page_product(rows).first()
    assert (own.name, own.brand) == ("own", "Acme")


def test_offer_variants_and_stock(spark):
    offers = [{"sku": " A ", "name": "Noir  mat", "availability": "https://schema.org/OutOfStock"}, {"sku": "A", "name": "again"}, {"sku": "B", "name": ""}, {"sku": "C", "name": "Bleu"}, "x"]
    rows = K.json_ld_products(page(spark, json.dumps({"@type": "Product", "name": "n", "offers": offers})))
    row = rows.select(K.offer_variants(F.col("offers")).alias("v")).select("v", P.sold_out(F.lit(None).cast("boolean"), F.col("v")).alias("out")).first()
    assert [tuple(v) for v in row.v] == [("A", "Noir mat", False), ("C", "Bleu", None)] and row.out is True


def test_contract(spark):
    rows = spark.createDataFrame([("https://s.test/a", "A  B" + "x" * 400, " ", 10.0, 9.0, "tnd", 1), ("nope", " ", None, -1.0, None, "EURO", 0)], "url string, name string, brand string, price double, list_price double, currency string, rank int").withColumn("image_url", F.lit(None).cast("string"))
    good = P.valid(P.checked(rows)).first()
    assert (len(good.name), good.name[:3], good.brand, good.list_price, good.currency) == (300, "A B", None, None, "TND")
    assert {r.reason for r in P.error_counts(P.checked(rows)).collect()} == {"url: invalid or too long", "name: empty", "price: negative", "currency: not a 3-letter code", "rank: below 1"}
