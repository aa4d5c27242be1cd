from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwave.operators import catalog as C, gaps as G, history as H, pairings as P, presence as R, shelf as S
from shelfwave.rules import Rules
from shelfwave.sources.tables import FLAGS, schema_of

NOW = datetime(2026, 9, 30, 3, 0)
DAY = timedelta(days=1)


def flags(specs=None, best=None, out=None, variants=None):
    return (specs, variants, None, None, None, best, out, None, None)


def product(id, source, price=100.0, listed=None, currency="TND", rank=None, active=True, seen=NOW, first=NOW - 90 * DAY, dropped=None, fl=None, name=None):
    return (id, source, f"https://s{source}.test/p/{id}", name or f"P{id}", None, price, listed, currency, rank, fl, None, seen, first, active, dropped)


def tags_of(spark, rows):
    return spark.createDataFrame([(p, d, c, "name", c, 1, None, None, s) for p, d, c, s in rows], schema_of("product_tags"))


@pytest.fixture(scope="module")
def market(spark):
    sources = spark.createDataFrame([(1, "Alpha", "store", "https://s1.test", "fr", "TN", True), (2, "Beta", "store", "https://s2.test", "fr", "TN", True), (3, "Brand", "store", "https://s3.test", "en", "ES", True)], schema_of("sources"))
    rows = [product(1, 1, 80.0, 100.0, fl=flags({"Forme": "Rond"})), product(2, 1, 100.0, 100.0, fl=flags({"Forme": "?"})), product(3, 1, 50.0, 100.0), product(4, 2, 10.0, None), product(5, 2, 20.0, None, active=False),
            product(6, 3, 300.0, 600.0, "EUR")]
    tags = tags_of(spark, [(1, "shape", "round", None), (1, "product_type", "sun", None), (2, "product_type", "sun", None), (3, "shape", "round", None), (3, "shape", "square", None), (3, "product_type", "optical", None),
                           (4, "shape", "square", None), (4, "product_type", "sun", None), (5, "shape", "square", None), (6, "shape", "round", None), (1, "color", "red", "A1"), (1, "color", "red", "A2")])
    return spark.createDataFrame(rows, schema_of("products")), tags, sources


def test_shelf_shares_prices_and_relative_markdown(market):
    cells = S.shelf(*market)
    got = {(r.dimension, r.code): r for r in S.shelf_items(cells).collect()}
    # store Alpha: markdowns 0.2, 0, 0.5 -> baseline 0.2333; Beta publishes no list price and is left out of markdown figures
    assert (got["shape", "round"].sku, got["shape", "round"].tagged, got["shape", "round"].compared) == (2, 3, 2)
    assert got["shape", "round"].relative_depth == pytest.approx(0.35 - 0.7 / 3, abs=1e-4)
    assert (got["shape", "square"].sku, got["shape", "square"].compared, got["shape", "square"].avg_depth) == (2, 1, 0.5)
    assert got["color", "red"].sku == 1  # two supplier codes, one product
    prices = {(r.code, r.currency): r.avg_price for r in S.shelf_prices(cells).where("dimension = 'shape'").collect()}
    assert prices == {("round", "TND"): 65.0, ("square", "TND"): 30.0}
    dims = {r.dimension: r for r in S.shelf_dimensions(cells).collect()}
    assert (dims["shape"].with_value, dims["shape"].unmapped, dims["shape"].comparable) == (2, 1, False)
    assert (dims["style"].tagged, dims["style"].unmapped_share) == (0, 0.0)


def test_typed_shelves_keep_store_wide_baselines(market):
    got = {(r.shelf, r.code): r for r in S.shelf_items(S.shelf(*market, by_type=True)).where("dimension = 'shape'").collect()}
    assert (got["sun", "round"].sku, got["sun", "round"].tagged) == (1, 2)
    assert got["sun", "round"].relative_depth == pytest.approx(0.2 - 0.7 / 3, abs=1e-4)


def test_gaps_need_a_comparable_shelf(spark, market):
    rules = Rules(min_tagged=1, max_unmapped=0.6, opportunity_share=0.4, risk_share=0.5)
    cells = S.shelf(*market, by_type=True, rules=rules)
    snaps = spark.createDataFrame([("shape", c, NOW.date(), st, m) for c, st, m in (("round", "en_hausse", 0.5), ("square", "en_baisse", -0.4), ("shield", "au_pic", 0.1))], "dimension string, code string, week date, status string, momentum double")
    rows = G.shelf_gaps(snaps, cells, NOW.date(), True, rules).collect()
    got = {(r.shelf, r.code): (r.kind, r.sku) for r in rows}
    assert got == {("sun", "square"): ("risk", 1), ("optical", "square"): ("risk", 1), ("sun", "shield"): ("opportunity", 0)}  # no shield gap on the optical shelf


def test_pairings_count_frames_once_per_partner(spark, market):
    _, _, sources = market
    products = spark.createDataFrame([product(1, 1, rank=2, fl=flags(best=True)), product(2, 1, rank=0, fl=flags(best=True)), product(3, 2), product(4, 2, active=False)], schema_of("products"))
    tags = tags_of(spark, [(1, "lamination", "blue+red", "A"), (1, "lamination", "blue+red", "B"), (1, "lamination", "blue+green+red", "C"), (2, "lamination", "blue+red", "A"), (3, "lamination", "blue+odd", "A"), (4, "lamination", "blue+red", "A")])
    known = spark.createDataFrame([("blue",), ("red",), ("green",)], "code string")
    rows = P.pairing_rows(products, tags, sources, known)
    assert [(r.partner, r.frames, r.bestsellers, round(r.share, 4)) for r in P.color_pairings(rows, "blue").orderBy("place").collect()] == [("red", 2, 2, 0.6667), ("green", 1, 1, 0.3333)]
    assert [r.name for r in P.pairing_examples(rows).where("color = 'blue' AND partner = 'red'").orderBy("n").collect()] == ["P1", "P2"]  # a rank of 0 goes last
    assert {r.store for r in P.color_stores(rows).where("color = 'blue'").collect()} == {"Alpha", "Beta"}


def crawl(id, source, status, days, error=None, skipped=None, problems=None):
    at = None if days is None else NOW - timedelta(days=days)
    return (id, source, at, at, status, "due", None, None, None, None, None, None, skipped, problems, error)


CASES = {  # crawl log -> expected (status, due, reason)
    "never": ([], ("never", True, "never crawled")),
    "fresh": ([("ok", 2)], ("ok", False, "complete crawl 2 d ago, every 7 d")),
    "slack": ([("ok", 6.6)], ("ok", True, "last complete crawl 7 d ago")),
    "late": ([("ok", 15)], ("late", True, "last complete crawl 15 d ago")),
    "failed now": ([("ok", 8), ("failed", 0.5, "Timeout")], ("failed", False, "failed crawl 12 h ago, retry after 20 h")),
    "retry": ([("ok", 8), ("incomplete", 1)], ("incomplete", True, "last complete crawl 8 d ago (retrying a incomplete crawl)")),
    "interrupted": ([("ok", 8), ("failed", 0.1, "interrupted: killed")], ("ok", True, "last complete crawl 8 d ago")),
    "never complete": ([("failed", 3, "Timeout")], ("failed", True, "no complete crawl yet")),
}


def test_store_status_and_due_decision(spark):
    stores, sources, log = [], [], []
    for k, (name, (entries, _)) in enumerate(CASES.items(), start=1):
        stores.append((f"{name}.test", name, f"https://{k}.test", "TN", 7))
        sources.append((k, name, "store", f"https://{k}.test", "fr", "TN", True))
        for j, e in enumerate(entries):
            log.append(crawl(k * 10 + j, k, e[0], e[1], e[2] if len(e) > 2 else None, problems=["/a page 1: not fetched"] if e[0] == "incomplete" else None))
    stores = spark.createDataFrame(stores, "domain string, name string, base_url string, country string, crawl_every_days int")
    sources, log = spark.createDataFrame(sources, schema_of("sources")), spark.createDataFrame(log, schema_of("store_crawls"))
    products = spark.createDataFrame([], schema_of("products"))
    status = {r.name: r for r in C.store_status(stores, sources, log, products, NOW).collect()}
    due = {r.name: r for r in C.due_stores(stores, sources, log, NOW).collect()}
    assert {n: (status[n].status, due[n].due, due[n].reason) for n in CASES} == {n: e for n, (_, e) in CASES.items()}
    assert status["retry"].detail == "/a page 1: not fetched" and status["failed now"].detail == "Timeout"
    assert {r.reason for r in C.due_stores(stores, sources, log, NOW, force=True).collect()} == {"forced"}


def test_new_and_retired_products(spark, market):
    _, tags, sources = market
    products = spark.createDataFrame([product(1, 3, first=NOW - 5 * DAY), product(2, 3, first=NOW - 40 * DAY), product(3, 3, active=False, dropped=NOW - 3 * DAY), product(4, 1, first=NOW - 5 * DAY)], schema_of("products"))
    log = spark.createDataFrame([crawl(1, 3, "ok", 60), crawl(2, 1, "failed", 60)], schema_of("store_crawls"))
    starts = C.baselines(log)
    assert [r.id for r in C.new_products(products, starts, NOW).collect()] == [1]  # store 1 has no complete crawl
    assert [r.id for r in C.retired_products(products, starts, NOW).collect()] == [3]
    scope = C.creator_scope(sources, starts)
    assert [tuple(r) for r in C.new_by_store(products, scope, NOW).collect()] == [("Brand", 1, 1, 2)]
    assert [(r.code, r.new, r.share_new) for r in C.new_by_attribute(products, tags, scope, NOW).collect()] == [("red", 1, None), ("round", 1, None)][::-1]


def test_sample_keeps_room_for_new_arrivals(spark, market):
    _, _, sources = market
    rows = [product(k, 1, rank=k, fl=flags(best=True)) for k in range(1, 7)] + [product(10, 1, rank=50, first=NOW - 2 * DAY), product(11, 1, rank=60, first=NOW - 2 * DAY, fl=flags(out=True)), product(20, 2, rank=1)]
    products = spark.createDataFrame(rows, schema_of("products"))
    tags = tags_of(spark, [(r[0], "shape", "round", None) for r in rows])
    log = spark.createDataFrame([crawl(1, 1, "ok", 60)], schema_of("store_crawls"))
    sample = R.presence_sample(products, tags, sources, log, "shape", "round", NOW)
    assert [r.id for r in sample.collect()] == [1, 20, 2, 3, 10]  # round-robin, then the last slot for the in-stock new frame


# --- sync ------------------------------------------------------------------------------------------

def obs(source, slug, seq=1, fl=None, at=NOW):
    return (source, source, seq, f"https://s{source}.test/p/{slug}", f"N{slug}{seq}", None, 10.0, None, "TND", None, fl, None, at)


@pytest.fixture()
def step(spark):
    def run(catalog, batch, listed=(), problems=None, gaps=None, source=1, accept=False):
        o = spark.createDataFrame(batch, schema_of("product_observations"))
        lst = spark.createDataFrame([(source, u) for u in listed], "source_id long, url string")
        reports = spark.createDataFrame([] if problems is None else [(source, problems)], "source_id long, problems array<string>")
        g = None if gaps is None else spark.createDataFrame([(source, *x, k) for k, x in enumerate(gaps)], "source_id long, facet string, label string, flag string, per_variant boolean, ord int")
        return H.sync(catalog, o, lst, reports, g, NOW, accept_drops=accept)
    return run


def actions(df):
    return {r.url.rsplit("/", 1)[-1]: r.action for r in df.collect()}


def stored(spark, slugs, source=1, **kw):
    return spark.createDataFrame([product(100 + k, source, **kw)[:2] + (f"https://s{source}.test/p/{s}",) + product(100 + k, source, **kw)[3:] for k, s in enumerate(slugs)], schema_of("products"))


def test_insert_update_drop_and_reactivate(spark, step):
    empty = spark.createDataFrame([], schema_of("products"))
    first = step(empty, [obs(1, "a", 1), obs(1, "a", 2), obs(1, "b", 3)], problems=[])
    assert actions(first) == {"a": "inserted", "b": "inserted"} and {r.name for r in first.collect()} == {"Na2", "Nb3"}  # the last of the batch wins
    catalog = stored(spark, ["a", "b", "c"])
    assert actions(step(catalog, [obs(1, "a"), obs(1, "b")], listed=["https://s1.test/p/c"], problems=[])) == {"a": "updated", "b": "updated", "c": "kept"}
    gone = stored(spark, ["a"], active=False, dropped=NOW - DAY)
    back = step(gone, [obs(1, "a")], problems=[]).first()
    assert (back.action, back.is_active, back.dropped_at) == ("reactivated", True, None)


def test_drop_guard_at_seventy_percent(spark, step):
    ten = stored(spark, list("abcdefghij"))
    seen = lambda n: [obs(1, s) for s in "abcdefghij"[:n]]
    assert sum(a == "dropped" for a in actions(step(ten, seen(7), problems=[])).values()) == 3  # exactly 70 % passes
    assert sum(a == "dropped" for a in actions(step(ten, seen(6), problems=[])).values()) == 0
    assert sum(a == "dropped" for a in actions(step(ten, seen(6), problems=[], accept=True)).values()) == 4
    assert sum(a == "dropped" for a in actions(step(ten, seen(9), problems=["/a page 2: not fetched"])).values()) == 0
    assert sum(a == "dropped" for a in actions(step(ten, seen(9))).values()) == 0  # no report, no drops
    lst = spark.createDataFrame([], "source_id long, url string")
    reports = spark.createDataFrame([(1, [])], "source_id long, problems array<string>")
    o = spark.createDataFrame(seen(6), schema_of("product_observations"))
    assert H.drop_decisions(ten, o, lst, reports, NOW).first().drop_skipped == "listing shrank 10 -> 6"


def test_a_url_of_another_store_is_left_alone(spark, step):
    catalog = spark.createDataFrame([product(1, 2)[:2] + ("https://s1.test/p/a",) + product(1, 2)[3:]], schema_of("products"))
    assert actions(step(catalog, [obs(1, "a")], problems=[])) == {"a": "kept"}


CARRY = [  # old specs, new specs, old best, new best, gaps -> specs, best
    ({"Materials": "Acetate, Metal"}, {"Materials": "Acetate"}, None, None, [("Materials", "Metal", None, False)], {"Materials": "Acetate, Metal"}, None),
    ({"Materials": "Acetate"}, {"Materials": "Acetate"}, None, None, [("Materials", "Metal", None, False)], {"Materials": "Acetate"}, None),
    ({"Materials": "Metal"}, None, None, True, [("Materials", "Metal", None, False)], {"Materials": "Metal"}, True),
    (None, {"Forme": "Round"}, True, None, [("Best", "Yes", "is_bestseller", False)], {"Forme": "Round"}, True),
    (None, None, False, None, [("Best", "Yes", "is_bestseller", False)], None, False),
    (None, None, True, False, [("Best", "Yes", "is_bestseller", False)], None, False),
]


@pytest.mark.parametrize("old_specs, new_specs, old_best, new_best, gaps, specs, best", CARRY)
def test_carry_over(spark, step, old_specs, new_specs, old_best, new_best, gaps, specs, best):
    catalog = stored(spark, ["a"], fl=flags(old_specs, old_best))
    row = step(catalog, [obs(1, "a", fl=flags(new_specs, new_best))], problems=[], gaps=gaps).first()
    assert (row.flags.raw_specs, row.flags.is_bestseller) == (specs, best)
    assert row.carried == ((specs, best) != (new_specs, new_best))


def test_carry_over_of_a_variant_colour(spark, step):
    v = lambda code, color: (code, color, None, None, None, None, None, None)
    catalog = stored(spark, ["a"], fl=flags({"Couleur": "Red"}, variants=[v("RP", "Red"), v("BM", "Blue")]))
    row = step(catalog, [obs(1, "a", fl=flags({"Couleur": "Blue"}, variants=[v("RP", None), v("BM", "Blue")]))], problems=[], gaps=[("Couleur", "Red", None, True)]).first()
    assert row.flags.raw_specs == {"Couleur": "Blue, Red"} and [x.color for x in row.flags.variants] == ["Red", "Blue"]


def test_replay_is_sequential(spark):
    empty = spark.createDataFrame([], schema_of("products"))
    lst = spark.createDataFrame([], "source_id long, url string")
    reports = spark.createDataFrame([(1, [])], "source_id long, problems array<string>")
    batch = lambda slugs: spark.createDataFrame([obs(1, s) for s in slugs], schema_of("product_observations"))
    steps = [(batch(s), lst, reports, None) for s in ("abcdefghij", "abcdefg", "abcde")]
    end = H.replay(empty, steps, NOW)
    # 10 -> 7 dropped three; 7 -> 5 is 71 % of the seven left, so two more go
    assert {r.url[-1] for r in end.where("is_active").collect()} == set("abcde")


def test_tag_changes_treat_a_missing_supplier_code_as_a_value(spark, rows):
    a = tags_of(spark, [(1, "color", "red", None), (1, "color", "red", "A"), (1, "shape", "round", None)])
    b = tags_of(spark, [(1, "color", "red", "A"), (1, "shape", "round", None), (1, "color", "blue", None)]).withColumn("term", F.when(F.col("code") == "round", "pantos").otherwise(F.col("term")))
    assert rows(H.tag_changes(a, b), "code", "supplier_code", "change") == [("blue", None, "added"), ("red", "A", "same"), ("red", None, "removed"), ("round", None, "changed")]
