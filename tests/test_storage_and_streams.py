from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from shelfwave.operators import scoring, series
from shelfwave.sources import sinks
from shelfwave.sources.tables import schema_of
from shelfwave.streaming import jobs as J

WEEK = date(2026, 9, 21)


def snapshot(week, mentions, code="round"):
    return ("shape", code, week, mentions, 12.5, 0.333, "en_hausse", 0.5, 0.25)


def test_replaced_snapshots_drop_later_weeks(spark, tmp_path, rows):
    path, weeks = str(tmp_path / "snaps"), [WEEK - timedelta(weeks=k) for k in (2, 1, 0)]
    later = WEEK + timedelta(weeks=1)
    sinks.replace_snapshots(spark.createDataFrame([snapshot(w, 1.0) for w in [*weeks, later]], schema_of("trend_snapshots")), path, weeks[0], [*weeks, later])
    new = spark.createDataFrame([snapshot(w, 2.0) for w in weeks[1:]], schema_of("trend_snapshots"))
    assert sinks.replace_snapshots(new, path, weeks[1], weeks[1:]) == [f"week={later}"]
    assert rows(spark.read.parquet(path), "week", "mentions") == [(weeks[0], 1.0), (weeks[1], 2.0), (weeks[2], 2.0)]


def test_search_interest_upsert_keeps_other_weeks(spark, tmp_path, rows):
    path = str(tmp_path / "interest")
    make = lambda *rs: spark.createDataFrame([(i, "shape", c, kw, "fr", "FR", w, v, False) for i, c, kw, w, v in rs], schema_of("search_interest"))
    sinks.write_partitioned(make((1, "round", "k", WEEK, 1.0), (2, "square", "k", WEEK, 2.0), (3, "round", "k", WEEK - timedelta(weeks=1), 3.0)), path, "week")
    sinks.upsert_search_interest(make((9, "round", "new", WEEK, 10.0), (10, "oval", "new", WEEK, 4.0)), path)
    assert rows(spark.read.parquet(path), "id", "code", "keyword", "value") == [(1, "round", "new", 10.0), (10, "oval", "new", 4.0), (2, "square", "k", 2.0), (3, "round", "k", 3.0)]


def test_spreadsheet_bytes(spark, tmp_path):
    snaps = spark.createDataFrame([snapshot(WEEK, 3.5), ("shape", "oval", WEEK, 10.5, None, -0.5, "faible", None, None)], schema_of("trend_snapshots"))
    labels = spark.createDataFrame([("shape", "round", "Ronde; panto"), ("shape", "oval", "Ovale")], "dimension string, code string, label string")
    sinks.write_export(sinks.export_rows(snaps, labels, "shape", WEEK), str(tmp_path / "csv"))
    files = list((tmp_path / "csv").glob("*.csv"))
    assert len(files) == 1
    text = files[0].read_bytes()
    assert text.startswith(b"\xef\xbb\xbfAttribut;Code;Semaine;") and text.endswith(b"\r\n")
    assert text.decode("utf-8").split("\r\n")[1:] == ["Ovale;oval;2026-09-21;10,5;75,0;-50;Peu de données;;", '"Ronde; panto";round;2026-09-21;3,5;25,0;33;En hausse;25;12,5', ""]


def test_publishing_refuses_duplicate_keys(spark, tmp_path):
    table = spark.createDataFrame([("a", None), ("a", None)], "code string, supplier string")
    with pytest.raises(ValueError, match="not unique"):
        sinks.publish(table, str(tmp_path / "t"), ("code", "supplier"))


# --- streams ---------------------------------------------------------------------------------------

SCHEMA = "dimension string, code string, stance string, kind string, at timestamp"


def landed(spark, folder, batches, schema):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder / f"f{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_weekly_counts_of_a_stream_equal_the_batch(spark, tmp_path, rows):
    at = lambda d, h=0: datetime(2026, 9, d, h)
    batches = [[("shape", "round", "rising", "store", at(21)), ("shape", "round", "declining", "press", at(27, 23))], [("shape", "round", "neutral", "social", at(28)), ("shape", "oval", "rising", "press", at(22))],
               [("shape", "round", "odd", "press", at(21, 5))]]  # the last one is late and updates its week
    batches.append([("shape", "round", "rising", "press", at(1)), ("shape", "round", "rising", "press", datetime(2024, 1, 3))])  # years late counts too
    stream = landed(spark, tmp_path / "in", batches, SCHEMA).withColumn("occurred_on", F.to_date("at"))
    J.maintain_weekly_counts(stream, str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["dimension", "code", "week", "rising", "neutral", "declining", "volume"]
    batch = spark.createDataFrame([r for b in batches for r in b], SCHEMA).withColumn("occurred_on", F.to_date("at"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(series.weekly_counts(batch), *columns)


def test_snapshots_follow_a_mention_stream(spark, tmp_path, rows):
    schema = "dimension string, code string, stance string, occurred_on date, kind string"
    batches = [[("shape", "round", "rising", WEEK - timedelta(days=k), "press")] * 3 for k in range(0, 40, 9)]
    stream = landed(spark, tmp_path / "in", batches, schema)
    interest = spark.createDataFrame([(k, "shape", c, "k", "fr", "FR", WEEK - timedelta(weeks=k), 10.0 * k, False) for k in range(5) for c in ("round", "oval")], schema_of("search_interest"))
    days = iter([WEEK - timedelta(weeks=3)] * 2 + [WEEK] * 9)  # the clock moves on between batches
    J.maintain_snapshots(stream, str(tmp_path / "m"), str(tmp_path / "s"), str(tmp_path / "cp"), lambda: next(days), 6, lambda _: interest).awaitTermination()
    want = scoring.compute_snapshots(spark.createDataFrame([r for b in batches for r in b], schema), interest, WEEK, 6)
    assert rows(spark.read.parquet(str(tmp_path / "s")).where(F.col("week") >= F.lit(WEEK - timedelta(weeks=5))).select(*want.columns)) == rows(want)


def test_documents_are_stored_once_per_url(spark, tmp_path, rows):
    schema = "url string, title string, text string, collected_at timestamp"
    at = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    batches = [[("a", "Lunettes", "x", at(0)), ("a", "Lunettes bis", "x", at(1)), ("b", "Cuisine", "rien", at(0))], [("c", "t" * 600, "new frames", at(2))], [("a", "Lunettes ter", "x", at(300))]]
    stream = landed(spark, tmp_path / "in", batches, schema)
    J.ingest_documents(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "url", "title")
    assert [u for u, _ in got] == ["a", "c"] and len(got[1][1]) == 500


def test_catalog_follows_a_crawl_stream(spark, tmp_path):
    extra = schema_of("product_observations").add("listed_only", T.BooleanType()).add("problems", T.ArrayType(T.StringType()))

    def crawl(crawl_id, slugs, source=1):
        return [(crawl_id, source, k, f"https://s{source}.test/{s}", s, None, 1.0, None, "TND", None, None, None, datetime(2026, 9, crawl_id), False, []) for k, s in enumerate(slugs)]

    # two crawls of one store in one file: the second guard looks at what the first left
    stream = landed(spark, tmp_path / "in", [crawl(1, "abcdefghij") + crawl(2, "abcdefg") + crawl(1, "xy", 2), crawl(3, "abcde")], extra)
    J.maintain_catalog(stream, str(tmp_path / "cat"), str(tmp_path / "cp"), datetime(2026, 9, 30)).awaitTermination()
    end = J.latest_catalog(spark, str(tmp_path / "cat"))
    assert {r.name for r in end.where("is_active AND source_id = 1").collect()} == set("abcde")
    assert {r.name for r in end.where("NOT is_active").collect()} == set("fghij") and end.where("source_id = 2 AND is_active").count() == 2


def test_a_failed_facet_keeps_what_it_did_not_read_again(spark, tmp_path):
    gap = "array<struct<ord:int,facet:string,label:string,flag:string,per_variant:boolean>>"
    extra = schema_of("product_observations").add("listed_only", T.BooleanType()).add("problems", T.ArrayType(T.StringType()))
    extra = extra.add("gaps", T.StructType.fromDDL(f"g {gap}").fields[0].dataType)
    flag_names = [f.name for f in extra["flags"].dataType.fields]
    flags = lambda best: tuple({"is_bestseller": best, "raw_specs": {}}.get(n) for n in flag_names)
    row = lambda crawl, best, gaps: (crawl, 1, 0, "https://s1.test/a", "a", None, 1.0, None, "TND", None, flags(best), None, datetime(2026, 9, crawl), False, [], gaps)
    for name, gaps, kept in (("lost", [(0, "Best", "Yes", "is_bestseller", False)], True), ("read", [], None)):
        stream = landed(spark, tmp_path / name, [[row(1, True, [])], [row(2, None, gaps)], [row(3, None, gaps)]], extra)
        J.maintain_catalog(stream, str(tmp_path / f"{name}-cat"), str(tmp_path / f"{name}-cp"), datetime(2026, 9, 30)).awaitTermination()
        assert [r["flags"]["is_bestseller"] for r in J.latest_catalog(spark, str(tmp_path / f"{name}-cat")).collect()] == [kept]
        assert len(list((tmp_path / f"{name}-cat").glob("v*"))) == 2  # the one before the last batch stays for a repeat


def test_shares_do_not_depend_on_partitions(spark, rows):
    from shelfwave.operators import trends as T_

    made = [("shape", f"c{k}", WEEK, round(0.1 * (k * 7 % 23), 1), None, 0.0, "stable", None, None) for k in range(200)]
    want = None
    for n in (1, 7, 64):
        got = rows(T_.share_of_voice(spark.createDataFrame(made, schema_of("trend_snapshots")).repartition(n), WEEK), "code", "share")
        want = want or got
        assert got == want


def test_upserts_do_not_depend_on_order(spark, rows):
    from shelfwave.operators import ingest as I

    make = lambda rs: spark.createDataFrame([(i, "shape", "round", kw, "fr", "FR", WEEK, v, False) for i, kw, v in rs], schema_of("search_interest")).withColumn("at", F.col("id"))
    stored, batch = [(1, "k", 5.0)], [(7, "b", 3.0), (8, "a", 9.0), (9, "c", 1.0)]
    got = {tuple(rows(I.upserted_interest(make(stored).drop("at"), make(b).repartition(n), "at"), "id", "keyword", "value")) for b in (batch, batch[::-1]) for n in (1, 5)}
    assert got == {((1, "c", 1.0),)}
    wanted = [("u", "press", "fr"), ("u", "news", "en"), ("v", "press", "fr")]
    sources = spark.createDataFrame([], schema_of("sources"))
    named = lambda ws, n: spark.createDataFrame([(f"n{k}", u, k, l, None) for u, k, l in ws], "name string, url string, kind string, lang string, country string").repartition(n)
    ids = {tuple(rows(I.with_sources(sources, named(w, n)), "id", "url", "kind")) for w in (wanted, wanted[::-1]) for n in (1, 4)}
    assert ids == {((1, "u", "news"), (2, "v", "press"))}


def test_every_landed_text_that_a_sitemap_index_leads_to_is_read_once(spark):
    from shelfwave.operators import ingest as I

    index = lambda locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{k}</loc></sitemap>" for k in locs) + "</sitemapindex>"
    texts = {f"https://s.test/{k}.xml": f"<urlset><url><loc>https://s.test/p{k}</loc></url></urlset>" for k in range(120)}
    texts["https://s.test/root"] = index([f"https://s.test/part{k}" for k in range(4)] * 2)
    for k in range(4):  # the parts name the root and each other again, and texts that were never landed
        texts[f"https://s.test/part{k}"] = index([f"https://s.test/{j}.xml" for j in range(150) if j % 4 == k] + ["https://s.test/root", f"https://s.test/part{(k + 1) % 4}"])
    texts["https://s.test/alone"] = "<urlset><url><loc>https://s.test/none</loc></url></urlset>"
    roots = spark.createDataFrame([(1, "https://s.test/root"), (1, "https://s.test/root"), (2, "https://s.test/3.xml"), (3, "https://s.test/gone")], "source_id bigint, loc string")
    landed = spark.createDataFrame(list(texts.items()), "loc string, xml string")
    got = sorted((r["source_id"], r["loc"]) for r in I.sitemap_entries(I.sitemap_texts(roots, landed)).collect())
    assert got == sorted([(1, f"https://s.test/p{k}") for k in range(120)] + [(2, "https://s.test/p3")])


def test_a_batch_reads_the_urls_of_its_buckets_alone(spark, tmp_path):
    from shelfwave.streaming import jobs as J

    path = str(tmp_path / "documents")
    urls = spark.range(400).selectExpr("concat('u', id) as url", "id as n")
    urls.withColumns({"bucket": J.url_bucket(16), "batch": F.lit(0)}).write.partitionBy("bucket", "batch").parquet(path)
    stored = spark.read.parquet(path)
    batch = spark.createDataFrame([("u7",), ("new",)], "url string")
    seen = J.seen_urls(stored, batch, 16)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<url:string>" in plan
    got = {r["url"] for r in seen.collect()}
    assert "u7" in got and len(got) < 100
