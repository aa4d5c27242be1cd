"""What grows with the input: the side a join broadcasts, the tasks a query has, how often an input is read."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwave.functions import numbers as N
from shelfwave.operators import annotations as A, crawl as W, markup as K, phrases as X
from shelfwave.plans.catalogue import markup_queries, stream_queries, text_queries
from shelfwave.sources import samples as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def part_table(spark, tmp_path) -> str:
    rows = [(k, f"{'red' if k % 2 else 'large'} ring", "Brand#1", "SMALL", k % 50, 900.0 + k) for k in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_heavy_rows_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    sf, cores = part_table(spark, tmp_path), spark.sparkContext.defaultParallelism
    deep = markup_queries.json_ld_deep_products(spark, sf)
    assert cores > 1 and deep.rdd.getNumPartitions() == cores
    assert {(r["page_id"], r["depth"]) for r in deep.collect()} == {(k, 1 + 3 * (k % 40)) for k in range(90)}
    assert text_queries.mention_stances(spark, sf).rdd.getNumPartitions() == cores


@pytest.mark.parametrize("key", ["itemListElement", r"\u0069temListElement", r"item\u004cist\u0045lement"])
def test_nested_keys_are_followed_however_they_are_written(spark, key):
    text = '{"@type":"A","%s" :[{"item":{"@type":"B","@graph":[["x",{"@type":"C","%s":{"@type":"D","n":["[",":"]}}]]}},null,{}]}' % (key, key)
    page = spark.createDataFrame([(f'<script type="application/ld+json">{text}</script>',)], "html string")
    found = page.select(F.inline(K.json_ld_nodes(F.col("html")))).select("path", F.try_variant_get("node", "$['@type']", "string").alias("t")).collect()
    assert [(r["path"], r["t"]) for r in found] == [([0], "A"), ([0, 1, 0], None), ([0, 1, 2], None), ([0, 1, 0, 2], "B"), ([0, 1, 0, 2, 0, 0, 1], "C"), ([0, 1, 0, 2, 0, 0, 1, 1], "D")]


def mentions(spark, path):
    table = spark.createDataFrame([("color", "red", "red"), ("color", "deep red", "red"), ("shape", "ring", "round")], "`group` string, phrase string, code string")
    return A.mentions_by_index(spark.read.parquet(path), table)


def test_texts_are_never_broadcast_to_a_dictionary(spark, tmp_path, monkeypatch):
    rows = [(k, f"Deep red ring {k}", "filler " * k + "red returns") for k in range(30)]
    docs = spark.createDataFrame(rows, "id long, title string, text string")
    docs.withColumns({"published_at": F.lit(None).cast("timestamp"), "collected_at": F.lit("2024-01-02").cast("timestamp")}).write.parquet(f"{tmp_path}/docs")
    small = mentions(spark, f"{tmp_path}/docs")
    assert plan(small).count("BuildRight") == 2 and "BuildLeft" not in plan(small)
    monkeypatch.setattr(X, "MAX_BROADCAST_BYTES", 0)
    large = mentions(spark, f"{tmp_path}/docs")
    assert "BroadcastHashJoin" not in plan(large)
    got = sorted(map(tuple, small.collect()), key=str)
    assert got == sorted(map(tuple, large.collect()), key=str) and len(got) == 60


def test_a_price_text_is_built_once_for_the_price_and_once_for_its_currency(spark):
    frame = spark.createDataFrame([("1 234,50", "DT"), ("1,234.50", "eur"), ("-", "$"), (None, "x")], "a string, b string")
    price, currency = N.price_of(F.concat_ws("~", F.reverse("a"), "b"))
    assert plan(frame.select(price.alias("p"), currency.alias("c"))).count("reverse(") <= 2
    price, currency = N.price_of(F.concat_ws(" ", "a", "b"))
    assert [tuple(r) for r in frame.select(price, currency).collect()] == [(1234.5, "TND"), (1234.5, "EUR"), (None, None), (None, None)]


def test_kept_cards_read_the_listing_once(spark, tmp_path, rows):
    cards = [(1, "u1", 0, 1, 5, "m"), (1, "u2", 0, 1, 5, "m"), (1, "u3", 0, 2, 1, "m"), (1, "u4", 0, 1, 9, None), (1, "u5", 0, 1, 9, None), (2, "u1", 1, 1, 1, "m"), (None, "u6", 0, 1, 1, "m"), (None, "u7", 0, 1, 1, None)]
    spark.createDataFrame(cards, "crawl_id long, url string, entry int, page int, pos long, m string").write.parquet(f"{tmp_path}/cards")
    models = F.when(F.col("url").isin("u1", "u2", "u3", "u6"), "m")
    kept = W.kept_cards(W.first_appearances(spark.read.parquet(f"{tmp_path}/cards"), models))
    assert plan(kept).count("FileScan") == 1
    assert rows(kept, "crawl_id", "url") == sorted([(1, "u1"), (1, "u2"), (1, "u4"), (1, "u5"), (2, "u1"), (None, "u7")], key=lambda r: [str(v) for v in r])


def test_streamed_batches_have_files_by_the_size_of_their_table(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "x" * 50) for k in range(300)], "id long, t string").write.parquet(f"{tmp_path}/table")
    table = S.spread(spark.read.parquet(f"{tmp_path}/table"))
    monkeypatch.setattr(stream_queries, "FILE_BYTES", 64)
    stream_queries.stream_of(spark, table, f"{tmp_path}/in", table)
    assert len(list(Path(f"{tmp_path}/in").glob("*.parquet"))) > 6
