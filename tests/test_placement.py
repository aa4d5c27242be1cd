"""Rows are placed by the size of their input, so no task holds more when there is more of it."""


from shelfwave.operators import history as H, ingest as I, shelf
from shelfwave.operators.joins import placed, scanned_bytes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def tags_of(spark, rows):
    return spark.createDataFrame(rows, "id long, product_id long, dimension string, code string, field string, supplier_code string")


def test_placement_follows_the_size_of_the_files(spark, tmp_path):
    folder = str(tmp_path / "a b")
    spark.range(200_000).selectExpr("id", "cast(xxhash64(id) as string) as text").write.parquet(folder)
    stored = spark.read.parquet(folder)
    size = sum(f.stat().st_size for f in (tmp_path / "a b").glob("*.parquet"))
    assert scanned_bytes(stored.where("id > 3").select("text")) == size
    assert placed(stored, "id", each=size // 50).rdd.getNumPartitions() in (50, 51)
    assert placed(spark.range(5), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_duplicate_keys_are_counted_where_they_are_placed(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, None), (1, None), (2, "a"), (None, None), (None, None), (None, None)]
    spark.createDataFrame(rows, "k long, c string").write.parquet(str(tmp_path / "t"))
    found = I.duplicate_keys(spark.read.parquet(str(tmp_path / "t")), ("k", "c"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 2), (1, None, 2), (None, None, 3)], key=str)
    assert plan(found).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(found)


def test_tags_collapse_without_sorting_what_is_not_placed(spark):
    rows = [(7, 1, "color", "red", "name", "D1"), (5, 1, "color", "red", "name", "C1"), (9, 1, "color", "blue", "name", None), (3, 2, "color", "red", "name", None),
            (None, 4, "shape", "round", "name", "E"), (2, None, "shape", "round", "name", None), (None, 1, "color", "red", "name", "X")]
    got = H.collapse_duplicate_tags(tags_of(spark, rows))
    assert got.columns == ["id", "product_id", "dimension", "code", "field", "supplier_code"]
    assert {tuple(r) for r in got.collect()} == {(5, 1, "color", "red", "name", "C1"), (9, 1, "color", "blue", "name", None), (3, 2, "color", "red", "name", None),
                                                 (None, 4, "shape", "round", None, None), (2, None, "shape", "round", "name", None)}
    narrow = plan(got.select("id", "supplier_code"))
    assert "SortAggregate" not in narrow and narrow.count("Exchange") == 1
    assert not any("field" in line for line in narrow.splitlines() if "Exchange" in line or "Window" in line)  # moved only where it is read


def stepwise(catalog, steps, now):
    from shelfwave.session import cut_lineage
    for observations, listed, reports, gaps in steps:
        catalog = cut_lineage(H.sync(catalog, observations, listed, reports, gaps, now).drop("action", "carried"))
    return catalog


def test_a_replay_equals_its_steps(spark, rows):
    import random
    from datetime import datetime

    from shelfwave.sources.tables import schema_of

    pick, now = random.Random(5), datetime(2026, 9, 30)
    at = lambda d: datetime(2026, 1, 1 + d)
    url = lambda k: None if k == 39 else f"https://s.test/{k}"
    store = lambda k: None if k == 38 else k % 5
    catalog = [(k, store(k), url(k), f"n{k}", None, 1.0, None, "TND", None, None, None, at(0), None if k % 6 == 0 else at(0), k % 4 > 0, None if k % 4 else at(0)) for k in range(20)]
    catalog += [(k, None, url(k), "x", None, 1.0, None, "TND", None, None, None, at(0), at(0), True, None) for k in (20, 39)]
    catalog = spark.createDataFrame(catalog, schema_of("products"))
    steps = []
    for step in range(1, 5):
        seen = [(pick.choice([None, s, s + 10]) if step == 2 else s, pick.choice([s, s, s, None]), n, url(k), f"{step}.{n}", None, float(n), None, "TND", None, None, None, pick.choice([None, at(step)]))
                for n, (k, s) in enumerate((k, pick.choice([k % 5, k % 5, k % 5, (k + 1) % 5])) for k in range(40) if pick.random() < 0.6 for _ in range(pick.choice([1, 2])))]
        listed = [(k % 5, url(k)) for k in range(40) if pick.random() < 0.2]
        reports = [(s, ["x", "y"] if s == step else []) for s in range(5) if s != 4 or step > 2]
        steps.append((spark.createDataFrame(seen, schema_of("product_observations")), spark.createDataFrame(listed, "source_id long, url string"),
                      spark.createDataFrame(reports, "source_id long, problems array<string>"), None))
    want = rows(stepwise(catalog, steps, now).drop("flags"))
    assert rows(H.replay(catalog, steps, now).drop("flags")) == want and len({(r[-2], r[-1] is None) for r in want}) == 2
    twice = [(*s[:2], s[2].union(s[2].where("source_id = 1")), None) for s in steps[:2]]
    assert rows(H.replay(catalog, twice, now).drop("flags")) == rows(stepwise(catalog, twice, now).drop("flags"))


def test_a_replay_moves_its_rows_once(spark, tmp_path):
    from datetime import datetime

    from shelfwave.sources.tables import schema_of

    spark.createDataFrame([], schema_of("products")).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([], schema_of("product_observations")).write.parquet(str(tmp_path / "o"))
    catalog, seen = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "o"))
    reports = spark.createDataFrame([(1, [])], "source_id long, problems array<string>")
    end = plan(H.replay(catalog, [(seen, seen.select("source_id", "url"), reports, None)] * 4, datetime(2026, 9, 30)))
    assert end.count("hashpartitioning(url") <= 3 and "FileScan" in end  # events, what is held, the catalog; not a checkpoint of each step


def test_attributes_are_placed_by_product_and_size(spark):
    tags = tags_of(spark, [(1, 1, "lamination", "red+blue", "name", "D1"), (2, 1, "lamination", "red+blue", "name", "C1"), (3, 1, "shape", "round", "name", None)])
    found = shelf.distinct_attributes(tags, "lamination")
    text = plan(found)
    assert "REPARTITION_BY_NUM" in text and text.count("Exchange") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "lamination", "red+blue")]
