"""Views that give a TPC-H-like star schema the library's table shapes (see FIXTURES.md, part B).

Used by the benchmark and the registered queries; everything is a Spark plan over the given tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwave.functions.dates import week_start
from shelfwave.operators.joins import placed

TODAY = date(2001, 9, 26)           # scoring day of the sample: report week 2001-09-24
CATALOG_NOW = datetime(2000, 7, 15)  # catalog clock of the sample
STATUS_NOW = datetime(2001, 8, 5)    # crawl-log clock of the sample
SYNC_CUT = date(2001, 1, 1)          # observations before it are the stored catalog, those after it the new crawl


_SCHEMAS: dict[str, object] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One sample table; its file footers are read once per process, then the schema is declared."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to every core when the input has fewer files than cores, for work that is heavy per row. A table of many
    files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def words(column: str) -> tuple[Column, Column]:
    parts = F.split(F.col(column), " ")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    kind = F.pmod("s_nationkey", F.lit(4))
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"),
                    F.when(kind == 0, "store").when(kind == 1, "press").when(kind == 2, "news").otherwise("social").alias("kind"),
                    F.concat(F.lit("https://store"), F.col("s_suppkey"), F.lit(".example")).alias("url"),
                    F.when(kind == 1, "en").otherwise("fr").alias("lang"),
                    F.when(F.col("r_name") == "AFRICA", "TN").when(F.col("r_name") == "EUROPE", F.lit(None))
                    .otherwise(F.concat(F.lit("X"), F.col("n_regionkey"))).alias("country"),
                    (F.col("s_acctbal") >= 0).alias("active")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order."""
    priority = F.substring("o_orderpriority", 1, 1)
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.pmod("o_custkey", F.lit(10)).cast("long").alias("source_id"),
        F.concat(F.lit("doc:"), F.col("o_orderkey")).alias("url"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, "en").otherwise("fr").alias("lang"),
        F.when(priority != "5", F.col("o_orderdate")).alias("published_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("collected_at"),
        F.when((F.col("o_orderstatus") == "P") & (priority < "3"), "pending")
        .when((F.col("o_orderstatus") == "P") & (priority == "3"), "irrelevant").otherwise("extracted").alias("status"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("résumé "), F.col("o_orderkey"))).alias("summary_fr"),
        F.array(F.concat(F.lit("Brand#"), F.pmod("o_custkey", F.lit(25))),
                F.concat(F.lit("House#"), F.pmod("o_custkey", F.lit(7)))).alias("brands"),
        F.when(priority == "1", F.lit(None).cast("string")).when(priority == "2", "v1").when(priority == "3", "v2")
        .otherwise("v1+color@v2").alias("prompt_version"),
        (F.pmod("o_custkey", F.lit(50)) == 0).alias("is_demo"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per order line: dimension = part type, code = first word of the part name."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("id"),
        F.col("l_orderkey").alias("document_id"),
        F.col("p_type").alias("dimension"), words("p_name")[0].alias("code"),
        F.when(F.col("l_returnflag") == "A", "rising").when(F.col("l_returnflag") == "R", "declining")
        .otherwise("neutral").alias("stance"),
        F.concat_ws(" ", F.col("p_name"), F.col("l_suppkey")).alias("evidence"),
        F.to_date("l_shipdate").alias("occurred_on"))


def search_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity per attribute, language, country and week of the open lines."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    odd = F.pmod("l_linenumber", F.lit(2)) == 1
    lang = F.pmod("l_linenumber", F.lit(3))
    return (line.where(F.col("l_linestatus") == "O").join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("p_type").alias("dimension"), words("p_name")[0].alias("code"),
                    F.when(lang == 0, "fr").when(lang == 1, "en").otherwise("de").alias("lang"),
                    F.when(odd, "FR").otherwise("").alias("geo"), week_start(F.col("l_shipdate")).alias("week"),
                    F.col("l_quantity").alias("q"),
                    (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("i"))
            .groupBy("dimension", "code", "lang", "geo", "week")
            .agg(F.max("i").alias("id"), F.avg("q").alias("value"))
            .select("id", "dimension", "code", F.col("code").alias("keyword"), "lang", "geo", "week", "value",
                    (F.pmod("id", F.lit(50)) == 0).alias("is_demo")))


def daily_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values per keyword, as an interest service returns them."""
    events = load(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("dimension"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(8))).alias("code"),
                         F.lit("en").alias("lang"), F.lit("").alias("geo"), F.to_date("ts").alias("day"),
                         F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.floor("value").cast("double")).alias("value"))


def product_base(spark: SparkSession, sf_dir: str, until: date | None = None) -> DataFrame:
    """One row per (supplier, part) seen in the order lines, before naming the columns."""
    line = load(spark, sf_dir, "lineitem")
    if until is not None:
        line = line.where(F.col("l_shipdate") < F.lit(until))
    return placed(line, "l_partkey").groupBy("l_suppkey", "l_partkey").agg(  # the join with the parts needs no other exchange
        F.max("l_extendedprice").alias("top"), F.max("l_discount").alias("cut"), F.min("l_shipdate").alias("first_day"),
        F.max("l_shipdate").alias("last_day"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, part = product_base(spark, sf_dir), load(spark, sf_dir, "part")
    supplier, nation = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    first, second = words("p_name")
    stated = [("Couleur", 2, first), ("Matière du cadre", 3, second), ("Style", 5, F.col("p_brand")), ("Pont", 7, F.lit("18"))]
    specs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), (F.pmod("p_size", F.lit(m)) == 0).alias("on"))
                               for k, m, v in stated]), lambda e: e["on"])
    active = F.col("last_day") >= F.lit(date(2000, 7, 1))
    return (base.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select((F.col("l_suppkey") * 10_000_000_000 + F.col("l_partkey")).alias("id"),
                    F.col("l_suppkey").cast("long").alias("source_id"),
                    F.concat(F.lit("https://store"), F.col("l_suppkey"), F.lit(".example/p/"), F.col("l_partkey")).alias("url"),
                    F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
                    (F.col("top") * (1 - F.col("cut"))).alias("price"),
                    F.when(F.pmod("l_suppkey", F.lit(5)) != 0, F.col("top")).alias("list_price"),
                    F.when(F.col("n_regionkey") == 0, "TND").when(F.col("n_regionkey") == 1, "USD")
                    .when(F.col("n_regionkey") == 3, "EUR").otherwise("GBP").alias("currency"),
                    F.when(F.pmod("p_partkey", F.lit(11)) != 0, F.col("p_size")).cast("int").alias("rank"),
                    F.struct(F.map_from_entries(F.transform(specs, lambda e: F.struct(e["key"], e["value"]))).alias("raw_specs"),
                             (F.col("p_retailprice") > 980).alias("is_bestseller"),
                             (F.pmod("p_partkey", F.lit(3)) == 0).alias("out_of_stock")).alias("flags"),
                    F.lit(None).cast("string").alias("image_url"),
                    F.col("last_day").alias("seen_at"), F.col("first_day").alias("first_seen_at"),
                    active.alias("is_active"), F.when(~active, F.col("last_day")).alias("dropped_at")))


def product_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every product: colour (twice for parts with two supplier codes), material, shape, type and lamination."""
    keys = placed(load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_partkey").distinct()  # the join needs no other exchange
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    first, second = words("p_name")
    neighbour = part.select((F.col("p_partkey") - 1).alias("n_key"), first.alias("next_word"))
    described = (part.join(neighbour, F.col("p_partkey") == F.col("n_key"), "left")
                 .withColumn("word", first).withColumn("stuff", second))
    none = F.lit(None).cast("string")

    def tag(dimension: str, code: Column, supplier: Column, keep: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), code.alias("code"), supplier.alias("supplier_code"), keep.alias("keep"))

    layers = F.array_sort(F.array_distinct(F.array("word", "next_word")))
    coded = F.pmod("p_size", F.lit(4)) == 0
    tags = F.filter(F.array(
        tag("color", F.col("word"), F.when(coded, F.concat(F.lit("C"), F.col("p_size"))), F.pmod("p_partkey", F.lit(10)) < 8),
        tag("color", F.col("word"), F.concat(F.lit("D"), F.col("p_size")), coded & (F.pmod("p_partkey", F.lit(10)) < 8)),
        tag("material", F.col("stuff"), none, F.pmod("p_partkey", F.lit(7)) != 0),
        tag("shape", F.col("p_type"), none, F.lit(True)),
        tag("product_type", F.when(F.pmod("p_partkey", F.lit(2)) == 0, "optical").otherwise("sun"), none, F.lit(True)),
        tag("lamination", F.array_join(layers, "+"), none,
            F.col("next_word").isNotNull() & (F.size(layers) > 1) & (F.pmod("p_partkey", F.lit(3)) == 0)),
    ), lambda t: t["keep"])
    by_part = described.select("p_partkey", F.explode(tags).alias("t"))
    return (keys.join(by_part, F.col("l_partkey") == F.col("p_partkey"))
            .select((F.col("l_suppkey") * 10_000_000_000 + F.col("l_partkey")).alias("product_id"), "t.dimension", "t.code", F.lit("name").alias("field"), F.col("t.code").alias("term"),
                    F.lit(1).alias("rules_version"),
                    F.when(F.col("t.dimension") == "color", F.col("t.code")).alias("color_family"),
                    F.lit(None).cast("string").alias("color_hex"), "t.supplier_code"))


def store_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "incomplete").otherwise("failed")
    low = F.col("o_orderpriority") == "5-LOW"
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        key.cast("long").alias("id"), F.pmod("o_custkey", F.lit(100)).cast("long").alias("source_id"),
        (F.col("o_orderdate") - F.expr("INTERVAL 1 HOUR")).alias("started_at"),
        (F.col("o_orderdate") + F.make_interval(secs=F.pmod(key, F.lit(86400)))).alias("finished_at"),
        status.alias("status"),
        F.when((status == "ok") & (F.pmod(key, F.lit(4)) == 0), F.concat(F.lit("listing shrank 100 -> "), F.pmod(key, F.lit(70)))).alias("drop_skipped"),
        F.when(status == "incomplete", F.array(F.concat(F.lit("/sun page "), F.pmod(key, F.lit(9)), F.lit(": not fetched")))).alias("problems"),
        F.when((status == "failed") & low, F.lit("interrupted: the process ended"))
        .when(status == "failed", F.concat(F.lit("Timeout after "), F.pmod(key, F.lit(60)))).alias("error"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configured store per supplier; every 13th has no source row yet."""
    rows = sources(spark, sf_dir)
    return rows.select(F.concat(F.lit("store"), F.col("id"), F.lit(".example")).alias("domain"), "name",
                       F.when(F.pmod("id", F.lit(13)) == 12, F.concat(F.lit("https://new"), F.col("id"), F.lit(".example")))
                       .otherwise(F.col("url")).alias("base_url"), "country",
                       (F.lit(3) + F.pmod("id", F.lit(20))).cast("int").alias("crawl_every_days"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of the sample as a dictionary: every (part type, first word), labelled and numbered."""
    part = load(spark, sf_dir, "part")
    first, _ = words("p_name")
    codes = part.select(F.col("p_type").alias("dimension"), first.alias("code")).distinct()
    return codes.select("dimension", "code", F.initcap("code").alias("label"),
                        F.concat(F.lit("#"), F.lower(F.substring(F.md5("code"), 1, 6))).alias("hex"),
                        (F.col("code") == "hot").alias("multicolor"))


def quarter_index(day: Column) -> Column:
    return (F.year(day) - 1995) * 4 + F.quarter(day) - 1


def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl per supplier and quarter; each order line is a card."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_suppkey") * 100 + quarter_index(F.col("l_shipdate"))).alias("crawl_id"), F.col("l_suppkey").alias("source_id"),
        F.pmod("p_size", F.lit(3)).cast("int").alias("entry"), (F.pmod("l_orderkey", F.lit(3)) + 1).cast("int").alias("page"),
        F.col("l_partkey").alias("pos"),
        F.concat(F.lit("https://store"), F.col("l_suppkey"), F.lit(".example/p/m"), F.pmod("l_partkey", F.lit(50)), F.lit("-"), F.col("l_partkey")).alias("url"),
        F.when(F.pmod("p_size", F.lit(3)) > 0, F.concat(F.lit("cat"), F.pmod("p_size", F.lit(3)))).alias("category"),
        "l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey", "l_quantity")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order line number of a supplier's quarter; some are empty or were not fetched."""
    line = load(spark, sf_dir, "lineitem")
    cards = F.count_if(F.col("l_returnflag") != "N")
    return (line.groupBy((F.col("l_suppkey") * 100 + quarter_index(F.col("l_shipdate"))).alias("crawl_id"),
                         F.pmod("l_linenumber", F.lit(2)).cast("int").alias("entry"), F.pmod("l_orderkey", F.lit(4)).alias("p"))
            .agg(cards.alias("cards"), F.max("l_quantity").alias("q"), F.min("l_tax").alias("t"))
            .select("crawl_id", "entry", F.concat(F.lit("/list"), F.col("entry")).alias("start"), (F.col("p") + 1).cast("int").alias("page"),
                    (F.col("q") > 12).alias("fetched"), F.when(F.col("q") > 12, F.col("cards")).otherwise(0).alias("cards"),
                    (F.col("t") < 0.03).alias("has_next"), F.lit(4).alias("max_pages"), F.lit(True).alias("paginated"),
                    (F.pmod("crawl_id", F.lit(2)) == 0).alias("via_next")))


def facet_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet passes of the same crawls: return flag is the facet value, line status a flag facet."""
    cards = listing_cards(spark, sf_dir)
    off = F.when((F.pmod("l_orderkey", F.lit(5)) == 0) | (F.pmod("crawl_id", F.lit(7)) == 0), F.concat(F.col("url"), F.lit("?x"))).otherwise(F.col("url"))
    value = F.struct(F.lit("Return").alias("facet"), F.col("l_returnflag").alias("label"), F.lit(None).cast("string").alias("flag"),
                     F.lit(True).alias("per_variant"), F.ascii("l_returnflag").alias("ord"))
    flag = F.struct(F.lit("Best").alias("facet"), F.lit("Yes").alias("label"), F.lit("is_bestseller").alias("flag"), F.lit(False).alias("per_variant"), F.lit(0).alias("ord"))
    units = F.when(F.col("l_linestatus") == "O", F.array(value, flag)).otherwise(F.array(value))
    return cards.select("crawl_id", "source_id", "entry", off.alias("url"), F.col("l_linenumber").cast("string").alias("variant_id"),
                        F.explode(units).alias("u")).select("crawl_id", "source_id", "entry", "url", "variant_id", "u.*")


def facet_pages(spark: SparkSession, sf_dir: str, cards: DataFrame | None = None) -> DataFrame:
    cards = facet_cards(spark, sf_dir) if cards is None else cards
    return (cards.groupBy("crawl_id", "entry", "facet", "label", "flag", "per_variant", "ord").agg(F.count(F.lit(1)).alias("cards"))
            .withColumn("fetched", F.pmod("crawl_id", F.lit(5)) != 0).withColumn("page", F.lit(1)))


def _observed(line: DataFrame, part: DataFrame) -> DataFrame:
    shared = F.pmod("l_partkey", F.lit(17)) == 0
    url = F.when(shared, F.concat(F.lit("https://shared.example/p/"), F.col("l_partkey"))).otherwise(
        F.concat(F.lit("https://store"), F.col("l_suppkey"), F.lit(".example/p/"), F.col("l_partkey")))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("url", url)


def typed_flags(specs: Column, best: Column) -> Column:
    from shelfwave.sources.tables import FLAGS
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return F.struct(specs.alias("raw_specs"), F.lit(None).cast("array<struct<code:string,color:string,in_stock:boolean,layers:array<string>,id:string,parts:array<string>,subparts:array<string>,swatch:string>>").alias("variants"),
                    text.alias("categories"), text.alias("description"), text.alias("material"), best.alias("is_bestseller"), flag.alias("out_of_stock"),
                    flag.alias("is_new"), flag.alias("is_limited")).cast(FLAGS)


def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as left by the order lines before the cut: the last observation of each URL, by its first store."""
    line = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(SYNC_CUT))
    rows = _observed(line, load(spark, sf_dir, "part"))
    one = placed(rows, "url").groupBy("url").agg(F.min("l_suppkey").alias("source_id"), F.min("p_name").alias("name"), F.min("p_brand").alias("brand"),
                                  F.max("l_extendedprice").alias("price"), F.min("l_shipdate").alias("first_seen_at"), F.max("l_shipdate").alias("seen_at"))
    active = F.col("seen_at") >= F.lit(date(2000, 6, 1))
    return one.select(F.xxhash64("url").alias("id"), "source_id", "url", "name", "brand", "price", F.lit(None).cast("double").alias("list_price"),
                      F.lit("TND").alias("currency"), F.lit(None).cast("int").alias("rank"),
                      typed_flags(F.create_map(F.lit("Materials"), F.concat(F.lit("Metal, "), F.col("brand"))), F.lit(True)).alias("flags"),
                      F.lit(None).cast("string").alias("image_url"), F.col("seen_at").cast("timestamp").alias("seen_at"),
                      F.col("first_seen_at").cast("timestamp").alias("first_seen_at"), active.alias("is_active"),
                      F.when(~active, F.col("seen_at").cast("timestamp")).alias("dropped_at"))


def product_observations(spark: SparkSession, sf_dir: str, start: date = SYNC_CUT, end: date | None = None) -> DataFrame:
    """A crawl of every supplier: the order lines from `start` on, before `end`; by default all after the cut."""
    line = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit(start))
    line = line if end is None else line.where(F.col("l_shipdate") < F.lit(end))
    rows = _observed(line, load(spark, sf_dir, "part"))
    return rows.select(F.col("l_suppkey").alias("crawl_id"), F.col("l_suppkey").alias("source_id"),
                       (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "url", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
                       F.col("l_extendedprice").alias("price"), F.lit(None).cast("double").alias("list_price"), F.lit("TND").alias("currency"),
                       F.lit(None).cast("int").alias("rank"),
                       typed_flags(F.create_map(F.lit("Materials"), F.col("p_brand")), F.lit(None).cast("boolean")).alias("flags"),
                       F.lit(None).cast("string").alias("image_url"), F.col("l_shipdate").cast("timestamp").alias("seen_at"))


def crawl_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listed, reports, gaps) of that crawl: URLs on the shelf beside the batch, problems, failed facets."""
    line = load(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit(date(2000, 1, 1))) & (F.col("l_shipdate") < F.lit(SYNC_CUT)))
    seen = _observed(line, load(spark, sf_dir, "part"))
    listed = seen.where((F.col("l_returnflag") != "R") | (F.pmod("l_suppkey", F.lit(3)) == 0)).select(F.col("l_suppkey").alias("source_id"), "url").distinct()
    supplier = load(spark, sf_dir, "supplier")
    broken = F.pmod("s_suppkey", F.lit(6)) == 1
    reports = supplier.select(F.col("s_suppkey").alias("source_id"), F.when(broken, F.array(F.lit("/a page 2: not fetched"), F.lit("/b: first page listed nothing")))
                              .otherwise(F.array().cast("array<string>")).alias("problems"))
    text = F.lit(None).cast("string")
    units = F.array(F.struct(F.lit("Materials").alias("facet"), F.lit("Metal").alias("label"), text.alias("flag"), F.lit(False).alias("per_variant"), F.lit(0).alias("ord")),
                    F.struct(F.lit("Best").alias("facet"), F.lit("Yes").alias("label"), F.lit("is_bestseller").alias("flag"), F.lit(False).alias("per_variant"), F.lit(1).alias("ord")))
    gaps = supplier.where(F.pmod("s_suppkey", F.lit(4)) == 0).select(F.col("s_suppkey").alias("source_id"), F.explode(units).alias("u")).select("source_id", "u.*")
    return listed, reports, gaps
