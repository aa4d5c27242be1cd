"""Table schemas (declared, never inferred) and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

VARIANT = ("struct<code:string,color:string,in_stock:boolean,layers:array<string>,id:string,parts:array<string>,"
           "subparts:array<string>,swatch:string>")
FLAGS = (f"struct<raw_specs:map<string,string>,variants:array<{VARIANT}>,categories:string,description:string,"
         "material:string,is_bestseller:boolean,out_of_stock:boolean,is_new:boolean,is_limited:boolean>")

SCHEMAS: dict[str, str] = {
    "sources": "id long, name string, kind string, url string, lang string, country string, active boolean",
    "documents": ("id long, source_id long, url string, title string, text string, lang string, published_at timestamp, "
                  "collected_at timestamp, status string, summary_fr string, brands array<string>, "
                  "prompt_version string, is_demo boolean"),
    "mentions": ("id long, document_id long, dimension string, code string, stance string, evidence string, "
                 "occurred_on date"),
    "search_interest": ("id long, dimension string, code string, keyword string, lang string, geo string, week date, "
                        "value double, is_demo boolean"),
    "trend_snapshots": ("dimension string, code string, week date, mentions double, search double, momentum double, "
                        "status string, tone double, decline_share double"),
    "products": ("id long, source_id long, url string, name string, brand string, price double, list_price double, "
                 f"currency string, rank int, flags {FLAGS}, image_url string, seen_at timestamp, "
                 "first_seen_at timestamp, is_active boolean, dropped_at timestamp"),
    "product_tags": ("product_id long, dimension string, code string, field string, term string, rules_version int, "
                     "color_family string, color_hex string, supplier_code string"),
    "store_crawls": ("id long, source_id long, started_at timestamp, finished_at timestamp, status string, "
                     "trigger string, listed int, crawled int, inserted int, updated int, reactivated int, dropped int, "
                     "drop_skipped string, problems array<string>, error string"),
    "stores": ("domain string, name string, base_url string, country string, default_currency string, "
               "default_brand string, url_regex string, model_regex string, name_strip string, crawl_every_days int"),
    "listing_cards": ("crawl_id long, source_id long, entry int, category string, page int, pos int, url string, "
                      "raw_url string"),
    "listing_pages": ("crawl_id long, source_id long, entry int, start string, page int, fetched boolean, cards int, "
                      "has_next boolean"),
    "facet_cards": ("crawl_id long, source_id long, entry int, facet string, label string, flag string, "
                    "per_variant boolean, ord int, url string, variant_id string"),
    "facet_pages": ("crawl_id long, source_id long, entry int, facet string, label string, flag string, "
                    "per_variant boolean, ord int, page int, fetched boolean, cards int"),
    "facet_gaps": ("crawl_id long, source_id long, facet string, label string, flag string, per_variant boolean, "
                   "ord int, reason string"),
    "product_observations": ("crawl_id long, source_id long, seq long, url string, name string, brand string, "
                             f"price double, list_price double, currency string, rank int, flags {FLAGS}, "
                             "image_url string, seen_at timestamp"),
    "weekly_summaries": "week date, text_fr string, model string, created_at timestamp",
}
# The declared unique keys; product_tags counts a NULL supplier code as a value.
UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "sources": ("url",),
    "documents": ("url",),
    "search_interest": ("code", "lang", "geo", "week"),
    "trend_snapshots": ("dimension", "code", "week"),
    "products": ("url",),
    "product_tags": ("product_id", "dimension", "code", "supplier_code"),
    "weekly_summaries": ("week",),
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table with its declared schema; only the columns a query touches are read."""
    return spark.read.schema(schema_of(table)).parquet(f"{root}/{table}")


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))
