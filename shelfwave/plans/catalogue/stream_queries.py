"""Streaming jobs run to the end of the given tables (availableNow) and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwave.functions.dates import monday
from shelfwave.operators.joins import estimated_bytes
from shelfwave.operators.series import KEY
from shelfwave.plans.catalogue.history_queries import REPLAYED, replay_sql
from shelfwave.plans.catalogue import trend_queries as _trends  # noqa: F401  registers what sql_of names
from shelfwave.plans.catalogue.shared import WEEKS, kinds
from shelfwave.plans.registry import query, sql_of
from shelfwave.session import shared_folder
from shelfwave.sources import samples as S
from shelfwave.streaming import jobs as J


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


FILE_BYTES = 32 << 20


def stream_of(spark: SparkSession, rows: DataFrame, folder: str, table: DataFrame, batches: int = 3, at_once: bool = False) -> DataFrame:
    """The rows as a stream of `batches` micro-batches (one, if `at_once`), landed in the shared folder. A batch has as many files as its share of
    `table`, the stored table the rows come from, fills by size, so no task holds more when there is more input."""
    files = max(1, -(-estimated_bytes(table) // (batches * FILE_BYTES)))
    rows.repartition(batches * files).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", batches * files if at_once else files).parquet(folder)


def event_mentions(rows: DataFrame) -> DataFrame:
    stance = F.when(F.col("value") > 40, "rising").when(F.col("value") < 10, "declining").otherwise("neutral")
    return rows.select(F.col("event_type").alias("dimension"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(8))).alias("code"), stance.alias("stance"),
                       F.when(F.pmod("user_id", F.lit(2)) == 0, "store").otherwise("social").alias("kind"), F.to_date("ts").alias("occurred_on"))


EVENTS = """e AS (SELECT event_type AS dimension, 'u' || (user_id % 8) AS code, CASE WHEN value > 40 THEN 'rising' WHEN value < 10 THEN 'declining' ELSE 'neutral' END AS stance,
  CASE WHEN user_id % 2 = 0 THEN 15 ELSE 6 END AS w, CAST(date_trunc('week', ts) AS DATE) AS wk FROM events)"""


@query("streamed_weekly_counts", f"""
WITH {EVENTS} SELECT dimension, code, CAST(wk AS VARCHAR) AS week, CAST(sum(CASE WHEN stance = 'rising' THEN w ELSE 0 END) AS BIGINT) AS rising,
  CAST(sum(CASE WHEN stance = 'declining' THEN w ELSE 0 END) AS BIGINT) AS declining, CAST(sum(w) AS BIGINT) AS volume FROM e GROUP BY 1, 2, 3""")
def streamed_weekly_counts(spark, sf):
    folder = work_folder(spark)
    stream = stream_of(spark, event_mentions(S.load(spark, sf, "events")), f"{folder}/in", S.load(spark, sf, "events"))  # weeks come in any order: most rows are late
    J.maintain_weekly_counts(stream, f"{folder}/mentions", f"{folder}/weekly", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/weekly").select(*KEY, F.col("week").cast("string").alias("week"), "rising", "declining", "volume")


@query("streamed_snapshots", f"""
WITH {EVENTS}, last AS (SELECT max(wk) AS w FROM e) SELECT dimension, code, CAST(wk AS VARCHAR) AS week, sum(w) / 10.0 AS mentions FROM e GROUP BY 1, 2, 3""")
def streamed_snapshots(spark, sf):
    folder, events = work_folder(spark), event_mentions(S.load(spark, sf, "events"))
    span = events.agg(F.min("occurred_on").alias("first"), F.max("occurred_on").alias("last")).first()
    weeks = (monday(span["last"]) - monday(span["first"])).days // 7 + 1
    J.maintain_snapshots(stream_of(spark, events, f"{folder}/in", S.load(spark, sf, "events")), f"{folder}/mentions", f"{folder}/snapshots", f"{folder}/state", lambda: span["last"], weeks).awaitTermination()
    return spark.read.parquet(f"{folder}/snapshots").where("mentions > 0").select(*KEY, F.col("week").cast("string").alias("week"), "mentions")


@query("streamed_scores", sql_of("trend_snapshots"))
def streamed_scores(spark, sf):
    """The sample's mentions as a stream, scored with the search interest after each batch: the same rows as scoring the whole table at once."""
    folder = work_folder(spark)
    stream = stream_of(spark, kinds(spark, sf), f"{folder}/in", S.load(spark, sf, "lineitem"))
    J.maintain_snapshots(stream, f"{folder}/mentions", f"{folder}/snapshots", f"{folder}/state", S.TODAY, WEEKS, lambda session: S.search_interest(session, sf)).awaitTermination()
    return spark.read.parquet(f"{folder}/snapshots").select(*KEY, F.col("week").cast("string").alias("week"), "mentions", F.round("search", 6).alias("search"), "momentum",
                                                            "status", "tone", "decline_share")


@query("streamed_documents", r"""
SELECT url, md5(text) AS text FROM (SELECT lang || md5(text) AS url, text FROM documents WHERE regexp_matches(chr(10) || text, '(^|[^\w\x{C0}-\x{24F}])(nicht|pour|with)($|[^\w\x{C0}-\x{24F}])', 'i'))
GROUP BY url, text""")
def streamed_documents(spark, sf):
    folder = work_folder(spark)
    rows = S.load(spark, sf, "documents").select(F.concat("lang", F.md5(F.col("text").cast("binary"))).alias("url"), F.lit("").alias("title"), "text",
                                                 F.lit("2024-01-01").cast("timestamp").alias("collected_at"))
    J.ingest_documents(stream_of(spark, rows.unionByName(rows), f"{folder}/in", rows), f"{folder}/documents", f"{folder}/state", r"\b(nicht|pour|with)\b").awaitTermination()
    return spark.read.parquet(f"{folder}/documents").select("url", F.md5(F.col("text").cast("binary")).alias("text"))


@query("streamed_catalog", replay_sql())
def streamed_catalog(spark, sf):
    """The crawls after the cut as one stream over the stored catalog: the same rows as replaying them step by step."""
    folder = work_folder(spark)
    crawls = [S.product_observations(spark, sf, a, b).withColumn("crawl_id", F.col("source_id") * 10 + k) for k, (a, b) in enumerate(zip(REPLAYED, [*REPLAYED[1:], None], strict=True))]
    rows = reduce(DataFrame.unionByName, crawls).join(S.crawl_reports(spark, sf)[1], "source_id").withColumns({"listed_only": F.lit(False)})
    stream = stream_of(spark, rows, f"{folder}/in", S.load(spark, sf, "lineitem"), at_once=True)
    J.maintain_catalog(stream, f"{folder}/catalog", f"{folder}/state", S.STATUS_NOW, initial=S.stored_catalog(spark, sf)).awaitTermination()
    return J.latest_catalog(spark, f"{folder}/catalog").select("url", "source_id", "is_active")
