"""Landing of sources, documents, sitemaps and archives."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.dates import instant, parse_iso
from shelfwave.functions.urls import title_from_url
from shelfwave.operators.joins import bounded, numbered, placed
from shelfwave.session import cut_lineage

MAX_TITLE = 500
# Elements of the public sitemap format.
URL_BLOCK = "(?s)<url>(.*?)</url>"
SITEMAP_LOC = r"(?s)<sitemap>\s*<loc>\s*([^<\s]+)\s*</loc>"


def unseen(batch: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    return batch.join(stored.select(key), key, "left_anti")


def new_documents(batch: DataFrame, documents: DataFrame, order: str = "seq") -> DataFrame:
    """Documents to add: one per URL, the first of the batch, unless already stored; titles cut to their column, status
    pending. Copies of one URL are reduced before the shuffle."""
    # the least place of each URL first: two numbers and a key are hashed, so texts are neither sorted nor moved for it
    first = batch.groupBy("url").agg(F.min(order).alias(order))
    rows = unseen(batch.join(first, ["url", order], "left_semi"), documents).dropDuplicates(["url"]).drop(order)
    return rows.withColumn("title", F.substring("title", 1, MAX_TITLE)).withColumn("status", F.lit("pending"))


def with_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The source table plus the wanted ones it lacks (by URL), the least row of each URL in column order. New ids follow the largest
    stored one in the order of URLs, so two URLs never share one; sources are configured sites, a few thousand rows at most."""
    rest = [c for c in wanted.columns if c != "url"]
    first = wanted.groupBy("url").agg(F.min(F.struct(*rest)).alias("s")).select("url", "s.*") if rest else wanted.distinct()
    fresh = numbered_urls(unseen(first, sources)).withColumn("active", F.lit(True))
    last = sources.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = fresh.withColumn("id", (last + F.col("n")).cast("long"))
    return sources.unionByName(fresh.select(*sources.columns))


def numbered_urls(rows: DataFrame, name: str = "n") -> DataFrame:
    """1-based number by URL order; the rows are new sources, a configured list."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy("url")))


def sync_listed_sources(sources: DataFrame, listed: DataFrame, kind: str = "press") -> DataFrame:
    """Sources of one kind follow a list: listed ones active, others inactive, history kept. `changed` marks the flips; other kinds
    are left alone."""
    urls = bounded(listed.select("url").distinct()).withColumn("listed", F.lit(True))
    rows = sources.join(urls, "url", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    active = F.when(F.col("kind") == kind, F.col("listed")).otherwise(F.col("active"))
    return rows.withColumn("changed", ~active.eqNullSafe(F.col("active"))).withColumn("active", active).drop("listed")


# --- sitemaps --------------------------------------------------------------------------------------

def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(source_id, pos, loc, lastmod) of sitemap texts (source_id, xml): one row per <url> block with a <loc>."""
    blocks = F.regexp_extract_all("xml", F.lit(URL_BLOCK), F.lit(1))
    rows = sitemaps.select("source_id", F.posexplode(blocks).alias("pos", "block"))
    tag = lambda name: F.regexp_extract("block", rf"<{name}>\s*([^<\s]+)\s*</{name}>", 1)
    return rows.where(tag("loc") != "").select(
        "source_id", F.col("pos").cast("long").alias("pos"), F.replace(tag("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), parse_iso(tag("lastmod")).alias("lastmod"))


def sitemap_texts(roots: DataFrame, landed: DataFrame) -> DataFrame:
    """(source_id, xml) of every landed text (loc, xml) that the roots (source_id, loc) lead to, through indexes of any depth; each once, whatever names
    it how often. Indexes that name each other do no harm, and what was never landed is left out.

    The links are read from the texts once. Then the frontier alone goes on: its children that were not seen before are the next one, until none are
    left; a round a level, each with names only and a checkpoint."""
    links = cut_lineage(landed.select(F.col("loc").alias("parent"), F.explode(F.regexp_extract_all("xml", F.lit(SITEMAP_LOC), F.lit(1))).alias("loc"))
                        .withColumn("loc", F.replace("loc", F.lit("&amp;"), F.lit("&"))).distinct())
    frontier = cut_lineage(roots.select("source_id", "loc").distinct())
    seen = frontier
    while not frontier.isEmpty():
        children = frontier.withColumnRenamed("loc", "parent").join(links, "parent").select("source_id", "loc").distinct()
        frontier = cut_lineage(children.join(seen, ["source_id", "loc"], "left_anti"), forget_size=True)
        seen = cut_lineage(seen.unionByName(frontier), forget_size=True)
    return seen.join(landed, "loc").select("source_id", "xml")


def included(url: Column, parts: Column) -> Column:
    """Any of the substrings occurs; an empty list lets everything pass."""
    return (F.size(F.coalesce(parts, F.array().cast("array<string>"))) == 0) | F.exists(parts, lambda p: url.contains(p))


def published_at(lastmod: Column, page_date: Column, page_first: bool) -> Column:
    """Publication time: the page's date first in the daily job, the sitemap's first in a backfill."""
    return F.coalesce(page_date, lastmod) if page_first else F.coalesce(lastmod, page_date)


def page_title(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), title_from_url(url))


def sitemap_candidates(entries: DataFrame, configs: DataFrame, stored: DataFrame) -> DataFrame:
    """The pages a source may check this run: changed since `since`, not stored, newest first; at most its `max_checked` where
    that is given, all where it is NULL. The cap is a top-k per source, so rows beyond it never leave their task. `configs`: (source_id, since, include, max_checked, max_new, kind of the
    run's other columns)."""
    rows = entries.join(bounded(configs), "source_id")
    rows = rows.where((F.col("lastmod") >= F.col("since")) & included(F.col("loc"), F.col("include")))
    rows = rows.join(stored.select(F.col("url").alias("loc")), "loc", "left_anti")
    w = Window.partitionBy("source_id").orderBy(F.desc("lastmod"), "pos")
    return rows.withColumn("checked", F.row_number().over(w)).where(F.col("max_checked").isNull() | (F.col("checked") <= F.col("max_checked")))


def sitemap_documents(candidates: DataFrame, pages: DataFrame, topic: str) -> DataFrame:
    """Candidates whose page was fetched, is recent by its own date and speaks about the topic, newest first; at most `max_new`
    per source where that is given, all where it is NULL. `pages`: (loc, page_date, title, text)."""
    rows = candidates.join(pages, "loc")
    rows = rows.withColumn("published_at", published_at(F.col("lastmod"), F.col("page_date"), True)).where(F.col("published_at") >= F.col("since"))
    title = page_title(F.col("title"), F.col("loc"))
    rows = rows.withColumn("title", title).where(F.concat_ws(" ", "title", "text").rlike(f"(?iU){topic}"))
    w = Window.partitionBy("source_id").orderBy("checked")
    return rows.withColumn("added", F.row_number().over(w)).where(F.col("max_new").isNull() | (F.col("added") <= F.col("max_new")))


def archive_items(items: DataFrame, since: datetime, stop_after: int | None = None) -> DataFrame:
    """Archive items that are recent or undated. Items dated old by the listing itself are skipped unseen; with `stop_after`, an
    ordered source ends once that many items in a row turn out old by their page. `items`: (source_id, pos, lastmod, page_date, ...),
    pos newest first.

    The run test needs no per-source window: each old item votes for itself and the following places, and a place with
    `stop_after` votes ends the source."""
    limit = instant(since)
    checked = items.where(F.col("lastmod").isNull() | (F.col("lastmod") >= limit))
    rows = checked.withColumn("published_at", published_at(F.col("lastmod"), F.col("page_date"), False))
    old = F.coalesce(F.col("published_at") < limit, F.lit(False))
    if stop_after is None:
        return rows.where(~old)
    rows = numbered(rows, ["source_id"], "pos").withColumn("old", old)
    votes = rows.where("old").select("source_id", F.explode(F.sequence(F.col("n"), F.col("n") + (stop_after - 1))).alias("place"))
    stops = (votes.groupBy("source_id", "place").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") == stop_after)
             .groupBy("source_id").agg(F.min("place").alias("stop")))
    kept = rows.join(stops, "source_id", "left").where(~F.col("old") & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    return kept.drop("n", "old", "stop")


# --- search interest -------------------------------------------------------------------------------

INTEREST_KEY = ["code", "lang", "geo", "week"]


def upserted_interest(stored: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Stored rows with the batch's values over them: an existing key keeps its id and takes value and keyword. A key repeated in the batch takes
    its last row by `order`; each group of columns comes from one row, whatever the partitions."""
    columns = ["id", "dimension", *INTEREST_KEY, "keyword", "value", "is_demo"]
    at = F.col(order) if order else F.struct("value", "keyword", "id")  # without a stated order the greatest row comes last
    rows = stored.select(*columns, F.lit(0).alias("turn"), F.lit(None).cast(batch.select(at.alias("at")).schema["at"].dataType).alias("at")).unionByName(
        batch.select(*columns, F.lit(1).alias("turn"), at.alias("at")))
    rank = F.struct("turn", "at")
    first, last = F.min_by(F.struct("id", "dimension", "is_demo"), rank), F.max_by(F.struct("keyword", "value"), rank)
    return rows.groupBy(*INTEREST_KEY).agg(first.alias("f"), last.alias("l")).select("f.*", "l.*", *INTEREST_KEY).select(*columns)


# --- demo rows and keys ----------------------------------------------------------------------------

def without_demo(documents: DataFrame, mentions: DataFrame, interest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without demo rows; mentions of demo documents go with them. Snapshots are to be recomputed."""
    demo = documents.where("is_demo").select(F.col("id").alias("document_id"))
    return documents.where(~F.col("is_demo")), mentions.join(demo, "document_id", "left_anti"), interest.where(~F.col("is_demo"))


def duplicate_keys(table: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once; NULLs are equal here. Must be empty before a table is published. Most keys occur once, so nothing is
    counted before they are placed, and a task holds the keys of its share of the input."""
    return placed(table.select(*key), *key).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
