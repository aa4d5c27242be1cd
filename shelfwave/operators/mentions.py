"""Mentions with their documents and sources: joins, filters, pages, counts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.numbers import ratio
from shelfwave.operators.joins import bounded

STANCES = ("rising", "neutral", "declining")


def enrich(mentions: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """mention x document x source, inner. Documents meet their sources first, by broadcast when the source count allows it: one
    source may hold a large part of all documents."""
    doc = documents.select(
        F.col("id").alias("document_id"), "source_id", F.col("title"), F.col("url"), F.col("summary_fr").alias("summary"),
        F.col("lang"), "is_demo")
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "kind")
    return mentions.join(doc.join(bounded(src), "source_id"), "document_id")


def mention_kinds(mentions: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The narrow form scoring needs: dimension, code, stance, day and the source's kind."""
    doc = documents.select(F.col("id").alias("document_id"), "source_id")
    src = sources.select(F.col("id").alias("source_id"), "kind")
    rows = mentions.select("document_id", "dimension", "code", "stance", "occurred_on")
    return rows.join(doc.join(bounded(src), "source_id"), "document_id").select("dimension", "code", "stance", "occurred_on", "kind")


def filter_mentions(rows: DataFrame, dimension: str | None = None, code: str | None = None, lang: str | None = None,
                    kind: str | None = None, since: date | None = None, until: date | None = None) -> DataFrame:
    """Optional filters, all of which must hold; both dates are inclusive."""
    for column, value in (("dimension", dimension), ("code", code), ("lang", lang), ("kind", kind)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("occurred_on") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("occurred_on") <= F.lit(until))
    return rows


def mention_rows(rows: DataFrame) -> DataFrame:
    """What a reader sees of a mention."""
    return rows.select("id", "dimension", "code", "stance", "evidence", F.col("occurred_on").alias("date"), "title", "url",
                       "summary", "lang", "source", "kind", "is_demo")


def mentions_page(enriched: DataFrame, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """One page, newest first then highest id; a top-k, so no full sort."""
    rows = filter_mentions(enriched, **filters)
    return mention_rows(rows.orderBy(F.desc("occurred_on"), F.desc("id")).offset(offset).limit(limit))


def mentions_after(enriched: DataFrame, after: tuple[date, int] | None, limit: int = 20, **filters) -> DataFrame:
    """The page after the row (date, id), or the first one: a top-k over what is below that key, however far down it is."""
    rows = filter_mentions(enriched, **filters)
    if after is not None:
        day, key = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col("occurred_on") < day) | ((F.col("occurred_on") == day) & (F.col("id") < key)))
    return mention_rows(rows.orderBy(F.desc("occurred_on"), F.desc("id")).limit(limit))


def deep_page(enriched: DataFrame, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """mentions_page for page numbers far down. The rows of each day are counted first (a calendar-sized result); the page begins within a day that the
    counts name, so no task ranks more rows than a day has, and earlier days are not read again where the table is kept by day."""
    rows, before, start = filter_mentions(enriched, **filters), 0, None
    for day in rows.groupBy("occurred_on").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("occurred_on")).collect():
        start = day["occurred_on"]
        if before + day["n"] > offset:
            break
        before += day["n"]
    if start is not None:
        rows = rows.where(F.col("occurred_on") <= F.lit(start)) if before <= offset else rows
    return mention_rows(rows.orderBy(F.desc("occurred_on"), F.desc("id")).offset(offset - before).limit(limit))


def mentions_total(enriched: DataFrame, **filters) -> DataFrame:
    return filter_mentions(enriched, **filters).agg(F.count(F.lit(1)).alias("total"))


def last_four_weeks(rows: DataFrame, week: date) -> DataFrame:
    """Mentions from the Monday three weeks before `week` to the Sunday that ends it."""
    return filter_mentions(rows, since=week - timedelta(weeks=3), until=week + timedelta(days=6))


def stance_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mentions per stance and the share of each; all stances present, 0 when absent."""
    counted = rows.groupBy(*by).agg(*[F.count_if(F.col("stance") == s).alias(s) for s in STANCES])
    total = F.col("rising") + F.col("neutral") + F.col("declining")
    return counted.select(*by, *STANCES, *[ratio(F.col(s), total).alias(f"{s}_share") for s in STANCES])


def documents_with(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents with at least one of the mentions, each once."""
    return documents.join(mentions.select(F.col("document_id").alias("id")), "id", "left_semi")


def co_mentioned_brands(documents: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    """Brands of the matching documents, one vote per listing in a document; ties by name."""
    return (documents_with(documents, mentions).select(F.explode("brands").alias("name"))
            .groupBy("name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "name").limit(limit))


def brands_by_attribute(documents: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    """The same for every attribute at once: (dimension, code, name, count, rn), the first `limit` of each."""
    from pyspark.sql import Window
    pairs = mentions.select("document_id", "dimension", "code").distinct()
    votes = (pairs.join(documents.select(F.col("id").alias("document_id"), "brands"), "document_id")
             .select("dimension", "code", F.explode("brands").alias("name"))
             .groupBy("dimension", "code", "name").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy("dimension", "code").orderBy(F.desc("count"), "name")
    return votes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def latest_evidence(enriched: DataFrame, until: date, limit: int = 10, **filters) -> DataFrame:
    return mentions_page(enriched, limit=limit, until=until, **filters)


def document_page(documents: DataFrame, sources: DataFrame, mentions: DataFrame, dimension: str | None = None,
                  code: str | None = None, lang: str | None = None, kind: str | None = None, since: date | None = None,
                  limit: int = 6, offset: int = 0) -> DataFrame:
    """Extracted documents with a matching mention, newest first; each with its distinct attributes in (dimension, code)
    order and the evidence of the first matching one. The page is cut before the mentions are joined back."""
    matching = filter_mentions(mentions, dimension, code, since=since)
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "kind")
    when = F.coalesce("published_at", "collected_at")
    rows = documents_with(documents.where(F.col("status") == "extracted"), matching).join(bounded(src), "source_id")
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    page = (rows.select("id", "url", "title", "source", "kind", "lang", when.alias("at"),
                        F.col("summary_fr").alias("summary"), "is_demo")
            .orderBy(F.desc("at"), F.desc("id")).offset(offset).limit(limit))
    wanted = F.lit(True)
    if dimension is not None:
        wanted = wanted & (F.col("dimension") == dimension)
    if code is not None:
        wanted = wanted & (F.col("code") == code)
    first = (mentions.join(page.select(F.col("id").alias("document_id")), "document_id", "left_semi")
             .groupBy("document_id", "dimension", "code")
             .agg(F.min_by(F.struct("stance", "evidence"), "id").alias("m")))
    attributes = first.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("dimension", "code", F.col("m.stance").alias("stance")))).alias("attributes"),
        F.min_by(F.col("m.evidence"), F.when(wanted, F.struct("dimension", "code"))).alias("quote"))
    return page.join(attributes, page["id"] == attributes["document_id"], "left").select(
        "id", "url", "title", "source", "kind", "lang", F.to_date("at").alias("date"), "quote", "summary", "attributes", "is_demo")


def document_total(documents: DataFrame, mentions: DataFrame, **filters) -> DataFrame:
    return documents_with(documents.where(F.col("status") == "extracted"), filter_mentions(mentions, **filters)).agg(
        F.count(F.lit(1)).alias("total"))


def counters(documents: DataFrame, mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Header counts as (metric, value) rows: extracted documents, mentions, active sources, pending documents, demo."""
    def melted(df: DataFrame, named: dict[str, Column]) -> DataFrame:
        agg = df.agg(*[c.cast("long").alias(n) for n, c in named.items()])
        return agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in named])).alias("m")).select("m.*")

    docs = melted(documents, {"documents": F.count_if(F.col("status") == "extracted"),
                              "pending": F.count_if(F.col("status") == "pending"), "demo": F.count_if("is_demo")})
    return (docs.unionByName(melted(mentions, {"mentions": F.count(F.lit(1))}))
            .unionByName(melted(sources, {"sources": F.count_if("active")})))
