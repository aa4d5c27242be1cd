"""Catalog history, read side: baselines, new and retired products, store status, what is due."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.dates import age_text, instant, micros
from shelfwave.functions.numbers import ratio, rounded
from shelfwave.operators.joins import bounded
from shelfwave.operators.shelf import distinct_attributes, is_creator
from shelfwave.rules import DEFAULT_RULES, STORE_STATUS_FR, Rules


def baselines(crawls: DataFrame) -> DataFrame:
    """(source_id, start): end of each store's first complete crawl."""
    return (crawls.where((F.col("status") == "ok") & F.col("finished_at").isNotNull())
            .groupBy("source_id").agg(F.min("finished_at").alias("start")))


def is_new(now: datetime, rules: Rules = DEFAULT_RULES) -> Column:
    """First seen after the store's baseline and within the last days; false without a baseline."""
    since = now - timedelta(days=rules.new_days)
    return F.coalesce((F.col("first_seen_at") > F.col("start")) & (F.col("first_seen_at") >= instant(since)), F.lit(False))


def retired_products(products: DataFrame, starts: DataFrame, now: datetime, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Products dropped within the last days by stores that have a baseline; the date bound reaches the scan."""
    since = now - timedelta(days=rules.new_days)
    gone = products.where(~F.col("is_active") & (F.col("dropped_at") >= instant(since)))
    return gone.join(bounded(starts.select("source_id")), "source_id", "left_semi")


def new_products(products: DataFrame, starts: DataFrame, now: datetime, rules: Rules = DEFAULT_RULES) -> DataFrame:
    since = now - timedelta(days=rules.new_days)
    fresh = products.where(F.col("is_active") & (F.col("first_seen_at") >= instant(since)))
    return fresh.join(bounded(starts), "source_id").where(is_new(now, rules)).drop("start")


def creator_scope(sources: DataFrame, starts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(source_id, store, start) of creator-brand stores that have a baseline."""
    own = sources.where((F.col("kind") == "store") & is_creator(F.col("country"), rules))
    return own.select(F.col("id").alias("source_id"), F.col("name").alias("store")).join(starts, "source_id")


def new_by_store(products: DataFrame, scope: DataFrame, now: datetime, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(store, new, retired, catalog): stores with active products or with products retired lately."""
    since = now - timedelta(days=rules.new_days)
    gone = ~F.col("is_active") & (F.col("dropped_at") >= instant(since))
    rows = products.where(F.col("is_active") | gone).join(bounded(scope), "source_id")
    return rows.groupBy("store").agg(
        F.count_if(F.col("is_active") & is_new(now, rules)).alias("new"), F.count_if(~F.col("is_active")).alias("retired"),
        F.count_if("is_active").alias("catalog")).orderBy("store")


def new_by_attribute(products: DataFrame, tags: DataFrame, scope: DataFrame, now: datetime, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Attributes of the new products against the whole catalog, most new first. Shares only above the minimum of new
    products. A product counts once per attribute, whatever its supplier codes."""
    active = products.where("is_active").join(bounded(scope.select("source_id", "start")), "source_id").select(
        "id", is_new(now, rules).alias("fresh"))
    totals = active.agg(F.count_if("fresh").alias("n_new"), F.count(F.lit(1)).alias("n_all"))
    rows = (active.join(distinct_attributes(tags, *rules.new_dimensions), "id")
            .groupBy("dimension", "code").agg(F.count_if("fresh").alias("new"), F.count(F.lit(1)).alias("catalog"))
            .where(F.col("new") > 0))
    n_new, n_all = totals.select("n_new").scalar(), totals.select("n_all").scalar()
    share = lambda part, whole: F.when(n_new >= rules.min_new_for_shares, rounded(ratio(part, whole), 4))
    order = F.array_position(F.array(*[F.lit(d) for d in rules.new_dimensions]), F.col("dimension"))
    return (rows.select("dimension", "code", "new", "catalog", share(F.col("new"), n_new).alias("share_new"),
                        share(F.col("catalog"), n_all).alias("share_catalog"))
            .orderBy(F.desc("new"), order, "code"))


# --- the crawl log ---------------------------------------------------------------------------------

def crawl_heads(crawls: DataFrame) -> DataFrame:
    """Per store: its newest complete crawl, its newest attempt that was not interrupted, its first complete crawl. One
    aggregate with partial maxima, so a store with a long log is not one task's work."""
    done = crawls.where(F.col("finished_at").isNotNull())
    ok = F.col("status") == "ok"
    tried = ~F.coalesce(F.col("error").startswith("interrupted"), F.lit(False))
    when = lambda keep: F.when(keep, F.struct("finished_at", "id"))
    problem = F.get(F.col("problems"), F.lit(0))
    return done.groupBy("source_id").agg(
        F.max(F.when(ok, F.col("finished_at"))).alias("ok_at"), F.min(F.when(ok, F.col("finished_at"))).alias("start"),
        F.max_by(F.when(ok, F.col("drop_skipped")), when(ok)).alias("note"),
        F.max_by(F.when(tried, F.struct("status", "finished_at", "error", problem.alias("problem"))), when(tried)).alias("tried"))


def _configured(stores: DataFrame, sources: DataFrame) -> DataFrame:
    return stores.join(sources.select(F.col("id").alias("source_id"), F.col("url").alias("base_url")), "base_url", "left")


def store_status(stores: DataFrame, sources: DataFrame, crawls: DataFrame, products: DataFrame, now: datetime,
                 rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per configured store: counts, freshness and a status: a newer incomplete or failed attempt, manual (products but
    no crawl), never, late (older than two cadences) or ok."""
    since = now - timedelta(days=rules.new_days)
    heads = crawl_heads(crawls)
    gone = ~F.col("is_active") & (F.col("dropped_at") >= instant(since))
    counted = (products.where(F.col("is_active") | gone).groupBy("source_id", "first_seen_at").agg(
        F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("gone"))
        .join(heads.select("source_id", "start"), "source_id", "left")
        .groupBy("source_id").agg(F.sum("active").alias("products"), F.sum(F.when(is_new(now, rules), F.col("active")).otherwise(0)).alias("new"),
                                  F.sum(F.when(F.col("start").isNotNull(), F.col("gone")).otherwise(0)).alias("retired")))
    rows = _configured(stores, sources).join(heads, "source_id", "left").join(counted, "source_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    newer = (F.col("tried.status") != "ok") & (F.col("ok_at").isNull() | (F.col("tried.finished_at") > F.col("ok_at")))
    late = micros(instant(now)) - micros(F.col("ok_at")) > F.col("crawl_every_days").cast("long") * F.lit(rules.late_factor * 86400 * 10 ** 6)
    status = (F.when(newer, F.col("tried.status"))
              .when(F.col("ok_at").isNull(), F.when(F.coalesce("products", F.lit(0)) > 0, "manual").otherwise("never"))
              .when(late, "late").otherwise("ok"))
    detail = F.when(newer, F.when(F.col("tried.status") == "incomplete", F.col("tried.problem"))
                    .otherwise(F.substring(F.coalesce("tried.error", F.lit("")), 1, 200)))
    label = F.create_map(*[F.lit(x) for pair in STORE_STATUS_FR.items() for x in pair])
    return rows.select("name", "domain", "country", zero("products"), zero("new"), zero("retired"),
                       is_creator(F.col("country"), rules).alias("creator"), status.alias("status"), label[status].alias("status_label"),
                       detail.alias("detail"), "note", F.col("crawl_every_days").alias("cadence_days"), F.col("ok_at").alias("last_ok_at"),
                       F.col("start").isNotNull().alias("has_history"))


def needing_attention(status: DataFrame) -> DataFrame:
    return status.where(F.col("status").isin("late", "incomplete", "failed") | (F.coalesce("note", F.lit("")) != ""))


def due_stores(stores: DataFrame, sources: DataFrame, crawls: DataFrame, now: datetime, force: bool = False,
               rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(name, domain, due, reason): which stores to observe again. Interrupted attempts say nothing about a store."""
    rows = _configured(stores, sources).join(crawl_heads(crawls), "source_id", "left")
    clock = instant(now)
    age = lambda then: micros(clock) - micros(then)
    hour = 3600 * 10 ** 6
    fresh = age(F.col("ok_at")) < F.col("crawl_every_days").cast("long") * F.lit(24 * hour) - F.lit(rules.cadence_slack_hours * hour)
    tried_at, tried = F.col("tried.finished_at"), F.col("tried.status")
    failed = F.coalesce(tried != "ok", F.lit(False))
    backing_off = failed & (age(tried_at) < F.lit(rules.retry_after_hours * hour))
    retry = F.when(failed, F.concat(F.lit(" (retrying a "), tried, F.lit(" crawl)"))).otherwise(F.lit(""))
    case = (F.when(F.lit(force), F.struct(F.lit(True).alias("due"), F.lit("forced").alias("reason")))
            .when(F.col("source_id").isNull(), F.struct(F.lit(True).alias("due"), F.lit("never crawled").alias("reason")))
            .when(fresh, F.struct(F.lit(False).alias("due"), F.concat(
                F.lit("complete crawl "), age_text(F.col("ok_at"), clock), F.lit(", every "), F.col("crawl_every_days").cast("string"), F.lit(" d")).alias("reason")))
            .when(backing_off, F.struct(F.lit(False).alias("due"), F.concat(
                tried, F.lit(" crawl "), age_text(tried_at, clock), F.lit(f", retry after {rules.retry_after_hours} h")).alias("reason")))
            .when(F.col("ok_at").isNull(), F.struct(F.lit(True).alias("due"), F.when(F.col("tried").isNotNull(), "no complete crawl yet")
                                                    .otherwise("never crawled").alias("reason")))
            .otherwise(F.struct(F.lit(True).alias("due"), F.concat(
                F.lit("last complete crawl "), age_text(F.col("ok_at"), clock), retry).alias("reason"))))
    return rows.select("name", "domain", case.alias("d")).select("name", "domain", "d.due", "d.reason")


def crawl_needs_attention() -> Column:
    """Nothing broke, but the crawl could not be trusted to drop products."""
    return (F.col("status") == "incomplete") | ((F.col("status") != "failed") & (F.coalesce("drop_skipped", F.lit("")) != ""))


def outcome_summary(crawls: DataFrame) -> DataFrame:
    """(ok, attention, failed, code) of a set of crawls; code is 1 when any failed, else 2 when any needs attention, else 0."""
    rows = crawls.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(crawl_needs_attention()).alias("attention"),
                      F.count(F.lit(1)).alias("n"))
    return rows.select((F.col("n") - F.col("failed") - F.col("attention")).alias("ok"), "attention", "failed",
                       F.when(F.col("failed") > 0, 1).when(F.col("attention") > 0, 2).otherwise(0).alias("code"))
