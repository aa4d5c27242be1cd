"""Catalog history, write side: upsert by URL, guarded drops, carried-over values, tag differences."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.dates import instant
from shelfwave.functions.text import let
from shelfwave.operators.joins import PLACED_BYTES, bounded, placed, scanned_bytes
from shelfwave.rules import DEFAULT_RULES, Rules
from shelfwave.session import cut_lineage, shared_folder
from shelfwave.sources.tables import FLAGS

VALUES = ["name", "brand", "price", "list_price", "currency", "rank", "flags", "image_url", "seen_at"]
FLAG_FIELDS = ("is_bestseller", "out_of_stock", "is_new", "is_limited")
GAPS = "array<struct<facet:string,label:string,flag:string,per_variant:boolean>>"


def _labels(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.split(text, ", ")).otherwise(F.array().cast("array<string>"))


def carried_specs(old: Column, new: Column, gaps: Column) -> Column:
    """raw_specs with each failed facet label put back where the old value had it and the new one lacks it."""
    def put(specs: Column, gap: Column) -> Column:
        have = _labels(specs[gap["facet"]])
        lost = gap["flag"].isNull() & F.array_contains(_labels(old[gap["facet"]]), gap["label"]) & ~F.array_contains(have, gap["label"])
        label = F.array_join(F.concat(have, F.array(gap["label"])), ", ")
        return F.when(F.coalesce(lost, F.lit(False)), F.map_concat(F.map_filter(specs, lambda k, v: k != gap["facet"]), F.create_map(gap["facet"], label))).otherwise(specs)

    start = F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.aggregate(gaps, start, put)


def carried_variants(old: Column, new: Column, gaps: Column) -> Column:
    """Variant colours put back: a variant without a colour takes its old one when that is exactly a failed per-variant label."""
    def fill(v: Column) -> Column:
        before = F.filter(old, lambda o: o["code"].eqNullSafe(v["code"]))
        color = F.get(before, F.size(before) - 1)["color"]
        lost = (F.coalesce(v["color"], F.lit("")) == "") & F.exists(gaps, lambda g: g["per_variant"] & g["flag"].isNull() & (g["label"] == color))
        return F.when(F.coalesce(lost, F.lit(False)), v.withField("color", color)).otherwise(v)

    return F.transform(new, fill)


def carry_over(old: Column, new: Column, gaps: Column) -> Column:
    """The flags to store: `new` plus what failed facet pages kept from being read again; `new` itself when nothing was lost."""
    names = [f.name for f in _flag_type().fields]
    changed_specs = carried_specs(old["raw_specs"], new["raw_specs"], gaps)
    variants = carried_variants(old["variants"], new["variants"], gaps)
    flag = lambda f: F.coalesce(new[f], F.when(F.exists(gaps, lambda g: g["flag"] == f), old[f]))
    specs = let(changed_specs, lambda m: F.when((F.size(m) > 0) | new["raw_specs"].isNotNull(), m))
    made = {"raw_specs": specs, "variants": variants, **{f: flag(f) for f in FLAG_FIELDS}}
    out = F.struct(*[made.get(n, new[n]).alias(n) for n in names])
    worth = F.coalesce(F.size(gaps) > 0, F.lit(False)) & old.isNotNull()
    return F.when(worth, let(out, lambda o: F.when(flags_differ(o, new), o).otherwise(new))).otherwise(new)


def _flag_type():
    from pyspark.sql import types as T
    return T.StructType.fromDDL(f"flags {FLAGS}").fields[0].dataType


def flags_differ(a: Column, b: Column) -> Column:
    """Whether two flag structs hold different values; a NULL struct and one without values are the same."""
    def flat(x: Column) -> Column:
        specs = F.coalesce(F.array_sort(F.map_entries(x["raw_specs"])), F.array().cast("array<struct<key:string,value:string>>"))
        return F.struct(specs.alias("raw_specs"), *[x[n].alias(n) for n in (f.name for f in _flag_type().fields) if n != "raw_specs"])
    return ~flat(a).eqNullSafe(flat(b))


def latest_observations(observations: DataFrame) -> DataFrame:
    """One row per store and URL, the last of the batch winning; partial maxima, so copies of one URL never pile up."""
    keep = [c for c in observations.columns if c not in ("source_id", "url")]
    return (observations.groupBy("source_id", "url").agg(F.max_by(F.struct(*keep), "seq").alias("o"))
            .select("source_id", "url", "o.*"))


def claims(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """The batch with its fate: `accepted` when the URL is new or already this store's. A URL claimed by several stores in one
    step belongs to the lowest crawl."""
    first = latest.groupBy("url").agg(F.min_by("source_id", F.struct("crawl_id", "source_id")).alias("first_source"))
    held = catalog.select("url", F.col("source_id").alias("held_by"))
    rows = latest.join(first, "url").join(held, "url", "left")
    owner = F.coalesce("held_by", "first_source")
    return rows.withColumn("accepted", F.col("source_id") == owner).drop("held_by", "first_source")


def drop_decisions(catalog: DataFrame, observations: DataFrame, listed: DataFrame, reports: DataFrame, default_when: datetime,
                   accept_drops: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(source_id, may_drop, drop_skipped, dropped_when) per store with a report. An incomplete crawl drops nothing, nor one that
    lists under the minimum share of the active products (integers cross-multiplied: exactly the minimum passes)."""
    present = observations.select("source_id", "url").unionByName(listed.select("source_id", "url")).distinct()
    counts = (present.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_present"))
              .join(catalog.where("is_active").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_active")), "source_id", "full_outer")
              .join(observations.groupBy("source_id").agg(F.max("seen_at").alias("seen")), "source_id", "left"))
    return _decisions(reports.select("source_id", "problems").join(counts, "source_id", "left"), default_when, observations.schema["seen_at"].dataType, accept_drops, rules)


def _decisions(rows: DataFrame, default_when: datetime, when_type, accept_drops: bool, rules: Rules) -> DataFrame:
    n_problems = F.coalesce(F.size("problems"), F.lit(0))
    n_problems = F.greatest(n_problems, F.lit(0))
    n_active, n_present = F.coalesce("n_active", F.lit(0)), F.coalesce("n_present", F.lit(0))
    low, high = rules.min_listed_share
    shrunk = (n_active > 0) & (n_present * high < n_active * low)
    more = F.when(n_problems > 1, F.concat(F.lit(" (+"), (n_problems - 1).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    skipped = F.when(n_problems > 0, F.concat(F.lit("incomplete crawl: "), F.get("problems", F.lit(0)), more))
    if not accept_drops:
        skipped = F.coalesce(skipped, F.when(shrunk, F.concat(F.lit("listing shrank "), n_active.cast("string"), F.lit(" -> "), n_present.cast("string"))))
    return rows.select("source_id", skipped.isNull().alias("may_drop"), skipped.alias("drop_skipped"),
                       F.coalesce("seen", instant(default_when).cast(when_type)).alias("dropped_when"))


def sync(catalog: DataFrame, observations: DataFrame, listed: DataFrame, reports: DataFrame, gaps: DataFrame | None,
         now: datetime, accept_drops: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The next catalog version, one crawl per store at a time, every row with its `action`: inserted, updated, reactivated,
    dropped or kept, and `carried` when a failed facet kept old values. Everything is keyed by URL; per-store decisions
    and gaps are small and joined by checked broadcast."""
    latest = latest_observations(observations)
    accepted = claims(catalog, latest).where("accepted")
    fresh = accepted.select("url", F.col("source_id").alias("n_source_id"), *[F.col(c).alias(f"n_{c}") for c in VALUES])
    present = (observations.select("source_id", "url").unionByName(listed.select("source_id", "url")).distinct()
               .withColumn("present", F.lit(True)))
    decisions = bounded(drop_decisions(catalog, observations, listed, reports, now, accept_drops, rules), measured=reports)
    rows = (catalog.join(present, ["source_id", "url"], "left").join(fresh, "url", "full_outer")
            .join(decisions.select("source_id", "may_drop", "dropped_when"), "source_id", "left"))
    if gaps is None:
        rows = rows.withColumn("gaps", F.array().cast(GAPS))
    else:
        per_store = gaps.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ord", "facet", "label", "flag", "per_variant"))).alias("g"))
        per_store = per_store.select(F.col("source_id").alias("n_source_id"), F.transform("g", lambda g: F.struct(
            g["facet"].alias("facet"), g["label"].alias("label"), g["flag"].alias("flag"), g["per_variant"].alias("per_variant"))).alias("gaps"))
        rows = rows.join(bounded(per_store), "n_source_id", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast(GAPS)))
    new, old = F.col("n_source_id").isNotNull(), F.col("id").isNotNull()
    lost = old & ~new & F.col("is_active") & F.coalesce("may_drop", F.lit(False)) & F.col("present").isNull()
    action = (F.when(new & ~old, "inserted").when(new & ~F.col("is_active"), "reactivated").when(new, "updated").when(lost, "dropped").otherwise("kept"))
    flags = F.when(new & old, carry_over(F.col("flags"), F.col("n_flags"), F.col("gaps"))).otherwise(F.col("n_flags"))
    rows = rows.withColumn("action", action).withColumn("kept_flags", flags)
    is_new, gone = F.col("n_source_id").isNotNull(), F.col("action") == "dropped"
    value = lambda c: F.when(is_new, F.col("kept_flags") if c == "flags" else F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        F.coalesce("id", F.xxhash64("url")).alias("id"), F.coalesce("source_id", "n_source_id").alias("source_id"), "url",
        *[value(c) for c in VALUES], F.coalesce("first_seen_at", "n_seen_at").alias("first_seen_at"),
        F.when(is_new, F.lit(True)).when(gone, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(is_new, F.lit(None)).when(gone, F.col("dropped_when")).otherwise(F.col("dropped_at")).alias("dropped_at"), "action",
        F.when(is_new & F.col("id").isNotNull(), flags_differ(F.col("kept_flags"), F.col("n_flags"))).otherwise(F.lit(False)).alias("carried"))


def sync_summary(changes: DataFrame, batch_claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per store of the batch: inserted, updated (reactivated included), reactivated, dropped, carried, conflicts, drop_skipped."""
    done = changes.where(F.col("action") != "kept").groupBy("source_id").agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action").isin("updated", "reactivated")).alias("updated"),
        F.count_if(F.col("action") == "reactivated").alias("reactivated"), F.count_if(F.col("action") == "dropped").alias("dropped"),
        F.count_if("carried").alias("carried"))
    clashes = batch_claims.groupBy("source_id").agg(F.count_if(~F.col("accepted")).alias("conflicts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (decisions.select("source_id", "drop_skipped").join(done, "source_id", "full_outer").join(clashes, "source_id", "left")
            .select("source_id", *[zero(c) for c in ("inserted", "updated", "reactivated", "dropped", "carried", "conflicts")], "drop_skipped"))


def crawl_events(step: int, observations: DataFrame, listed: DataFrame) -> DataFrame:
    """(step, source_id, url, seen, ...) of one crawl: what was read and, with `seen` false, what was only listed."""
    read = observations.select(F.lit(step).alias("step"), "source_id", "url", F.lit(True).alias("seen"), "crawl_id", "seq", *VALUES)
    return read.unionByName(listed.select(F.lit(step).alias("step"), "source_id", "url", F.lit(False).alias("seen")), allowMissingColumns=True)


def replay(catalog: DataFrame, steps: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]], now: datetime,
           rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Several crawls in order; each guard looks at the state the one before left. Without gaps, values never depend on older ones, so the rows meet
    once (`replay_events`). With gaps, or where a step has two reports of one store, the steps follow each other as `sync`, each cut by a reliable checkpoint."""
    if not steps:
        return catalog
    reports = reduce(DataFrame.unionByName, [r.select(F.lit(k).alias("step"), "source_id", "problems") for k, (_, _, r, _) in enumerate(steps, 1)])
    if all(gaps is None for *_, gaps in steps) and reports.where(F.col("source_id").isNotNull()).groupBy("step", "source_id").count().where("count > 1").isEmpty():
        events = reduce(DataFrame.unionByName, [crawl_events(k, observations, listed) for k, (observations, listed, _, _) in enumerate(steps, 1)])
        return replay_events(catalog, events, reports, len(steps), now, rules)
    for observations, listed, report, gaps in steps:
        catalog = cut_lineage(sync(catalog, observations, listed, report, gaps, now, rules=rules).drop("action", "carried"))
    return catalog


def replay_events(catalog: DataFrame, events: DataFrame, reports: DataFrame, n_steps: int, now: datetime, rules: Rules = DEFAULT_RULES, tasks: int = 1) -> DataFrame:
    """The catalog (one row per URL) after steps 1 to `n_steps` of `sync` without gaps. `events` are those of `crawl_events`, `reports` (step, source_id,
    problems) one row per store and step.

    A URL belongs to one store all along: the one that holds it or, for a new URL, the one that claims it first. So the rows of a URL meet once, as
    `marks`: 2 * step where its store listed it, 2 * step + 1 where it read it. The guard needs but counts of active products, so the steps run over
    the numbers of products of each (store, state, marks); the decisions then go back to the products in one join."""
    tasks = max(tasks, events.sparkSession.sparkContext.defaultParallelism, -(-scanned_bytes(catalog) // PLACED_BYTES))
    seen, when_type = F.col("seen"), events.schema["seen_at"].dataType
    latest = events.repartition(tasks, "url").groupBy("url", "source_id", "step").agg(
        F.max("seen").alias("seen"), F.max(F.when(seen, F.col("seen_at"))).alias("last_at"), *[F.max_by(c, F.when(seen, F.col("seq"))).alias(c) for c in ("crawl_id", *VALUES)])
    presence = cut_lineage(latest.groupBy("step", "source_id").agg(F.count(F.lit(1)).alias("n_present"), F.max("last_at").alias("seen")), forget_size=True)
    meeting = catalog.join(_owned(catalog, latest), "url", "full_outer").withColumn("marks", F.coalesce("marks", F.array().cast("array<int>")))
    store = F.coalesce("source_id", "owner")
    state = cut_lineage(meeting.groupBy(store.alias("source_id"), F.col("is_active").alias("active"), "marks").agg(F.count(F.lit(1)).alias("n")), forget_size=True)
    decided = []
    for k in range(1, n_steps + 1):
        active = state.where("active").groupBy("source_id").agg(F.sum("n").alias("n_active"))
        rows = (reports.where(F.col("step") == k).select("source_id", "problems").join(presence.where(F.col("step") == k).drop("step"), "source_id", "left")
                .join(active, "source_id", "left"))
        decided.append(cut_lineage(_decisions(rows, now, when_type, False, rules).where("may_drop").select("source_id", F.lit(k).alias("step"), "dropped_when"), forget_size=True))
        marked = lambda n: F.array_contains("marks", F.lit(2 * k + n))  # noqa: B023, E731
        drops = F.col("active") & F.col("step").isNotNull() & ~marked(0)
        state = cut_lineage(state.join(decided[-1].select("source_id", "step"), "source_id", "left")
                            .withColumn("active", F.when(marked(1), F.lit(True)).when(drops, F.lit(False)).otherwise(F.col("active"))).drop("step"), forget_size=True)
    folder = f"{shared_folder(catalog.sparkSession)}/decisions-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, decided).write.parquet(folder)  # as files, so that their size is known: a few bytes a store
    stored = catalog.sparkSession.read.parquet(folder)
    drops = bounded(stored.groupBy(F.col("source_id").alias("store")).agg(F.array_sort(F.collect_list(F.struct("step", "dropped_when"))).alias("drops")), 32 << 20, measured=stored)
    rows = meeting.withColumn("store", store).join(drops, "store", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    gone = F.get(F.filter("drops", lambda d: (d["step"] > F.col("last")) & ~F.array_contains("marks", d["step"] * 2)), F.lit(0))
    read = F.col("last") > 0
    rows = rows.withColumn("gone", F.when(read | F.col("is_active"), gone))
    dropped = F.col("gone").isNotNull()
    return rows.select(
        F.coalesce("id", F.xxhash64("url")).alias("id"), F.col("store").alias("source_id"), "url", *[F.when(read, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in VALUES],
        F.coalesce("first_seen_at", "n_first_at").alias("first_seen_at"), F.when(dropped, F.lit(False)).when(read, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(dropped, F.col("gone.dropped_when")).when(read, F.lit(None)).otherwise(F.col("dropped_at")).alias("dropped_at"))


def _owned(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """(url, owner, marks, last, n_...) of each URL that its store listed or read; `n_...` are the values of the last step it was read in."""
    claim = F.min(F.when(F.col("seen"), F.struct("crawl_id", "source_id"))).over(Window.partitionBy("url", "step"))["source_id"]
    rows = latest.where(F.col("url").isNotNull()).withColumn("claim", claim).join(catalog.select("url", F.col("source_id").alias("held_by")), "url", "left")
    first = F.min(F.when(F.col("claim").isNotNull(), F.struct("step", "claim"))).over(Window.partitionBy("url"))
    rows = rows.withColumn("first", first).withColumn("owner", F.coalesce("held_by", F.col("first.claim")))
    since = F.when(F.col("held_by").isNotNull(), F.lit(0)).otherwise(F.col("first.step"))
    read = F.when(F.col("seen"), F.col("step"))
    return (rows.where((F.col("source_id") == F.col("owner")) & (F.col("step") >= since)).groupBy("url").agg(
        F.max("owner").alias("owner"), F.array_sort(F.collect_list(F.col("step") * 2 + F.col("seen").cast("int"))).alias("marks"), F.max(read).alias("last"),
        F.min_by("seen_at", F.when(F.col("seen_at").isNotNull(), read)).alias("n_first_at"), *[F.max_by(c, read).alias(f"n_{c}") for c in VALUES]))


# --- tags ------------------------------------------------------------------------------------------

TAG_KEY = ["product_id", "dimension", "code", "supplier_code"]


def tag_changes(stored: DataFrame, wanted: DataFrame, compared: tuple[str, ...] = ("field", "term", "rules_version", "color_family", "color_hex")) -> DataFrame:
    """Difference of two tag tables by their key, where a NULL supplier code is a value: change is added, removed, changed or same."""
    side = lambda df, p: df.select(*TAG_KEY, F.struct(*compared).alias(p))
    a, b = side(stored, "stored").alias("a"), side(wanted, "wanted").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in TAG_KEY[:3]]
    on.append(F.col("a.supplier_code").eqNullSafe(F.col("b.supplier_code")))
    change = (F.when(F.col("a.stored").isNull(), "added").when(F.col("b.wanted").isNull(), "removed")
              .when(F.col("a.stored").eqNullSafe(F.col("b.wanted")), "same").otherwise("changed"))
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in TAG_KEY], change.alias("change"))


def collapse_duplicate_tags(tags: DataFrame) -> DataFrame:
    """One row per (product, dimension, code), the lowest id: the form without supplier codes. A product's tags are few, so they are placed by
    product once and ranked there; columns that nobody reads are not moved."""
    key = ["product_id", "dimension", "code"]
    keep = [c for c in tags.columns if c not in (*key, "id")]
    first = Window.partitionBy(*key).orderBy(F.asc_nulls_last("id"))
    return (placed(tags, "product_id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
            .select("id", *key, *[F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in keep]))


def activity_backfill(products: DataFrame, days: int = 14) -> DataFrame:
    """History for a catalog that has none: first seen when last seen; inactive when seen more than `days` before its store's
    newest observation. The store maxima are an aggregate joined back, so one large store is not one task."""
    newest = products.groupBy("source_id").agg(F.max("seen_at").alias("newest"))
    rows = products.join(newest, "source_id")
    active = F.col("seen_at") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS")
    return rows.withColumn("first_seen_at", F.col("seen_at")).withColumn("is_active", active).drop("newest")
