"""What a crawl saw: listing order, model keys, completeness, facets and flags, from landed page and card tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.text import label_join


_PAGE, _ENTRY = 10 ** 18, 10 ** 28


def position() -> Column:
    """A card's place in its crawl as one number: entry, page (both int) and place on the page (below 10^18). A decimal keeps the minima below
    in hash aggregates, where a struct would sort all cards, and holds every value of these columns."""
    part = lambda name, size: F.col(name).cast("decimal(20,0)") * F.lit(str(size)).cast("decimal(29,0)")
    return (part("entry", _ENTRY) + part("page", _PAGE) + F.col("pos").cast("decimal(20,0)")).cast("decimal(38,0)")


def _entry_and_page(place: str) -> tuple[Column, Column]:
    """The parts of a position again."""
    entry = F.expr(f"cast({place} div cast('{_ENTRY}' as decimal(29,0)) as int)")
    page = F.expr(f"cast(({place} % cast('{_ENTRY}' as decimal(29,0))) div cast('{_PAGE}' as decimal(19,0)) as int)")
    return entry, page


def first_appearances(cards: DataFrame, model: Column | None = None) -> DataFrame:
    """One row per crawl and URL with its first place and its model key, an expression on the URL."""
    key = F.lit(None).cast("string") if model is None else model
    return cards.groupBy("crawl_id", "url").agg(F.min(position()).alias("first")).withColumn("model", key)


def kept_cards(firsts: DataFrame) -> DataFrame:
    """The first URL of each model; URLs without a model key are all kept. The others stay listed but are not products."""
    # one pass over the first appearances: a join with the best of each model would make them twice. URLs without a model are groups of their own
    own = F.when(F.col("model").isNull(), F.col("url"))
    best = F.min("first").over(Window.partitionBy("crawl_id", "model", own))
    kept = F.col("model").isNull() | ((F.col("first") == F.col("best")) & F.col("crawl_id").isNotNull())
    return firsts.withColumn("best", best).where(kept).select("crawl_id", "url", "first", "model")


def listing_ranks(kept: DataFrame) -> DataFrame:
    """1-based rank of each kept URL in its crawl's listing order. Cards are numbered inside their page and pages are
    numbered by a prefix sum over page counts, so one long crawl is spread over its pages instead of one sorted task."""
    entry, page = _entry_and_page("first")
    rows = kept.select("crawl_id", "url", "model", "first", entry.alias("entry"), page.alias("page"))
    sizes = rows.groupBy("crawl_id", "entry", "page").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("crawl_id").orderBy("entry", "page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("crawl_id", "entry", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("crawl_id", "entry", "page").orderBy("first", "url")
    return (rows.withColumn("k", F.row_number().over(inside)).join(offsets, ["crawl_id", "entry", "page"])
            .select("crawl_id", "url", "model", "entry", (F.col("offset") + F.col("k")).cast("long").alias("rank")))


def category_labels(cards: DataFrame) -> DataFrame:
    """(crawl_id, url, categories): the categories of the entries a URL is listed under, in order of appearance, ", "-joined."""
    seen = (cards.where(F.col("category").isNotNull()).groupBy("crawl_id", "url", "category")
            .agg(F.min(position()).alias("first")))
    return seen.groupBy("crawl_id", "url").agg(
        label_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "category"))), lambda x: x["category"])).alias("categories"))


# --- completeness ----------------------------------------------------------------------------------

def listing_problems(pages: DataFrame) -> DataFrame:
    """Why listings may be incomplete, one row per problem in order. `pages`: (crawl_id, entry, start, page, fetched, cards, has_next,
    max_pages, paginated, via_next); via_next means pages are reached by following links."""
    empty_later = F.col("fetched") & (F.col("cards") == 0) & (F.col("page") > 1)
    stop = pages.groupBy("crawl_id", "entry").agg(
        F.min(F.when(empty_later, F.col("page"))).alias("stop"))
    rows = pages.join(stop, ["crawl_id", "entry"]).where(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
    page = F.concat(F.col("start"), F.lit(" page "), F.col("page").cast("string"))
    text = (F.when(~F.col("fetched"), F.concat(page, F.lit(": not fetched")))
            .when(empty_later, F.when(F.col("via_next"), F.concat(page, F.lit(": listed nothing"))))
            .when(F.col("cards") == 0, F.concat(F.col("start"), F.lit(": first page listed nothing"))))
    one = rows.where(text.isNotNull()).select("crawl_id", "entry", "page", text.alias("problem"))
    # pages read and not past the end: the last of them decides whether the listing was cut off
    last = (rows.where(F.col("fetched") & ~empty_later).groupBy("crawl_id", "entry", "start", "max_pages", "paginated", "via_next")
            .agg(F.max_by(F.struct("page", "cards", "has_next"), "page").alias("last")))
    cut = F.col("paginated") & (F.col("last.page") == F.col("max_pages")) & (F.col("last.cards") > 0) & (~F.col("via_next") | F.col("last.has_next"))
    capped = last.where(cut).select("crawl_id", "entry", F.lit(2 ** 31 - 1).alias("page"), F.concat(
        F.col("start"), F.lit(": stopped at max_pages ("), F.col("max_pages").cast("string"), F.lit(") with more to list")).alias("problem"))
    return one.unionByName(capped)


def crawl_problems(problems: DataFrame) -> DataFrame:
    """(crawl_id, problems): the list of each crawl, at most one entry per page read."""
    return problems.groupBy("crawl_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("entry", "page", "problem"))), lambda p: p["problem"]).alias("problems"))


# --- facets ----------------------------------------------------------------------------------------

FACET = ["crawl_id", "entry", "facet", "label", "flag", "per_variant", "ord"]


def facet_matches(cards: DataFrame, ranks: DataFrame) -> DataFrame:
    """Facet cards that belong to a product of the plain listing; others are ignored."""
    return cards.join(ranks.select("crawl_id", "url"), ["crawl_id", "url"], "left_semi")


def facet_gaps(pages: DataFrame, cards: DataFrame, ranks: DataFrame) -> DataFrame:
    """Facet values whose pages failed, or whose cards match nothing that was listed."""
    known = ranks.select("crawl_id", "url").withColumn("known", F.lit(True))
    matched = (cards.join(known, ["crawl_id", "url"], "left").groupBy("crawl_id", "entry", "facet", "label")
               .agg(F.count(F.lit(1)).alias("cards"), F.count("known").alias("matched")))
    read = pages.groupBy(*FACET).agg((F.count_if(~F.col("fetched")) > 0).alias("failed"))
    rows = read.join(matched, ["crawl_id", "entry", "facet", "label"], "left")
    text = F.when(F.col("failed"), F.lit("not fetched")).when(
        (F.col("cards") > 0) & (F.col("matched") == 0),
        F.concat(F.col("cards").cast("string"), F.lit(" cards, none matches a listed product")))
    return rows.where(text.isNotNull()).select(*FACET, text.alias("reason"))


def facet_labels(matches: DataFrame) -> DataFrame:
    """(crawl_id, url, raw_specs): labels of the plain facets, in facet-value order, ", "-joined per facet."""
    one = matches.where(F.col("flag").isNull()).groupBy("crawl_id", "url", "facet", "label").agg(F.min("ord").alias("ord"))
    joined = one.groupBy("crawl_id", "url", "facet").agg(
        F.min("ord").alias("ord"), label_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"])).alias("labels"))
    return joined.groupBy("crawl_id", "url").agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "facet", "labels"))), lambda x: F.struct(x["facet"], x["labels"]))).alias("raw_specs"))


def variant_colors(matches: DataFrame) -> DataFrame:
    """(crawl_id, url, variant_colors): the first label of each variant of the per-variant facets."""
    rows = matches.where(F.col("per_variant") & (F.col("variant_id") != ""))
    first = rows.groupBy("crawl_id", "url", "variant_id").agg(F.min_by("label", "ord").alias("label"))
    return first.groupBy("crawl_id", "url").agg(F.map_from_entries(F.collect_list(F.struct("variant_id", "label"))).alias("variant_colors"))


def with_variant_colors(products: DataFrame, colors: DataFrame) -> DataFrame:
    """Puts the facet labels on the variants with that id that have no colour yet."""
    rows = products.join(colors, ["crawl_id", "url"], "left")
    fill = lambda v: F.when(v["color"].isNull() & F.col("variant_colors")[v["id"]].isNotNull(), v.withField("color", F.col("variant_colors")[v["id"]])).otherwise(v)
    variants = F.when(F.col("variant_colors").isNotNull(), F.transform("variants", fill)).otherwise(F.col("variants"))
    return rows.withColumn("variants", variants).drop("variant_colors")


def facet_flags(matches: DataFrame, ranks: DataFrame, gaps: DataFrame, facets: DataFrame) -> DataFrame:
    """(crawl_id, url, flag, value): True for matched products; False for the other products of the same listing entry, only when
    every page of the facet was read and matched. An incomplete facet leaves the others unknown. `facets`: (crawl_id, entry,
    flag) of the flag facets that were passed."""
    true = matches.where(F.col("flag").isNotNull()).select("crawl_id", "url", "flag").distinct().withColumn("hit", F.lit(True))
    broken = gaps.where(F.col("flag").isNotNull()).select("crawl_id", "entry", "flag").distinct().withColumn("broken", F.lit(True))
    passed = facets.select("crawl_id", "entry", "flag").distinct().join(broken, ["crawl_id", "entry", "flag"], "left")
    # a product can also be hit through another entry's pass of the same flag, hence the outer join
    rows = (ranks.select("crawl_id", "entry", "url").join(passed, ["crawl_id", "entry"])
            .join(true, ["crawl_id", "url", "flag"], "full_outer"))
    value = F.when(F.col("hit"), F.lit(True)).when(F.col("broken").isNull(), F.lit(False))
    return rows.select("crawl_id", "url", "flag", value.alias("value")).where(F.col("value").isNotNull())


def flag_listing(cards: DataFrame, ranks: DataFrame) -> DataFrame:
    """A flag-only listing: True on products the main listings hold, nothing else, never a new product."""
    return facet_matches(cards, ranks).select("crawl_id", "url", "flag").distinct().withColumn("value", F.lit(True))


def crawl_outcomes(crawls: DataFrame, problems: DataFrame, gaps: DataFrame) -> DataFrame:
    """(crawl_id, status, problems): ok without problems and gaps, else incomplete; the gaps' notes follow the problems."""
    notes = gaps.groupBy("crawl_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "ord", "facet", "label", "reason"))), lambda g: F.concat(
        F.lit("facet "), g["facet"], F.lit(" = "), g["label"], F.lit(": "), g["reason"])).alias("notes"))
    none = F.array().cast("array<string>")
    rows = crawls.select("crawl_id").join(crawl_problems(problems), "crawl_id", "left").join(notes, "crawl_id", "left")
    every = F.concat(F.coalesce("problems", none), F.coalesce("notes", none))
    return rows.select("crawl_id", F.when(F.size(every) == 0, "ok").otherwise("incomplete").alias("status"), every.alias("problems"))
