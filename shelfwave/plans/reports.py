"""Composite reports. Each is a set of named frames, or ordered text lines for the weekly brief."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwave.functions.dates import last_weeks
from shelfwave.operators import catalog as C, gaps as G, mentions as M, pairings as P, presence as R, shelf as H, trends as T
from shelfwave.operators.series import KEY
from shelfwave.rules import DEFAULT_RULES, TYPE_FR, Rules

Frames = dict[str, DataFrame]


def overview(documents: DataFrame, mentions: DataFrame, sources: DataFrame, snapshots: DataFrame, dictionary: DataFrame, week: date,
             top: int = 5, rules: Rules = DEFAULT_RULES) -> Frames:
    """Header counts, leaders per dimension and worst declines with their sparklines and labels."""
    sparks = T.sparklines(snapshots, week, rules.spark_weeks)
    dressed = lambda rows: G.with_labels(rows.join(sparks, KEY), dictionary)
    return {"counters": M.counters(documents, mentions, sources), "rising": dressed(T.top_rising(snapshots, week, top)),
            "declining": dressed(T.top_declining(snapshots, week, top))}


def dimension_trends(snapshots: DataFrame, dictionary: DataFrame, dimension: str, week: date, weeks: int = 12) -> DataFrame:
    rows = T.trend_table(snapshots, week, weeks, dimension)
    return G.with_labels(rows, dictionary).orderBy(F.desc("current"), "code")


def detail_search(interest: DataFrame, code: str, end: date, weeks: int = 12) -> DataFrame:
    """(week, home, world) of one attribute over the period, the last stored row of a cell winning."""
    first = end - timedelta(weeks=weeks - 1)
    rows = interest.where((F.col("code") == code) & (F.col("week") >= F.lit(first)) & (F.col("week") <= F.lit(end)))
    values = T.demand_values(rows.withColumn("dimension", F.lit(""))).select("week", "fr", "world")
    grid = interest.sparkSession.createDataFrame([(w,) for w in last_weeks(end, weeks)], "week date")
    return grid.join(values, "week", "left").orderBy("week")


def attribute_detail(documents: DataFrame, mentions: DataFrame, sources: DataFrame, snapshots: DataFrame, interest: DataFrame,
                     products: DataFrame, tags: DataFrame, crawls: DataFrame, dictionary: DataFrame, dimension: str, code: str,
                     week: date, now: datetime, weeks: int = 12, rules: Rules = DEFAULT_RULES) -> Frames:
    """Every panel of one attribute. The attribute filter is pushed into each source before any join."""
    mine = lambda df: df.where((F.col("dimension") == dimension) & (F.col("code") == code))
    own = mine(snapshots)
    enriched = M.enrich(mine(mentions), documents, sources)
    recent = M.last_four_weeks(enriched, week)
    wanted = tags.where(((F.col("dimension") == dimension) & (F.col("code") == code)) | (F.col("dimension") == "product_type"))
    header, prices = R.presence(products, wanted, sources, crawls, now, rules)
    frames = {
        "series": own.where((F.col("week") >= F.lit(last_weeks(week, weeks)[0])) & (F.col("week") <= F.lit(week))),
        "stats": T.series_stats(own, week, weeks), "streak": T.rising_streaks(own, week, weeks), "current": T.with_reason(T.at_week(own, week)),
        "share": mine(T.share_of_voice(snapshots.where(F.col("dimension") == dimension), week)), "search": detail_search(interest, code, week, weeks),
        "stance": M.stance_counts(recent, KEY), "brands": M.co_mentioned_brands(documents, M.last_four_weeks(mine(mentions), week)),
        "evidence": M.latest_evidence(enriched, week + timedelta(days=6)), "retail": header, "prices": prices,
        "sample": R.presence_sample(products, tags, sources, crawls, dimension, code, now, rules)}
    if dimension == "color":
        frames["pairings"] = P.color_pairings(P.pairing_rows(products, tags, sources, dictionary.where(F.col("dimension") == "color")), code, rules)
    return frames


def retail_overview(snapshots: DataFrame, products: DataFrame, tags: DataFrame, sources: DataFrame, dictionary: DataFrame, week: date,
                    rules: Rules = DEFAULT_RULES) -> Frames:
    """Market shelf against press: stores, products per shelf, gaps, dimensions left out, thresholds."""
    cells = H.shelf(products, tags, sources, by_type=True, rules=rules)
    dimensions = H.shelf_dimensions(cells, True, rules)
    gaps = G.shelf_gaps(snapshots, cells, week, True, rules)
    thresholds = [("opportunity_share", rules.opportunity_share), ("risk_share", rules.risk_share), ("min_tagged", float(rules.min_tagged))]
    return {"stores": H.store_summary(H.active_products(products, sources, rules.market_country)), "types": H.shelf_counts(cells),
            "gaps": G.ranked(G.with_labels(gaps, dictionary)), "skipped": G.skipped_dimensions(dimensions),
            "thresholds": products.sparkSession.createDataFrame(thresholds, "name string, value double")}


def catalog_monitor(stores: DataFrame, sources: DataFrame, crawls: DataFrame, products: DataFrame, tags: DataFrame, dictionary: DataFrame,
                    now: datetime, rules: Rules = DEFAULT_RULES) -> Frames:
    """State of every store and what creator catalogs added."""
    scope = C.creator_scope(sources, C.baselines(crawls), rules)
    by_store = C.new_by_store(products, scope, now, rules)
    top = C.new_by_attribute(products, tags, scope, now, rules).limit(rules.top_attributes)
    return {"stores": C.store_status(stores, sources, crawls, products, now, rules), "top": G.with_labels(top, dictionary),
            "totals": by_store.agg(F.sum("new").alias("new_total"), F.sum("retired").alias("retired_total"))}


# --- weekly brief ----------------------------------------------------------------------------------

def whole_percent(share: Column) -> Column:
    """"12 %", half-even."""
    return F.concat(F.rint(share * 100).cast("long").cast("string"), F.lit(" %"))


def signed_percent(share: Column) -> Column:
    """"+12%" or "-3%"; a negative value that rounds to 0 stays "-0%"."""
    n = F.abs(F.rint(share * 100)).cast("long").cast("string")
    return F.concat(F.when(share < 0, "-").otherwise("+"), n, F.lit("%"))


def score_line(labels: dict[str, str]) -> Column:
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("dimension")], F.col("dimension"))
    fading = F.coalesce(F.concat(F.rint(F.col("decline_share") * 100).cast("long").cast("string"), F.lit("%")), F.lit("n/d"))
    return F.concat_ws(" | ", name, F.coalesce("label", F.col("code")), F.format_string("%.1f", "mentions"),
                       F.rint(F.coalesce("volume_4w", F.lit(0.0))).cast("long").cast("string"), signed_percent(F.col("momentum")), F.col("status"), fading)


def _section(rows: DataFrame, section: int, order: list, title: str | None = None) -> DataFrame:
    """Lines of one section numbered from 1, its title as line 0 when there are lines. Sections are dictionary-sized."""
    lines = rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long")).select(F.lit(section).alias("section"), "ord", "line")
    if title is None:
        return lines
    head = lines.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(title).alias("line"))
    return head.unionByName(lines)


# Titles and sentence patterns of the weekly brief, which its readers match.
SCORES_TITLE = ("Scores (dimension | attribut | mentions pondérées cette semaine | mentions sur 4 sem. | momentum du volume | statut | part des avis "
                "« en recul » sur 4 sem.):")
MUST_CITE_TITLE = ("Couleurs à citer obligatoirement (≥ {0} mentions sur 4 sem., en hausse ou au pic ; au moins une puce dédiée, famille nommée telle quelle) :")
WEAK_TITLE = "Signaux faibles (trop peu de mentions pour conclure, à citer seulement comme « à surveiller ») :"


def press_brief(snapshots: DataFrame, mentions: DataFrame, documents: DataFrame, dictionary: DataFrame, week: date, labels: dict[str, str],
                rules: Rules = DEFAULT_RULES, extracts: int = 12) -> DataFrame:
    """(section, ord, line): scores by momentum, colours that must be cited, weak signals, up to `extracts` source extracts (those
    mentioned last first; the order is ours)."""
    current = T.at_week(snapshots, week).join(T.four_week_volume(snapshots, week), KEY, "left")
    rows = G.with_labels(current, dictionary).withColumn("line", score_line(labels))
    shown = rows.where((F.col("mentions") > 0) | (F.coalesce("search", F.lit(0.0)) != 0))
    by_momentum = [F.desc("momentum"), "dimension", "code"]
    cited = rows.where((F.col("dimension") == rules.must_cite_dimension) & F.col("status").isin("en_hausse", "au_pic")
                       & (T.in_tenths(F.col("volume_4w")) >= rules.must_cite_min))
    used = M.documents_with(documents.where(F.col("summary_fr").isNotNull()), mentions.where(F.col("occurred_on") >= F.lit(week)))
    days = mentions.where(F.col("occurred_on") >= F.lit(week)).groupBy(F.col("document_id").alias("id")).agg(F.max("occurred_on").alias("day"))
    texts = (used.join(days, "id").groupBy("summary_fr").agg(F.max("day").alias("day")).orderBy(F.desc("day"), "summary_fr").limit(extracts)
             .withColumn("line", F.concat(F.lit("- "), F.col("summary_fr"))))
    return (_section(shown.where(F.col("status") != "faible"), 1, by_momentum, SCORES_TITLE)
            .unionByName(_section(cited, 2, by_momentum, MUST_CITE_TITLE.format(rules.must_cite_min // 10)))
            .unionByName(_section(shown.where(F.col("status") == "faible"), 3, by_momentum, WEAK_TITLE))
            .unionByName(_section(texts, 4, [F.desc("day"), "summary_fr"], "Extraits de sources:")))


def relative_points(depth: Column) -> Column:
    """"+34 pts vs habituelle"; "n/d" without list prices."""
    n = F.rint(depth * 100)
    text = F.concat(F.when(depth < 0, "-").otherwise("+"), F.abs(n).cast("long").cast("string"), F.lit(" pts vs habituelle"))
    return F.coalesce(text, F.lit("n/d"))


def shelf_lines(items: DataFrame, prices: DataFrame, dimensions: DataFrame, dictionary: DataFrame, labels: dict[str, str], top: int = 6,
                rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(shelf, dimension, ord, line): the most stocked attributes of every comparable dimension of each shelf; a dimension that cannot
    be compared has one line saying why."""
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("dimension")], F.col("dimension"))
    money = prices.groupBy("shelf", "dimension", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("currency", "avg_price"))), lambda p: F.concat(
        F.rint(p["avg_price"]).cast("long").cast("string"), F.lit(" "), p["currency"])), " / ").alias("money"))
    w = Window.partitionBy("shelf", "dimension").orderBy(F.desc("sku"), "code")
    best = (items.join(dimensions.where("comparable").select("shelf", "dimension"), ["shelf", "dimension"])
            .withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top).join(money, ["shelf", "dimension", "code"], "left"))
    best = G.with_labels(best, dictionary).select("shelf", "dimension", "ord", F.concat_ws(
        " | ", name, F.coalesce("label", F.col("code")), F.col("sku").cast("string"), whole_percent(F.col("share")), F.coalesce("money", F.lit("n/d")), relative_points(F.col("relative_depth"))).alias("line"))
    why = F.when(F.col("tagged") < rules.min_tagged, F.concat(F.col("tagged").cast("string"), F.lit(" références renseignées"))).otherwise(
        F.concat(F.lit("vocabulaire des boutiques non reconnu pour "), whole_percent(F.col("unmapped_share")), F.lit(" des valeurs")))
    short = dimensions.where(~F.col("comparable")).select("shelf", "dimension", F.lit(0).alias("ord"), F.concat(
        name, F.lit(" : couverture insuffisante ("), why, F.lit("), pas de comparaison.")).alias("line"))
    return best.unionByName(short)


def gap_lines(gaps: DataFrame, dictionary: DataFrame, labels: dict[str, str], top: int = 3) -> DataFrame:
    """(kind, ord, line): the strongest opportunities and risks as sentences."""
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("dimension")], F.col("dimension"))
    kind_fr = F.create_map(*[F.lit(x) for pair in TYPE_FR.items() for x in pair])[F.col("shelf")]
    word = F.when(F.col("status") == "en_hausse", "en hausse").when(F.col("status") == "au_pic", "au pic").when(F.col("status") == "en_baisse", "en baisse").otherwise(F.col("status"))
    weight = F.when(F.col("kind") == "opportunity", F.col("momentum")).otherwise(F.col("share"))
    w = Window.partitionBy("kind").orderBy(F.desc(weight), "dimension", "code", "shelf")
    rows = G.with_labels(gaps.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top), dictionary)
    label = F.coalesce("label", F.col("code"))
    sku = F.col("sku").cast("string")
    rise = F.concat(F.lit("Opportunité ("), kind_fr, F.lit(") : "), label, F.lit(" ("), name, F.lit(") — "), word, F.lit(" dans la presse ("), signed_percent(F.col("momentum")),
                    F.lit("), "), sku, F.lit(" référence(s) en rayon ("), whole_percent(F.col("share")), F.lit(")"))
    clearing = F.when(F.col("clearance"), F.concat(F.lit(", déstockage : remise "), relative_points(F.col("relative_depth")))).otherwise(F.lit(""))
    risk = F.concat(F.lit("Risque de stock ("), kind_fr, F.lit(") : "), label, F.lit(" ("), name, F.lit(") — en baisse dans la presse ("), signed_percent(F.col("momentum")),
                    F.lit("), "), sku, F.lit(" références en rayon ("), whole_percent(F.col("share")), F.lit(")"), clearing)
    return rows.select("kind", "ord", F.when(F.col("kind") == "opportunity", rise).otherwise(risk).alias("line"))


def catalog_lines(products: DataFrame, tags: DataFrame, scope: DataFrame, dictionary: DataFrame, labels: dict[str, str], now: datetime,
                  top: int = 4, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(dimension, ord, line): the leading attributes of the creator catalogs' new products; no row below the minimum of new
    products, where nothing may be concluded."""
    rows = C.new_by_attribute(products, tags, scope, now, rules).where(F.col("share_new").isNotNull())
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("dimension")], F.col("dimension"))
    w = Window.partitionBy("dimension").orderBy(F.desc("new"), "code")
    best = G.with_labels(rows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top), dictionary)
    return best.select("dimension", "ord", F.concat_ws(" | ", name, F.coalesce("label", F.col("code")), F.col("new").cast("string"),
                                                       whole_percent(F.col("share_new")), whole_percent(F.col("share_catalog"))).alias("line"))


def catalog_store_line(by_store: DataFrame) -> DataFrame:
    """One line naming every creator store with its new and retired products (as many parts as there are configured stores)."""
    part = F.concat(F.col("store"), F.lit(" : "), F.col("new").cast("string"), F.lit(" nouveauté(s), "), F.col("retired").cast("string"), F.lit(" retirée(s)"))
    return by_store.select(F.struct("store", part.alias("part")).alias("s")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]), " ; ").alias("line"))
