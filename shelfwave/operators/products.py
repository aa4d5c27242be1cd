"""Product records: layer merge, spec maps, colour splits and the contract every observation must meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.text import blank_to_null, collapse, let
from shelfwave.functions.urls import stored

FIELDS = ("name", "brand", "price", "list_price", "currency", "image_url")


def merged(layers: list[str], default_currency: str | None = None, default_brand: str | None = None) -> list[Column]:
    """Per field the first layer (struct columns, most trusted first) with a usable value. A price of 0 or less is no price; the
    list price may only come from the layer that gave the price."""
    usable = lambda layer: F.col(f"{layer}.price") > 0
    first = {f: F.coalesce(*[F.col(f"{layer}.{f}") for layer in layers]) for f in ("name", "brand", "currency", "image_url")}
    price = F.coalesce(*[F.when(usable(layer), F.col(f"{layer}.price")) for layer in layers])
    listed = F.lit(None).cast("double")
    for layer in reversed(layers):
        listed = F.when(usable(layer), F.when(F.col(f"{layer}.list_price") > 0, F.col(f"{layer}.list_price"))).otherwise(listed)
    fill = lambda c, default: c if default is None else F.coalesce(c, F.lit(default))
    values = {**first, "price": price, "list_price": listed, "currency": fill(first["currency"], default_currency), "brand": fill(first["brand"], default_brand)}
    return [values[f].alias(f) for f in FIELDS]


def merged_specs(winner: Column, loser: Column) -> Column:
    """Two label maps in one; the winner's value stays on a shared label."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    win, lose = F.coalesce(winner, empty), F.coalesce(loser, empty)
    return F.map_concat(F.map_filter(lose, lambda k, v: ~F.map_contains_key(win, k)), win)


def description_specs(text: Column) -> Column:
    """"Label : value" pairs of a description, cut at dashes, bars, bullets, semicolons and line breaks; the first of a label wins."""
    pattern = r"^([^:]{2,40}?)\s*:\s*(.+)$"
    parts = F.filter(F.transform(F.split(text, "[–—|•;\n]"), lambda p: collapse(p)), lambda p: p.rlike(pattern))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, pattern, 1)).alias("key"), F.trim(F.regexp_extract(p, pattern, 2)).alias("value")))
    kind = "array<struct<key:string,value:string>>"
    kept = F.aggregate(pairs, F.array().cast(kind), lambda acc, e: F.when(F.exists(acc, lambda a: a["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e))))
    return F.map_from_entries(F.coalesce(kept, F.array().cast(kind)))


def sold_out(flag: Column, variants: Column) -> Column:
    """An explicit flag wins; else sold out only when stock is stated and no variant is available."""
    stated = F.filter(variants, lambda v: v["in_stock"].isNotNull())
    return F.coalesce(flag, F.when(F.size(stated) > 0, ~F.exists(stated, lambda v: v["in_stock"])))


@dataclass(frozen=True)
class ColorSplit:
    sep: str
    color: int = 0
    then: "ColorSplit | None" = None


def split_colors(variants: Column, split: ColorSplit) -> Column:
    """Compound colour names cut down to the frame's part; all parts are kept beside it. A name without the requested part loses its
    colour rather than getting a wrong one."""
    cut = lambda text, level: F.transform(F.split(text, _literal(level.sep)), lambda p: F.trim(p))
    part = lambda parts, level: F.coalesce(F.get(parts, F.lit(level.color)), F.lit(""))
    several = lambda parts: F.when(F.size(parts) > 1, parts)

    def one(v: Column) -> Column:
        def first(parts: Column) -> Column:
            chosen = part(parts, split)
            if split.then is None:
                return v.withField("parts", F.coalesce(several(parts), v["parts"])).withField("color", blank_to_null(chosen))
            return let(cut(chosen, split.then), lambda sub: v.withField("parts", F.coalesce(several(parts), v["parts"]))
                       .withField("subparts", F.coalesce(F.when(chosen != "", several(sub)), v["subparts"]))
                       .withField("color", F.when(chosen != "", blank_to_null(part(sub, split.then)))))
        return F.when(v["color"].isNotNull(), let(cut(v["color"], split), first)).otherwise(v)

    return F.transform(variants, one)


def _literal(text: str) -> str:
    import re
    return re.escape(text)


def stripped_name(name: Column, pattern: str | None) -> Column:
    """The name without a store's boilerplate; the original when nothing would remain."""
    return name if not pattern else F.coalesce(blank_to_null(F.trim(F.regexp_replace(name, pattern, ""))), name)


def checked(rows: DataFrame, max_url: int = 1000, max_name: int = 300, max_brand: int = 100) -> DataFrame:
    """Every record in its clean form with `errors`, the reasons it breaks the contract (empty when it holds)."""
    name = F.substring(collapse(F.col("name")), 1, max_name)
    brand = blank_to_null(F.substring(F.trim("brand"), 1, max_brand))
    currency = blank_to_null(F.upper(F.trim("currency")))
    valid_image = F.col("image_url").isNull() | stored(F.col("image_url"), max_url).isNotNull()
    rules = [(F.coalesce(name, F.lit("")) == "", "name: empty"), (F.col("price") < 0, "price: negative"), (F.col("list_price") < 0, "list_price: negative"),
             (~currency.rlike("^[A-Z]{3}$"), "currency: not a 3-letter code"), (F.col("rank") < 1, "rank: below 1"),
             (stored(F.trim("url"), max_url).isNull(), "url: invalid or too long"), (~valid_image, "image_url: invalid or too long")]
    errors = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for bad, reason in rules]), lambda e: e.isNotNull())
    clean = {"url": stored(F.trim("url"), max_url), "name": name, "brand": brand, "currency": currency, "image_url": stored(F.col("image_url"), max_url),
             "list_price": F.when(F.col("list_price") > F.col("price"), F.col("list_price"))}
    return rows.withColumn("errors", errors).withColumns(clean)


def valid(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.where(F.size("errors") == 0).drop("errors")


def error_counts(checked_rows: DataFrame) -> DataFrame:
    """Quarantined records per reason."""
    return checked_rows.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
