"""Rule-based attribute tags of products, found row by row inside the JVM: no shuffle from product to tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.text import fold, fold_py, let, match_phrases, phrase_index, supplier_code
from shelfwave.operators.joins import bounded
from shelfwave.operators.history import tag_changes
from shelfwave.operators.phrases import MATCH, matched_texts
from shelfwave.operators.shelf import SPEC_DIMENSIONS
from shelfwave.sources.dictionary import CATEGORY_WORDS, Dictionary

MAX_COMBINATION = 40
TAG = "array<struct<dimension:string,code:string,field:string,term:string,supplier_code:string>>"


def normalize_terms(terms: DataFrame, phrases: DataFrame, column: str = "term", dimension: str | None = None) -> DataFrame:
    """Adds (dimension, code) of the first dictionary entry whose code, label or phrase equals the folded term; NULL when
    unknown. `phrases` is dictionary-sized."""
    table = phrases if dimension is None else phrases.where(F.col("dimension") == dimension)
    first = table.groupBy("phrase").agg(F.min_by(F.struct("dimension", "code"), "ord").alias("hit"))
    rows = terms.withColumn("_folded", fold(F.col(column))).join(bounded(first), F.col("_folded") == F.col("phrase"), "left")
    return rows.select(*[F.col(c) for c in terms.columns], F.col("hit.dimension").alias("dimension"), F.col("hit.code").alias("code"))


def color_tiers(dictionary: Dictionary) -> Column:
    """Map literal: colour code -> hex."""
    pairs = [F.lit(x) for i in dictionary.of("color") for x in (i.code, i.hex)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _tag(dimension: Column, code: Column, field: Column, term: Column, supplier: Column) -> Column:
    return F.struct(dimension.alias("dimension"), code.alias("code"), field.alias("field"), term.alias("term"), supplier.alias("supplier_code"))



#: (text, group of phrases) -> its matches: a walk over a literal list, or a look into what `matched_texts` joined to the row.
Match = Callable[[Column, str], Column]


def literal_match(dictionary: Dictionary) -> Match:
    """For small dictionaries: the phrases are a literal of the plan."""
    audience = [(fold_py(w), code) for (d, code), words in CATEGORY_WORDS.items() if d == "audience" for w in words]
    pairs = {"spec:audience": audience, "category": [(fold_py(w), f"{d}/{c}") for (d, c), ws in CATEGORY_WORDS.items() for w in ws]}
    for d in dictionary.dimensions:
        pairs |= {f"free:{d}": dictionary.pairs(d, True), f"spec:{d}": dictionary.spec_pairs(d), f"spec-free:{d}": dictionary.spec_pairs(d, True)}
    return lambda text, group: match_phrases(fold(text), phrase_index(pairs[group]))


def joined_match(text: Column, group: str) -> Column:
    return F.coalesce(F.col("_matches")[F.concat(F.lit(f"{group}\t"), fold(text))], F.array().cast(MATCH))


def _found(text: Column, match: Match, group: str, dimension: str, field: Column, supplier: Column | None = None) -> Column:
    none = F.lit(None).cast("string") if supplier is None else supplier
    return F.transform(match(text, group), lambda m: _tag(F.lit(dimension), m["code"], field, m["phrase"], none))


def _empty() -> Column:
    return F.array().cast(TAG)


def _label_keys(dimensions: tuple[str, ...], labels: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """Folded spec labels of each dimension that has any."""
    keys = {d: [k for k, dims in labels.items() if d in dims] for d in (*dimensions, "audience")}
    return {d: k for d, k in keys.items() if k}


def spec_tags(raw_specs: Column, dimensions: tuple[str, ...], match: Match, labels: dict[str, tuple[str, ...]] = SPEC_DIMENSIONS) -> Column:
    """Spec values, each matched only against the dimension(s) its label speaks about, store aliases included."""
    entries = F.map_entries(raw_specs)

    def of(dimension: str, keys: list[str]) -> Column:
        wanted = F.filter(entries, lambda e: fold(e["key"]).isin(keys))
        return F.flatten(F.transform(wanted, lambda e: _found(e["value"], match, f"spec:{dimension}", dimension, F.concat(F.lit("spec:"), e["key"]))))

    parts = [of(dimension, keys) for dimension, keys in _label_keys(dimensions, labels).items()]
    return F.coalesce(F.concat(*parts), _empty())


def text_tags(name: Column, flags: str, dimensions: tuple[str, ...], match: Match) -> Column:
    """Description (shapes only), material, categories and name, in that order of trust."""
    at = lambda key: F.col(f"{flags}.{key}")
    out = []
    if "shape" in dimensions:
        out.append(_found(at("description"), match, "spec-free:shape", "shape", F.lit("description")))
    if "material" in dimensions:
        out.append(_found(at("material"), match, "spec:material", "material", F.lit("material")))
    out.append(F.transform(match(at("categories"), "category"), lambda m: _tag(
        F.get(F.split(m["code"], "/"), F.lit(0)), F.get(F.split(m["code"], "/"), F.lit(1)), F.lit("categories"), m["phrase"], F.lit(None).cast("string"))))
    out += [_found(at("categories"), match, f"free:{d}", d, F.lit("categories")) for d in dimensions]
    out += [_found(name, match, f"free:{d}", d, F.lit("name")) for d in dimensions]
    return F.concat(*out)


def layer_tags(layers: Column, code: Column, match: Match) -> Column:
    """A layered variant: a tag per layer's family, two_tone unless every layer is the same known family, and a combination tag
    of the sorted distinct families when every layer has one."""
    found = F.transform(layers, lambda x: match(x, "spec:color"))
    color, layer, whole = F.lit("color"), F.lit("variant-layer"), F.lit("variant-layers")
    term = F.substring(fold(F.array_join(layers, " / ")), 1, 100)


    def build(hits: Column) -> Column:
        flat = F.flatten(hits)
        families = F.array_sort(F.array_distinct(F.transform(flat, lambda m: m["code"])))
        complete = F.forall(hits, lambda h: F.size(h) > 0)
        combination = F.array_join(families, "+")
        two_tone = F.array(_tag(color, F.lit("two_tone"), whole, term, code))
        combined = F.array(_tag(F.lit("lamination"), combination, whole, term, code))
        return F.concat(
            F.transform(flat, lambda m: _tag(color, m["code"], layer, m["phrase"], code)),
            F.when(complete & (F.size(families) == 1), _empty()).otherwise(two_tone),
            F.when(complete & (F.size(families) >= 2) & (F.length(combination) <= MAX_COMBINATION), combined).otherwise(_empty()))

    return let(found, build)


def _layers(v: Column) -> Column:
    return F.filter(F.coalesce(v["layers"], F.array().cast("array<string>")), lambda x: x.isNotNull())


def variant_tags(variants: Column, match: Match) -> Column:
    """Variant colour labels; the tag keeps the variant's own code. Variants without a code give nothing."""
    def one(v: Column) -> Column:
        code = supplier_code(v["code"])
        layers = _layers(v)
        named = F.when(v["color"].isNotNull(), _found(v["color"], match, "spec:color", "color", F.lit("variant"), code)).otherwise(_empty())
        layered = F.when(F.size(layers) >= 2, layer_tags(layers, code, match)).otherwise(_empty())
        return F.when(code.isNotNull(), F.concat(named, layered)).otherwise(_empty())

    return F.coalesce(F.flatten(F.transform(variants, one)), _empty())


def product_texts(dimensions: tuple[str, ...], labels: dict[str, tuple[str, ...]] = SPEC_DIMENSIONS) -> Column:
    """Every text of a product (name, flags) with each group of phrases it is matched against: array of structs (group, folded)."""
    entry = lambda group, text: F.struct(F.lit(group).alias("group"), F.coalesce(fold(text), F.lit("")).alias("folded"))
    none = F.array().cast("array<struct<group:string,folded:string>>")
    at = lambda key: F.col(f"flags.{key}")
    out = [F.array(entry("category", at("categories")), *[entry(f"free:{d}", c) for d in dimensions for c in (at("categories"), F.col("name"))])]

    def stated(dimension: str, keys: list[str]) -> Column:
        wanted = F.filter(F.map_entries(at("raw_specs")), lambda e: fold(e["key"]).isin(keys))
        return F.coalesce(F.transform(wanted, lambda e: entry(f"spec:{dimension}", e["value"])), none)

    out += [stated(d, keys) for d, keys in _label_keys(dimensions, labels).items()]
    if "shape" in dimensions:
        out.append(F.array(entry("spec-free:shape", at("description"))))
    if "material" in dimensions:
        out.append(F.array(entry("spec:material", at("material"))))
    if "color" in dimensions:
        words = F.flatten(F.transform(at("variants"), lambda v: F.concat(F.array(v["color"]), _layers(v))))
        out.append(F.coalesce(F.transform(F.filter(words, lambda x: x.isNotNull()), lambda x: entry("spec:color", x)), none))
    return F.concat(*out)


def first_per_key(tags: Column) -> Column:
    """The first tag of each (dimension, code, supplier code); an uncoded tag goes when its attribute has coded ones."""
    same = lambda a, b: (a["dimension"] == b["dimension"]) & (a["code"] == b["code"])
    kept = F.aggregate(tags, _empty(), lambda acc, t: F.when(
        F.exists(acc, lambda a: same(a, t) & a["supplier_code"].eqNullSafe(t["supplier_code"])), acc).otherwise(F.concat(acc, F.array(t))))

    return let(kept, lambda all_tags: F.filter(all_tags, lambda t: t["supplier_code"].isNotNull() | ~F.exists(
        all_tags, lambda o: same(o, t) & o["supplier_code"].isNotNull())))


def tag_products(products: DataFrame, dictionary: Dictionary, rules_version: int = 1,
                 labels: dict[str, tuple[str, ...]] = SPEC_DIMENSIONS, phrases: DataFrame | None = None) -> DataFrame:
    """product_tags rows of products (id, name, flags). The order of trust is specs, description, material, categories, name;
    variants add coded tags. Runs anew over all products after a rules change; `history.tag_changes` gives the difference.

    With `phrases` (group, phrase, code; see `phrases.phrase_table`) a dictionary of any size is joined, and each distinct text is matched once; without,
    the dictionary's phrases are a literal and products stay where they are."""
    dimensions = dictionary.dimensions
    match = literal_match(dictionary) if phrases is None else joined_match
    if phrases is not None:
        products = matched_texts(products, "id", product_texts(dimensions, labels), phrases)
    parts = [spec_tags(F.col("flags.raw_specs"), dimensions, match, labels), text_tags(F.col("name"), "flags", dimensions, match)]
    if "color" in dimensions:
        parts.append(variant_tags(F.col("flags.variants"), match))
    hexes = color_tiers(dictionary)
    color = F.col("t.dimension") == "color"
    return (products.select(F.col("id").alias("product_id"), F.explode(first_per_key(F.concat(*parts))).alias("t"))
            .select("product_id", "t.dimension", "t.code", "t.field", "t.term", F.lit(rules_version).alias("rules_version"),
                    F.when(color, F.col("t.code")).alias("color_family"), F.when(color, hexes[F.col("t.code")]).alias("color_hex"),
                    "t.supplier_code"))


def retagged(products: DataFrame, stored: DataFrame, dictionary: Dictionary, rules_version: int, source_id: int | None = None,
             labels: dict[str, tuple[str, ...]] = SPEC_DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(tag table, difference) after new rules over the products of one store, or of all: their tags are found anew, those of other products stay."""
    mine = products if source_id is None else products.where(F.col("source_id") == source_id)
    wanted = tag_products(mine, dictionary, rules_version, labels)
    own = mine.select(F.col("id").alias("product_id"))
    difference = tag_changes(stored.join(own, "product_id", "left_semi"), wanted)
    return wanted.unionByName(stored.join(own, "product_id", "left_anti").select(*wanted.columns)), difference
