"""Phrase matching for dictionaries of any size: an inverted index over the phrases, joined to the words of the texts.

The index leads from the first word of a phrase to the lengths of the phrases that begin with it; runs of words of those lengths meet the phrases by
equality. Nothing of the dictionary is part of the plan, and a text carries only its own hits from there on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwave.functions.text import fold_py, let
from shelfwave.operators.joins import MAX_BROADCAST_BYTES
from shelfwave.sources.dictionary import CATEGORY_WORDS, Dictionary

MATCH = "array<struct<phrase:string,code:string,around:string,at:int>>"


def phrase_table(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """(group, phrase, code) of a dictionary: `free:<dimension>` for free text (no ambiguous phrases), `spec:<dimension>` for spec values (store aliases
    included), `spec-free:<dimension>` for aliases in free text, `category` for category words."""
    rows = [(f"{kind}:{d}", p, c) for d in dictionary.dimensions for kind, pairs in (
        ("free", dictionary.pairs(d, True)), ("spec", dictionary.spec_pairs(d)), ("spec-free", dictionary.spec_pairs(d, True))) for p, c in pairs]
    for (d, code), words in CATEGORY_WORDS.items():
        rows += [("category", fold_py(w), f"{d}/{code}") for w in words]
        rows += [("spec:audience", fold_py(w), code) for w in words if d == "audience"]
    return spark.createDataFrame(rows, "`group` string, phrase string, code string")


def phrase_hits(texts: DataFrame, phrases: DataFrame, around: int = 0) -> DataFrame:
    """(text_id, group, phrase, code, n, at, around): every place of every phrase in texts (text_id, folded, and `group` where a text is only to meet
    the phrases of one). `around` is the phrase with up to that many words on each side.

    The phrases are measured, not estimated: up to MAX_BROADCAST_BYTES of them go to the texts, and windows are cut for places that begin a phrase alone.
    Beyond that every place carries its window to the phrases; the texts themselves are never broadcast."""
    by = ["group"] if "group" in texts.columns else []
    table = phrases.where("phrase <> ''").select("group", "phrase", "code").distinct().withColumn("n", F.size(F.split("phrase", " ")))
    size = F.length("phrase") * 2 + F.coalesce(F.length("code"), F.lit(0)) + F.coalesce(F.length("group"), F.lit(0)) + 64
    longest, held = table.agg(F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()  # two numbers
    head = lambda c: F.substring_index(c, " ", 1)
    index = table.select(*by, head("phrase").alias("head"), "n").groupBy(*by, "head").agg(F.collect_set("n").alias("sizes"))
    none = F.lit(None).cast("string")
    if held <= MAX_BROADCAST_BYTES:
        # outer, so that no filter on the words is inferred below, which would fold and split every text twice
        words = texts.select("text_id", *by, F.split("folded", " ").alias("words"))
        starts = words.select("text_id", *by, "words", F.posexplode_outer("words").alias("at", "head"))
        runs = (starts.join(F.broadcast(index), [*by, "head"]).select("text_id", *by, "at", "words", F.explode("sizes").alias("n"))
                .where(F.size("words") >= F.col("at") + F.col("n")).withColumn("phrase", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ")))
        first = F.greatest(F.col("at") - around, F.lit(0))
        beside = F.array_join(F.slice("words", first + 1, F.col("at") - first + F.col("n") + around), " ") if around else none
        return runs.join(F.broadcast(table), [*by, "phrase", "n"]).select("text_id", "group", "phrase", "code", "n", "at", beside.alias("around"))

    def place(words: Column, i: Column) -> Column:
        first = F.greatest(i - around, F.lit(0))
        return F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, F.lit(longest)), " ").alias("tail"),
                        (F.array_join(F.slice(words, first + 1, i - first), " ") if around else F.lit("")).alias("left"),
                        (F.array_join(F.slice(words, i + 1, F.lit(longest + around)), " ") if around else F.lit("")).alias("right"))

    places = let(F.split("folded", " "), lambda words: F.transform(words, lambda _, i: place(words, i)))
    starts = texts.where("folded <> ''").select("text_id", *by, F.explode(places).alias("p")).select("text_id", *by, "p.*").withColumn("head", head("tail"))
    runs = (starts.hint("merge").join(index, [*by, "head"]).select("text_id", *by, "at", "tail", "left", "right", F.explode("sizes").alias("n"))
            .where(F.size(F.split("tail", " ")) >= F.col("n")).withColumn("phrase", F.expr("substring_index(tail, ' ', n)")))
    beside = F.concat_ws(" ", F.when(F.col("left") != "", F.col("left")), F.expr(f"substring_index(right, ' ', n + {around})")) if around else none
    return runs.hint("merge").join(table, [*by, "phrase", "n"]).select("text_id", "group", "phrase", "code", "n", "at", beside.alias("around"))


def consumed(hits: DataFrame) -> DataFrame:
    """(text_id, group, matches) of phrase_hits: most words first, then most characters, then by phrase and code, each match taking its words.

    A phrase takes all its places that are free, from the left; two of its places that touch share the blank between them, so the second is left. Only a
    text's own hits are walked, with one character a word for what is taken."""
    order = F.struct((-F.col("n")).alias("words"), (-F.length("phrase")).alias("size"), "phrase", "code", "at", "n", "around")
    rows = hits.groupBy("text_id", "group").agg(F.sort_array(F.collect_list(order)).alias("hits"), F.max(F.col("at") + F.col("n")).alias("size"))
    start = F.struct(F.repeat(F.lit("."), F.col("size")).alias("free"), F.array().cast(MATCH).alias("found"), F.lit("").alias("phrase"), F.lit("").alias("code"),
                     F.lit(-1).alias("until"), F.lit(None).cast("string").alias("around"))

    def step(s: Column, h: Column) -> Column:
        phrase = s["phrase"] == h["phrase"]
        same = phrase & (s["code"] == h["code"])
        around = F.when(phrase, s["around"]).otherwise(h["around"])  # of the phrase's first place, taken or not
        fits = (F.substring(s["free"], h["at"] + 1, h["n"]) == F.repeat(F.lit("."), h["n"])) & ~(same & (s["until"] == h["at"]))
        new = fits & ~(same & (s["until"] >= 0))
        match = F.struct(h["phrase"].alias("phrase"), h["code"].alias("code"), around.alias("around"), h["at"].alias("at"))
        return F.struct(F.when(fits, F.overlay(s["free"], F.repeat(F.lit("x"), h["n"]), h["at"] + 1, h["n"])).otherwise(s["free"]).alias("free"),
                        F.when(new, F.concat(s["found"], F.array(match))).otherwise(s["found"]).alias("found"), h["phrase"].alias("phrase"), h["code"].alias("code"),
                        F.when(fits, h["at"] + h["n"]).when(same, s["until"]).otherwise(F.lit(-1)).alias("until"), around.alias("around"))

    return rows.select("text_id", "group", F.aggregate("hits", start, step, lambda s: s["found"]).alias("matches"))


def find_phrases(texts: DataFrame, phrases: DataFrame, around: int = 0) -> DataFrame:
    """(text_id, group, matches): whole-word phrases of folded texts in index order, each match consuming its span. A text without any has no row,
    and the first hit of a text is always a match."""
    return consumed(phrase_hits(texts, phrases, around))


def matched_texts(rows: DataFrame, key: str, texts: Column, phrases: DataFrame) -> DataFrame:
    """rows with `_matches`: a map from "group<tab>folded text" to the matches, of their `texts` (array of structs group, folded). Equal texts of any
    number of rows are matched once."""
    wanted = rows.select(F.col(key).alias("_key"), F.explode(F.array_distinct(texts)).alias("t")).select("_key", "t.*").where("folded <> ''")
    name = F.concat("group", F.lit("\t"), "folded")
    found = find_phrases(wanted.select(name.alias("text_id"), "group", "folded").distinct(), phrases)
    entries = wanted.select("_key", name.alias("text_id")).join(found.select("text_id", "matches"), "text_id")
    maps = entries.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("text_id", "matches"))).alias("_matches"))
    return rows.join(maps, F.col(key) == F.col("_key"), "left").drop("_key")
