"""The joined phrase index against the literal walk, which is the plain form of the rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwave.functions.text import match_phrases, phrase_index
from shelfwave.operators import annotations as A, tagging as G
from shelfwave.operators.phrases import find_phrases, phrase_table
from shelfwave.sources.dictionary import Dictionary, Item


def texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    words = ["a", "b", "c", "dd", "e1", "ff"]
    return [(k, r.choice([None, "", "zz"]) if r.random() < 0.1 else " ".join(r.choices(words, k=r.randrange(1, 14)))) for k in range(n)]


def pairs(seed: int, n: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    return sorted({(" ".join(r.choices(["a", "b", "c", "dd", "e1"], k=r.randrange(1, 5))), r.choice("XYZ")) for _ in range(n)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_takes_the_same_words_as_the_walk(spark, seed):
    rows, found = texts(seed, 150), pairs(seed, 25)
    frame = spark.createDataFrame(rows, "text_id long, folded string")
    walk = {x["text_id"]: [(m["phrase"], m["code"]) for m in x["m"]] for x in frame.select("text_id", match_phrases(F.col("folded"), phrase_index(found)).alias("m")).collect()}
    table = spark.createDataFrame([("g", p, c) for p, c in found] + [("g", "", "X"), ("other", "ff", "W")], "`group` string, phrase string, code string")
    got = {x["text_id"]: [(m["phrase"], m["code"]) for m in x["matches"]] for x in find_phrases(frame.withColumn("group", F.lit("g")), table).collect()}
    assert got == {k: v for k, v in walk.items() if v}
    every = {(x["text_id"], x["group"]) for x in find_phrases(frame, table).collect()}
    assert {k for k, g in every if g == "g"} == set(got)
    assert {k for k, g in every if g == "other"} == {k for k, t in rows if t and "ff" in t.split()}


def test_fifty_thousand_phrases_are_no_part_of_the_plan(spark, tmp_path):
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    many = sorted({(" ".join(r.choices(words, k=r.randrange(1, 4))), f"c{r.randrange(3000)}") for _ in range(52_000)})
    assert len(many) > 50_000
    rows = [(k, " ".join(r.choices(words, k=30))) for k in range(60)]
    path = str(tmp_path / "phrases")
    spark.createDataFrame([("g", p, c) for p, c in many], "`group` string, phrase string, code string").write.parquet(path)
    found = find_phrases(spark.createDataFrame(rows, "text_id long, folded string"), spark.read.parquet(path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert many[0][0] not in plan and many[-1][0] not in plan and len(plan) < 20_000
    got = {x["text_id"]: [(m["phrase"], m["code"]) for m in x["matches"]] for x in found.collect()}
    # the rule in plain Python
    by_size = sorted(many, key=lambda pc: (-len(pc[0].split()), -len(pc[0]), pc[0], pc[1]))
    for k, text in rows[:12]:
        padded, want = f" {text} ", []
        for p, c in by_size:
            if f" {p} " in padded:
                padded = padded.replace(f" {p} ", " | ")
                want.append((p, c))
        assert got.get(k, []) == want


GLASS = Dictionary({"color": "Couleur", "shape": "Forme", "material": "Matière"}, (
    Item("color", "red", "Rouge", ("crimson", "deep crimson"), hex="#c00000"), Item("color", "blue", "Bleu", ("navy",), hex="#0000c0"),
    Item("shape", "round", "Ronde", ("ring",)), Item("material", "horn", "Corne", ("buffalo horn",))), aliases={"color": (("ruby", "red"),)}, ambiguous=("ring",))


def products(spark):
    flags = ("struct<raw_specs:map<string,string>,description:string,material:string,categories:string,variants:array<struct<code:string,color:string,layers:array<string>>>>")
    rows = [(1, "Deep Crimson ring", ({"Couleur": "Ruby, navy", "Genre": "Homme"}, "a ring, ronde", "Buffalo horn", "Femme / Solaire", [(" K1 ", "Ruby", ["Navy", "Crimson"]), (None, "navy", None)])),
            (2, "Crimson", None), (3, None, ({}, None, None, None, [("K2", None, ["Navy", "Zebra", None])])), (4, "navy", ({"Matière": "corne"}, "ronde", None, "vue", None))]
    return spark.createDataFrame(rows, f"id long, name string, flags {flags}")


def test_joined_and_literal_dictionary_give_equal_tags(spark):
    literal = G.tag_products(products(spark), GLASS)
    joined = G.tag_products(products(spark), GLASS, phrases=phrase_table(spark, GLASS))
    assert literal.columns == joined.columns
    got = sorted(map(tuple, joined.collect()), key=str)
    assert got == sorted(map(tuple, literal.collect()), key=str) and len(got) > 12


def test_joined_and_literal_mentions_are_equal(spark):
    rows = [(1, "Deep crimson returns", "and so does navy blue. " + "filler " * 30 + "crimson fading crimson crimson"), (2, None, "Ronde, ronde navy out"), (3, "ring", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "id long, title string, text string").withColumns({"published_at": F.lit(None).cast("timestamp"), "collected_at": F.lit("2024-01-02").cast("timestamp")})
    table = phrase_table(spark, GLASS).where(F.col("group").startswith("free:")).withColumn("group", F.substring_index("group", ":", -1))
    got = sorted(map(tuple, A.mentions_by_index(docs, table).collect()), key=str)
    assert got == sorted(map(tuple, A.detect_mentions(docs, GLASS).collect()), key=str) and len(got) == 4
