"""The attribute dictionary: dimensions, codes, labels, bilingual phrases and colours.

The dictionary is an input (a YAML or JSON file, or plain Python data), small by nature and read on the driver; a wrong colour
fails the load. Its phrases become literal indexes for the matcher and small tables for joins."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from shelfwave.functions.text import fold_py

HEX = re.compile(r"^#[0-9a-f]{6}$")
# Phrases ignored in free text because they are also common words; they count inside a scoped spec value.
AMBIGUOUS = ("or", "bold", "wrap", "wire", "xl", "sport", "rose", "marine", "orange", "olive", "sage", "honey", "lemon", "wine",
             "cherry", "plum", "slate")
# Category words and the tag they give.
CATEGORY_WORDS: dict[tuple[str, str], tuple[str, ...]] = {
    ("audience", "men"): ("homme", "hommes", "man", "men", "masculine", "masculin"),
    ("audience", "women"): ("femme", "femmes", "woman", "women", "feminine", "feminin"),
    ("audience", "unisex"): ("mixte", "unisex", "unisexe"),
    ("product_type", "optical"): ("optique", "lunettes de vue", "vue", "eyeglasses", "optical"),
    ("product_type", "sun"): ("solaire", "solaires", "lunettes de soleil", "soleil", "sunglasses", "sun"),
}


@dataclass(frozen=True)
class Item:
    dimension: str
    code: str
    label: str
    phrases: tuple[str, ...] = ()
    query: dict[str, str] = field(default_factory=dict)
    hex: str | None = None
    multicolor: bool = False


@dataclass(frozen=True)
class Dictionary:
    labels: dict[str, str]
    items: tuple[Item, ...]
    aliases: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)  # spec values only: (phrase, code)
    ambiguous: tuple[str, ...] = AMBIGUOUS

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(self.labels)

    def of(self, dimension: str) -> list[Item]:
        return [i for i in self.items if i.dimension == dimension]

    def codes(self, dimension: str) -> list[str]:
        return [i.code for i in self.of(dimension)]

    def pairs(self, dimension: str, free_text: bool = False) -> list[tuple[str, str]]:
        """(folded phrase, code) of one dimension; in free text the ambiguous phrases are left out."""
        found = {(fold_py(p), i.code) for i in self.of(dimension) for p in (*i.phrases, i.label, i.code)}
        return sorted((p, c) for p, c in found if p and not (free_text and p in self.ambiguous))

    def spec_pairs(self, dimension: str, free_text: bool = False) -> list[tuple[str, str]]:
        extra = {(fold_py(p), c) for p, c in self.aliases.get(dimension, ())}
        return sorted(p for p in {*self.pairs(dimension), *extra} if not (free_text and p[0] in self.ambiguous))


def from_mapping(raw: dict, aliases: dict[str, Iterable[tuple[str, str]]] | None = None) -> Dictionary:
    """{"dimensions": {name: {label_fr, items: {code: {fr, synonyms_fr, synonyms_en, query, hex, multicolor}}}}} -> Dictionary."""
    labels, items = {}, []
    for dimension, spec in raw["dimensions"].items():
        labels[dimension] = spec["label_fr"]
        for code, v in spec["items"].items():
            items.append(Item(dimension, str(code), v["fr"], tuple(map(str, (*v.get("synonyms_fr", ()), *v.get("synonyms_en", ())))),
                              dict(v.get("query", {})), v.get("hex"), bool(v.get("multicolor", False))))
    wrong = [i.code for i in items if i.dimension == "color" and not (i.hex and HEX.match(i.hex))]
    if wrong:
        raise ValueError(f"colours without a #rrggbb value: {', '.join(wrong)}")
    return Dictionary(labels, tuple(items), {d: tuple(p) for d, p in (aliases or {}).items()})


def load_dictionary(path: str | Path, aliases: dict[str, Iterable[tuple[str, str]]] | None = None) -> Dictionary:
    """A dictionary file, JSON or (where PyYAML is installed) YAML."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return from_mapping(json.loads(text), aliases)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading a YAML dictionary needs PyYAML; use JSON instead") from error
    return from_mapping(yaml.safe_load(text), aliases)


def read_dictionary(spark: SparkSession, path: str, aliases: dict[str, Iterable[tuple[str, str]]] | None = None) -> Dictionary:
    """A JSON dictionary in any store that Spark reads; it is small by nature and read on the driver."""
    return from_mapping(json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())), aliases)


def dictionary_rows(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """(dimension, code, label, hex, multicolor, ord): the public form, joined to results for their labels."""
    rows = [(i.dimension, i.code, i.label, i.hex, i.multicolor, n) for n, i in enumerate(dictionary.items)]
    return spark.createDataFrame(rows, "dimension string, code string, label string, hex string, multicolor boolean, ord int")


def phrase_rows(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """(phrase, dimension, code, ord) with folded phrases, in dictionary order."""
    rows = [(fold_py(p), i.dimension, i.code, n) for n, i in enumerate(dictionary.items) for p in dict.fromkeys((i.code, i.label, *i.phrases))]
    return spark.createDataFrame(rows, "phrase string, dimension string, code string, ord int")


def keyword_rows(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """(dimension, code, lang, keyword): the search keyword of each attribute in each language."""
    rows = [(i.dimension, i.code, lang, q) for i in dictionary.items for lang, q in i.query.items()]
    return spark.createDataFrame(rows, "dimension string, code string, lang string, keyword string")
