"""Folding, whole-word phrase matching and small text clean-ups, all inside the JVM."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Letters and signs whose folded form is more than one character.
EXPANSIONS = (
    ("œ", "oe"), ("æ", "ae"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("ĳ", "ij"), ("ǆ", "dz"), ("ǉ", "lj"), ("ǌ", "nj"), ("ǳ", "dz"), ("ŀ", "l "), ("ŉ", " n"), ("½", "1 2"), ("¼", "1 4"), ("¾", "3 4"), ("™", "tm"), ("№", "no"),
)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """(from, to) for `translate`: every lower-case BMP character whose compatibility decomposition, without combining
    marks, is one ASCII letter or digit; combining marks come last, without a counterpart, so they are deleted."""
    source, target, marks = [], [], []
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            source.append(char)
            target.append(plain)
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower case, no accents, every run of other characters one space, trimmed."""
    out = F.lower(text)
    for long_form, short_form in EXPANSIONS:
        out = F.replace(out, F.lit(long_form), F.lit(short_form))
    out = F.lower(F.translate(out, *_fold_table()))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def fold_py(text: str) -> str:
    """`fold` for the few driver-side strings (dictionary phrases, parameter keys)."""
    lowered = text.lower()
    for long_form, short_form in EXPANSIONS:
        lowered = lowered.replace(long_form, short_form)
    plain = "".join(c for c in unicodedata.normalize("NFKD", lowered) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def collapse(text: Column) -> Column:
    """Every run of white space (no-break spaces included) one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}\x{202f}\x{2007}\x{2009}]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def supplier_code(raw: Column, limit: int = 60) -> Column:
    """A supplier's own colour code as stored: white space collapsed, case kept, at most `limit` characters."""
    return blank_to_null(F.trim(F.substring(collapse(raw), 1, limit)))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


INDEX_TYPE = "array<struct<needle:string,phrase:string,code:string>>"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, also when `body` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase_index(pairs) -> Column:
    """A literal index from (phrase, code) pairs: most words first, then most characters, then by phrase and code. Built
    from one JSON literal, which the optimizer folds, so a dictionary costs one expression."""
    ordered = sorted({(p, c) for p, c in pairs if p}, key=lambda pc: (-len(pc[0].split()), -len(pc[0]), pc[0], pc[1]))
    rows = [{"needle": f" {p} ", "phrase": p, "code": c} for p, c in ordered]
    return F.from_json(F.lit(json.dumps(rows)), INDEX_TYPE)


def match_phrases(folded: Column, index: Column) -> Column:
    """Whole-word phrases found in folded text, in index order, each match consuming its span.

    Result: array<struct<needle, phrase, code>>. Phrases that do not occur at all are pruned first, so the ordered pass only
    walks candidates. Whole texts are matched; nothing is cut."""
    padded = F.concat(F.lit(" "), F.coalesce(folded, F.lit("")), F.lit(" "))

    def take(state: Column, entry: Column) -> Column:
        hit = state["text"].contains(entry["needle"])
        return F.struct(
            F.when(hit, F.replace(state["text"], entry["needle"], F.lit(" | "))).otherwise(state["text"]).alias("text"),
            F.when(hit, F.concat(state["found"], F.array(entry))).otherwise(state["found"]).alias("found"))

    def run(text: Column) -> Column:
        start = F.struct(text.alias("text"), F.array().cast(INDEX_TYPE).alias("found"))
        return F.aggregate(F.filter(index, lambda e: text.contains(e["needle"])), start, take, lambda state: state["found"])

    return let(padded, run)


def label_join(labels: Column) -> Column:
    """Labels in order, without repeats, joined by ", "; NULL when there is none."""
    return blank_to_null(F.array_join(F.array_distinct(labels), ", "))
