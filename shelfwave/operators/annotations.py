"""From documents to mentions: dictionary detection, ingest of outside annotations, partial re-reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwave.functions.text import fold, fold_py, let, match_phrases, phrase_index
from shelfwave.operators.joins import bounded
from shelfwave.operators.phrases import find_phrases
from shelfwave.sources.dictionary import Dictionary

# The default topic words of the candidate filter.
TOPIC = (r"\b(lunettes?|montures?|solaires|opticien|optique|eyewear|eyeglass(es)?|glasses|sunglasses|spectacles|frames?)\b")
# Words that make a mention rising or declining when they stand near it; parameters of `detect_mentions`.
RISING_WORDS = ("rising", "trending", "trend", "return", "returns", "comeback", "new", "tendance", "revient", "retour", "nouveau", "nouvelle")
DECLINING_WORDS = ("fading", "out", "over", "goodbye", "decline", "dated", "adieu", "fini", "demode", "recul", "depasse")
STANCES = ("rising", "declining", "neutral")


def candidates(documents: DataFrame, pattern: str = TOPIC) -> DataFrame:
    """Documents whose title or text speaks about the topic; Unicode-aware word bounds, any case."""
    return documents.where(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).rlike(f"(?iU){pattern}"))


def document_day() -> Column:
    return F.to_date(F.coalesce("published_at", "collected_at"))


def evidence_around(padded: Column, needle: Column, words: int = 8) -> Column:
    """Up to `words` whole words on each side of the first occurrence, however long they are."""
    at = F.position(needle, padded)
    before, after = F.substring(padded, F.lit(1), at), F.substring(padded, at + F.length(needle) - 1, F.length(padded))
    left = F.filter(F.split(F.substring_index(before, " ", -(words + 2)), " "), lambda w: w != "")
    right = F.filter(F.split(F.substring_index(after, " ", words + 2), " "), lambda w: w != "")
    return F.concat_ws(" ", F.slice(left, F.greatest(F.size(left) - words + 1, F.lit(1)), F.lit(words)), F.trim(needle), F.slice(right, 1, words))


def _has_word(text: Column, words: tuple[str, ...]) -> Column:
    folded = sorted({fold_py(w) for w in words})
    return F.concat(F.lit(" "), text, F.lit(" ")).rlike(" (" + "|".join(folded) + ") ")


def detect_mentions(documents: DataFrame, dictionary: Dictionary, rising: tuple[str, ...] = RISING_WORDS,
                    declining: tuple[str, ...] = DECLINING_WORDS) -> DataFrame:
    """One mention per document and attribute found in its title and text: the longest phrases first, each consuming its span.
    The stance comes from words near the first occurrence. Whole texts, no shuffle."""
    text = fold(F.concat_ws("\n", "title", "text"))
    indexes = {d: phrase_index(dictionary.pairs(d, True)) for d in dictionary.dimensions}

    def hits(folded: Column, padded: Column, d: str) -> Column:
        return F.transform(match_phrases(folded, indexes[d]), lambda m: F.struct(
            F.lit(d).alias("dimension"), m["code"].alias("code"), m["phrase"].alias("term"), evidence_around(padded, m["needle"]).alias("evidence")))

    def found(folded: Column) -> Column:
        return F.concat(*[hits(folded, F.concat(F.lit(" "), folded, F.lit(" ")), d) for d in indexes])

    def first(hits: Column) -> Column:
        empty = F.filter(hits, lambda h: F.lit(False))
        return F.aggregate(hits, empty, lambda acc, h: F.when(
            F.exists(acc, lambda a: (a["dimension"] == h["dimension"]) & (a["code"] == h["code"])), acc).otherwise(F.concat(acc, F.array(h))))

    rows = documents.select(F.col("id").alias("document_id"), document_day().alias("occurred_on"),
                            F.explode(let(let(text, found), first)).alias("m"))
    up, down = _has_word(F.col("m.evidence"), rising), _has_word(F.col("m.evidence"), declining)
    stance = F.when(up & ~down, "rising").when(down & ~up, "declining").otherwise("neutral")
    return rows.select("document_id", "m.dimension", "m.code", stance.alias("stance"), "m.evidence", "occurred_on", "m.term")


def mentions_by_index(documents: DataFrame, phrases: DataFrame, rising: tuple[str, ...] = RISING_WORDS, declining: tuple[str, ...] = DECLINING_WORDS) -> DataFrame:
    """detect_mentions for a dictionary of any size: `phrases` (group, phrase, code) with a dimension as group is joined to the words of the texts."""
    folded = documents.select(F.col("id").alias("text_id"), fold(F.concat_ws("\n", "title", "text")).alias("folded"))
    found = find_phrases(folded, phrases, around=8)
    firsts = let(F.col("matches"), lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda m: m["code"])), lambda c: F.get(F.filter(all_, lambda m: m["code"] == c), F.lit(0))))
    rows = found.select(F.col("text_id").alias("document_id"), F.col("group").alias("dimension"), F.inline(firsts).alias("term", "code", "evidence", "at"))
    up, down = _has_word(F.col("evidence"), rising), _has_word(F.col("evidence"), declining)
    stance = F.when(up & ~down, "rising").when(down & ~up, "declining").otherwise("neutral")
    days = documents.select(F.col("id").alias("document_id"), document_day().alias("occurred_on"))
    # one row a document: an estimate from the files' size would broadcast the days of millions of them
    return rows.join(days.hint("merge"), "document_id").select("document_id", "dimension", "code", stance.alias("stance"), "evidence", "occurred_on", "term")


# --- annotations made outside ----------------------------------------------------------------------

def annotation_schema(dimensions: tuple[str, ...]) -> str:
    lists = ",".join(f"`{d}`:array<struct<code:string,stance:string,evidence:string>>" for d in dimensions)
    return f"struct<is_relevant:boolean,language:string,{lists},brands:array<string>,summary_fr:string>"


def parsed_annotations(annotations: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(document_id, payload JSON) -> the same with the parsed answer; a payload that is not JSON gives NULL."""
    return annotations.select("document_id", F.from_json("payload", annotation_schema(dimensions)).alias("a"))


def annotation_entries(parsed: DataFrame, codes: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Every entry of relevant answers in answer order, with `valid`: its code is in the dictionary (`codes`: dimension, code)
    and its stance is known."""
    entry = lambda d: F.transform(F.col(f"a.{d}"), lambda e, i: F.struct(F.lit(d).alias("dimension"), i.alias("pos"), e["code"].alias("code"),
                                                                        e["stance"].alias("stance"), e["evidence"].alias("evidence")))
    lists = F.flatten(F.array(*[F.coalesce(entry(d), F.array()) for d in dimensions]))
    rows = parsed.where("a.is_relevant").select("document_id", F.explode(lists).alias("e")).select("document_id", "e.*")
    known = codes.select("dimension", "code").distinct().withColumn("known", F.lit(True))
    return (rows.join(bounded(known), ["dimension", "code"], "left")
            .withColumn("valid", F.coalesce("known", F.lit(False)) & F.coalesce(F.col("stance").isin(*STANCES), F.lit(False))).drop("known"))


def annotation_mentions(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """One mention per document and attribute, the first valid entry, dated by its document."""
    first = (entries.where("valid").groupBy("document_id", "dimension", "code")
             .agg(F.min_by(F.struct("stance", "evidence"), "pos").alias("m")))
    days = documents.select(F.col("id").alias("document_id"), document_day().alias("occurred_on"))
    return first.join(days, "document_id").select("document_id", "dimension", "code", "m.stance", "m.evidence", "occurred_on")


def annotated_documents(parsed: DataFrame) -> DataFrame:
    """(document_id, status, brands, summary): failed when the payload could not be read, irrelevant or extracted else."""
    status = (F.when(F.col("a").isNull() | F.col("a.is_relevant").isNull(), "failed").when(F.col("a.is_relevant"), "extracted")
              .otherwise("irrelevant"))
    kept = F.col("a.is_relevant")
    return parsed.select("document_id", status.alias("status"), F.when(kept, F.array_sort(F.array_distinct("a.brands"))).alias("brands"),
                         F.when(kept, F.col("a.summary_fr")).alias("summary_fr"))


# --- selection and re-reading ----------------------------------------------------------------------

def pending_documents(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """All pending documents, or the `limit` oldest where a caller asks for a page."""
    rows = documents.where(F.col("status") == "pending")
    return rows if limit is None else rows.orderBy("collected_at", "id").limit(limit)


def reread_candidates(documents: DataFrame, dimension: str, current: str) -> DataFrame:
    """Extracted, non-demo documents whose mentions of the dimension predate the current prompt version, oldest first."""
    stale = F.col("prompt_version").isNull() | ((F.col("prompt_version") != current) & ~F.col("prompt_version").endswith(f"+{dimension}@{current}"))
    return documents.where((F.col("status") == "extracted") & ~F.col("is_demo") & stale).orderBy("collected_at", "id")


def reread_dimension(mentions: DataFrame, documents: DataFrame, answers: DataFrame, dimension: str, current: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, documents) after re-reading one dimension. `answers`: (document_id, relevant, items: array<struct<code, stance,
    evidence>>). Only that dimension's mentions of relevant answers are replaced; a not-relevant answer keeps the old ones.
    Every answered document is marked "<old version>+<dimension>@<current>"."""
    relevant = answers.where("relevant")
    gone = relevant.select("document_id").withColumn("dimension", F.lit(dimension))
    kept = mentions.join(gone, ["document_id", "dimension"], "left_anti")
    first = (relevant.select("document_id", F.posexplode("items").alias("pos", "e"))
             .groupBy("document_id", F.col("e.code").alias("code")).agg(F.min_by("e", "pos").alias("e")))
    days = documents.select(F.col("id").alias("document_id"), document_day().alias("occurred_on"))
    fresh = first.join(days, "document_id").select("document_id", F.lit(dimension).alias("dimension"), "code", F.col("e.stance").alias("stance"),
                                                   F.col("e.evidence").alias("evidence"), "occurred_on")
    answered = answers.select(F.col("document_id").alias("id")).distinct().withColumn("answered", F.lit(True))
    marker = F.concat(F.coalesce("prompt_version", F.lit("v?")), F.lit(f"+{dimension}@{current}"))
    marked = documents.join(answered, "id", "left").withColumn(
        "prompt_version", F.when(F.col("answered"), marker).otherwise(F.col("prompt_version"))).drop("answered")
    return kept.select("document_id", "dimension", "code", "stance", "evidence", "occurred_on").unionByName(fresh), marked


def status_tallies(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def reading_cost(documents: DataFrame, input_price: float = 2e-6, output_price: float = 1e-5, output_tokens: int = 500) -> DataFrame:
    """(documents, cost): four characters per input token plus a fixed number of output tokens per document."""
    n, chars = F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))
    return documents.agg(n.alias("documents"), (chars / 4 * F.lit(input_price) + n * F.lit(output_tokens * output_price)).alias("cost"))


def uncited_labels(mandatory: DataFrame, text: str) -> DataFrame:
    """The mandatory attributes' labels when the text names none of them (on the label or one of its "/" parts); else no row."""
    padded = F.lit(f" {fold_py(text)} ")
    parts = F.array_distinct(F.concat(F.array("label"), F.split("label", "/")))
    named = F.exists(parts, lambda p: (fold(p) != "") & padded.contains(F.concat(F.lit(" "), fold(p), F.lit(" "))))
    rows = mandatory.select("label", named.alias("named"))
    any_named = rows.select(F.coalesce(F.bool_or("named"), F.lit(False)).alias("n")).scalar()
    return rows.where(~any_named).select("label")
