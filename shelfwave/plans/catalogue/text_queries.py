"""Folding, dictionary matching, tagging, document mentions and annotation ingest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from shelfwave.functions import text as X
from shelfwave.functions import urls as U
from shelfwave.operators import annotations as A, tagging as G
from shelfwave.operators.phrases import phrase_table
from shelfwave.plans.oracle_views import with_views
from shelfwave.plans.registry import query
from shelfwave.sources import samples as S
from shelfwave.session import shared_folder
from shelfwave.sources.dictionary import Dictionary, Item, dictionary_rows, phrase_rows, read_dictionary

FOLD = "trim(regexp_replace(strip_accents(replace(replace(lower({0}), 'œ', 'oe'), 'æ', 'ae')), '[^a-z0-9]+', ' ', 'g'))"
# A small dictionary over the sample vocabulary, with two-word phrases so that the longest match matters.
PARTS = Dictionary(
    {"color": "Couleur", "material": "Matière", "shape": "Forme"},
    (Item("color", "red", "Rouge", ("red",), hex="#c03030"), Item("color", "blue", "Bleu", ("blue", "cold blue"), hex="#3050c0"),
     Item("color", "warm", "Chaud", ("hot", "hot plate"), hex="#e08020"), Item("color", "grey", "Gris / Fer", ("old", "old rod"), hex="#808080"),
     Item("material", "metal", "Métal", ("plate", "bolt", "gear")), Item("material", "wood", "Bois", ("rod",)),
     Item("shape", "round", "Ronde", ("ring", "small ring")), Item("shape", "large", "Grande", ("large", "large widget"))),
    aliases={"material": (("brand 7", "metal"), ("brand 1", "wood")), "color": (("brand 9", "blue"),)})
# Frequent words of the document corpus in its four languages.
WORDS = Dictionary(
    {"english": "Anglais", "latin": "Latin", "german": "Allemand"},
    (Item("english", "the", "the", ("the", "of the")), Item("english", "with", "with", ("with by", "with")), Item("english", "was", "was", ("was",)),
     Item("latin", "de", "de", ("de la", "de")), Item("latin", "pour", "pour", ("pour",)), Item("latin", "elle", "elle", ("elle est", "elle")),
     Item("german", "der", "der", ("der", "und der")), Item("german", "nicht", "nicht", ("nicht",))), ambiguous=("was",))


def steps(column: str, pairs: list[tuple[str, str]], tag: str, source: str) -> str:
    """SQL of the consuming match: one replace per phrase, longest first, then one row per hit."""
    ordered = sorted(set(pairs), key=lambda pc: (-len(pc[0].split()), -len(pc[0]), pc[0], pc[1]))
    select, rows = [f"' ' || coalesce({column}, '') || ' ' AS t0"], []
    for n, (phrase, code) in enumerate(ordered):
        select.append(f"contains(t{n}, ' {phrase} ') AS h{n}, replace(t{n}, ' {phrase} ', ' | ') AS t{n + 1}")
        rows.append(f"CASE WHEN h{n} THEN {{'code': '{code}', 'phrase': '{phrase}', 'n': {n}}} END")
    return (f"{tag}_s AS (SELECT *, {', '.join(select)} FROM {source}),\n"
            f"{tag} AS (SELECT * EXCLUDE (hit), hit.code AS code, hit.phrase AS phrase, hit.n AS n FROM "
            f"(SELECT * EXCLUDE ({', '.join(f't{k}, h{k}' for k in range(len(ordered)))}, t{len(ordered)}), "
            f"unnest(list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)) AS hit FROM {tag}_s))")


@query("folded_documents", f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def folded_documents(spark, sf):
    return S.load(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"))


@query("normalized_terms", """
WITH w AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS term FROM part)
SELECT term, CASE term WHEN 'RED' THEN 'color' WHEN 'BLUE' THEN 'color' WHEN 'HOT' THEN 'color' WHEN 'OLD' THEN 'color' WHEN 'PLATE' THEN 'material' WHEN 'BOLT' THEN 'material'
  WHEN 'GEAR' THEN 'material' WHEN 'ROD' THEN 'material' WHEN 'RING' THEN 'shape' WHEN 'LARGE' THEN 'shape' END AS dimension,
  CASE term WHEN 'RED' THEN 'red' WHEN 'BLUE' THEN 'blue' WHEN 'HOT' THEN 'warm' WHEN 'OLD' THEN 'grey' WHEN 'PLATE' THEN 'metal' WHEN 'BOLT' THEN 'metal'
  WHEN 'GEAR' THEN 'metal' WHEN 'ROD' THEN 'wood' WHEN 'RING' THEN 'round' WHEN 'LARGE' THEN 'large' END AS code FROM w""")
def normalized_terms(spark, sf):
    terms = S.load(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.upper("w").alias("term")).distinct()
    return G.normalize_terms(terms, phrase_rows(spark, PARTS))


def tag_sql() -> str:
    name = {d: PARTS.pairs(d, True) for d in PARTS.dimensions}
    parts = [steps("lower(p_name)", name[d], f"m_{d}", "part") for d in PARTS.dimensions]
    brand = "lower(replace(p_brand, '#', ' '))"
    parts += [steps(brand, PARTS.spec_pairs("color"), "s_color", "(SELECT * FROM part WHERE p_size % 2 = 0)"),
              steps(brand, PARTS.spec_pairs("material"), "s_material", "(SELECT * FROM part WHERE p_size % 3 = 0)")]
    parts += [steps("lower(p_name)", PARTS.spec_pairs("shape", True), "d_shape", "(SELECT * FROM part WHERE p_partkey % 5 = 0)"),
              steps("lower(p_name || ' ' || replace(p_brand, '#', ' '))", PARTS.spec_pairs("material"), "t_material", "(SELECT * FROM part WHERE p_size % 7 = 0)")]
    unions = [f"SELECT p_partkey AS product_id, '{d}' AS dimension, code, 'spec:{k}' AS field, phrase, 0 AS o, n FROM s_{d}"
              for d, k in (("color", "Couleur"), ("material", "Matière"))]
    unions += ["SELECT p_partkey, 'shape', code, 'description', phrase, 1, n FROM d_shape", "SELECT p_partkey, 'material', code, 'material', phrase, 2, n FROM t_material"]
    unions.append("SELECT p_partkey, 'product_type', CASE WHEN p_partkey % 2 = 0 THEN 'optical' ELSE 'sun' END, 'categories', "
                  "CASE WHEN p_partkey % 2 = 0 THEN 'optique' ELSE 'soleil' END, 3, 0 FROM part")
    unions += [f"SELECT p_partkey, '{d}', code, 'name', phrase, 5, n FROM m_{d}" for d in PARTS.dimensions]
    return "WITH " + ",\n".join(parts) + "\nSELECT product_id, dimension, code, arg_min(field, o * 100 + n) AS field, arg_min(phrase, o * 100 + n) AS term FROM (" + \
        " UNION ALL ".join(unions) + ") GROUP BY 1, 2, 3"


def tagged_parts(spark, sf):
    specs = F.map_filter(F.create_map(F.lit("Couleur"), F.when(F.pmod("p_size", F.lit(2)) == 0, F.col("p_brand")),
                                      F.lit("Matière"), F.when(F.pmod("p_size", F.lit(3)) == 0, F.col("p_brand"))), lambda k, v: v.isNotNull())
    return S.spread(S.load(spark, sf, "part")).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.struct(
            specs.alias("raw_specs"), F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.col("p_name")).alias("description"),
            F.when(F.pmod("p_size", F.lit(7)) == 0, F.concat_ws(" / ", "p_name", "p_brand")).alias("material"),
            F.when(F.pmod("p_partkey", F.lit(2)) == 0, "Optique").otherwise("Soleil").alias("categories"),
            F.array(F.struct(F.concat(F.lit(" C"), F.col("p_size"), F.lit(" ")).alias("code"), F.col("p_brand").alias("color"),
                             F.array(F.get(F.split("p_name", " "), F.lit(0)), F.lit("Blue"), F.when(F.pmod("p_size", F.lit(5)) == 0, "zebra")).alias("layers"))).alias("variants")).alias("flags"))


# Variants of the sample: the brand as colour, layers of the first word of the part name, "Blue" and sometimes an unknown one.
VARIANT_SQL = """v AS (SELECT p_partkey AS product_id, 'C' || p_size AS sc, p_size % 5 = 0 AS zebra, p_brand = 'Brand#9' AS nine, split_part(p_name, ' ', 1) AS w,
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red' WHEN 'blue' THEN 'blue' WHEN 'hot' THEN 'warm' WHEN 'old' THEN 'grey' END AS f FROM part),
vt AS (SELECT product_id, 'color' AS dimension, 'blue' AS code, 'variant' AS field, 'brand 9' AS term, sc, 700 AS o FROM v WHERE nine
  UNION ALL SELECT product_id, 'color', f, 'variant-layer', w, sc, 800 FROM v WHERE f IS NOT NULL
  UNION ALL SELECT product_id, 'color', 'blue', 'variant-layer', 'blue', sc, 801 FROM v
  UNION ALL SELECT product_id, 'color', 'two_tone', 'variant-layers', w || ' blue' || CASE WHEN zebra THEN ' zebra' ELSE '' END, sc, 900 FROM v WHERE NOT coalesce(f = 'blue' AND NOT zebra, false)
  UNION ALL SELECT product_id, 'lamination', least(f, 'blue') || '+' || greatest(f, 'blue'), 'variant-layers', w || ' blue', sc, 901 FROM v WHERE f <> 'blue' AND NOT zebra)"""
TAGS_SQL = f"""WITH base AS ({tag_sql()}), {VARIANT_SQL},
every AS (SELECT product_id, dimension, code, field, term, NULL AS supplier_code FROM base
  UNION ALL SELECT product_id, dimension, code, arg_min(field, o), arg_min(term, o), sc FROM vt GROUP BY product_id, dimension, code, sc)
SELECT e.*, CASE WHEN dimension = 'color' THEN code END AS color_family,
  CASE WHEN dimension = 'color' THEN CASE code WHEN 'red' THEN '#c03030' WHEN 'blue' THEN '#3050c0' WHEN 'warm' THEN '#e08020' WHEN 'grey' THEN '#808080' END END AS color_hex
FROM every e WHERE supplier_code IS NOT NULL OR (product_id, dimension, code) NOT IN (SELECT (product_id, dimension, code) FROM vt)"""


@query("product_tags_by_rules", TAGS_SQL)
def product_tags_by_rules(spark, sf):
    """All tags of all products, with their sources; the dictionary is a literal of the plan."""
    return G.tag_products(tagged_parts(spark, sf), PARTS).drop("rules_version")


@query("product_tags_by_index", TAGS_SQL)
def product_tags_by_index(spark, sf):
    """The same with the dictionary as a joined table."""
    return G.tag_products(tagged_parts(spark, sf), PARTS, phrases=phrase_table(spark, PARTS)).drop("rules_version")


# The rules before the last change: no round shape yet.
BEFORE = Dictionary(PARTS.dimensions, tuple(i for i in PARTS.items if i.code != "round"), aliases=PARTS.aliases)


def retag_inputs(spark, sf):
    rows = tagged_parts(spark, sf).withColumn("source_id", F.pmod("id", F.lit(4))).withColumn("flags", F.col("flags").withField("variants", F.lit(None).cast(
        "array<struct<code:string,color:string,layers:array<string>>>")))
    return rows, G.tag_products(rows, BEFORE)


@query("retagged_products", f"""SELECT product_id, dimension, code FROM ({tag_sql()}) WHERE code <> 'round' OR product_id % 4 = 2""")
def retagged_products(spark, sf):
    rows, stored = retag_inputs(spark, sf)
    return G.retagged(rows, stored, PARTS, 1, 2)[0].select("product_id", "dimension", "code")


@query("retag_difference", f"""SELECT product_id, dimension, code, CASE WHEN code = 'round' THEN 'added' ELSE 'changed' END AS change FROM ({tag_sql()})""")
def retag_difference(spark, sf):
    rows, stored = retag_inputs(spark, sf)
    return G.retagged(rows, stored, PARTS, 2)[1].select("product_id", "dimension", "code", "change")


@query("variant_tags_by_rules", f"SELECT product_id, supplier_code, dimension, code FROM ({TAGS_SQL}) WHERE supplier_code IS NOT NULL")
def variant_tags_by_rules(spark, sf):
    """The coded tags alone."""
    return G.tag_products(tagged_parts(spark, sf), PARTS).where(F.col("supplier_code").isNotNull()).select("product_id", "supplier_code", "dimension", "code")


@query("color_tiers", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS code, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN '#c03030' WHEN 'blue' THEN '#3050c0' END AS hex,
  nullif(trim(substr(trim(regexp_replace(p_brand || '  ' || p_type || ' ' || repeat('x', p_size * 2), '\\s+', ' ', 'g')), 1, 60)), '') AS supplier_code FROM part""")
def color_tiers(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit("  "), F.col("p_type"), F.lit(" "), F.repeat(F.lit("x"), F.col("p_size").cast("int") * 2))
    code = F.get(F.split("p_name", " "), F.lit(0))
    return S.load(spark, sf, "part").select("p_partkey", code.alias("code"), G.color_tiers(PARTS)[code].alias("hex"), X.supplier_code(raw).alias("supplier_code"))


def free_phrases(spark, dictionary):
    """The free-text phrases of a dictionary as a table, by dimension."""
    rows = phrase_table(spark, dictionary).where(F.col("group").startswith("free:"))
    return rows.withColumn("group", F.substring_index("group", ":", -1))


MENTIONS_SQL = ("WITH f AS (SELECT doc_id, " + FOLD.format("text") + " AS x FROM documents),\n" + ",\n".join(
    steps("x", WORDS.pairs(d, True), f"m_{d}", "f") for d in WORDS.dimensions) + "\n" + " UNION ALL ".join(
    f"SELECT doc_id AS document_id, '{d}' AS dimension, code, arg_min(phrase, n) AS term FROM m_{d} GROUP BY 1, 2, 3" for d in WORDS.dimensions))


def word_documents(spark, sf):
    return S.spread(S.load(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), "text",
                                                 F.lit(None).cast("timestamp").alias("published_at"), F.lit("2024-01-02").cast("timestamp").alias("collected_at"))


@query("document_mentions", MENTIONS_SQL)
def document_mentions(spark, sf):
    return A.detect_mentions(word_documents(spark, sf), WORDS).select("document_id", "dimension", "code", "term")


@query("document_mentions_by_index", MENTIONS_SQL)
def document_mentions_by_index(spark, sf):
    """The same with the dictionary as a joined table."""
    return A.mentions_by_index(word_documents(spark, sf), free_phrases(spark, WORDS)).select("document_id", "dimension", "code", "term")


NEAR = Dictionary({"color": "Couleur"}, (Item("color", "red", "Rouge", ("red",), hex="#c03030"), Item("color", "blue", "Bleu", ("blue",), hex="#3050c0")))


STANCES_SQL = """
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS c, p_partkey % 12 AS n, p_size % 12 AS m, ' ' || repeat('y', 70) AS f FROM part)
SELECT p_partkey AS document_id, 'color' AS dimension, c AS code, CASE WHEN n <= 7 AND m > 7 THEN 'rising' WHEN n > 7 AND m <= 7 THEN 'declining' ELSE 'neutral' END AS stance,
  trim(CASE WHEN n <= 7 THEN 'rising' ELSE '' END || repeat(f, least(n, 8)) || ' ' || c || repeat(f, least(m, 8)) || CASE WHEN m <= 7 THEN ' fading' ELSE '' END) AS evidence,
  '2024-01-02' AS occurred_on, c AS term FROM p WHERE c IN ('red', 'blue')"""


@query("mention_stances", STANCES_SQL)
def mention_stances(spark, sf):
    return near_mentions(spark, sf, lambda docs: A.detect_mentions(docs, NEAR))


@query("mention_stances_by_index", STANCES_SQL)
def mention_stances_by_index(spark, sf):
    return near_mentions(spark, sf, lambda docs: A.mentions_by_index(docs, free_phrases(spark, NEAR)))


def near_mentions(spark, sf, detect):
    """One text per part: a stance word, long words, the colour, long words, the other stance word."""
    filler = lambda n: F.repeat(F.lit(" " + "y" * 70), n.cast("int"))
    text = F.concat(F.lit("Rising"), filler(F.pmod("p_partkey", F.lit(12))), F.lit(" "), F.get(F.split("p_name", " "), F.lit(0)), filler(F.pmod("p_size", F.lit(12))), F.lit(" fading."))
    docs = S.spread(S.load(spark, sf, "part")).select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("title"), text.alias("text"),
                                            F.lit(None).cast("timestamp").alias("published_at"), F.lit("2024-01-02").cast("timestamp").alias("collected_at"))
    return detect(docs).withColumn("occurred_on", F.col("occurred_on").cast("string"))


@query("topic_candidates", r"""
SELECT doc_id FROM documents WHERE regexp_matches(chr(10) || text, '(^|[^\w\x{C0}-\x{24F}])(nicht|pour|with)($|[^\w\x{C0}-\x{24F}])', 'i')""")
def topic_candidates(spark, sf):
    docs = S.load(spark, sf, "documents").withColumn("title", F.lit(None).cast("string"))
    return A.candidates(docs, r"\b(nicht|pour|with)\b").select("doc_id")


def annotations(spark, sf):
    """An annotation answer per order, made from the order's own columns."""
    o = S.load(spark, sf, "orders")
    entry = lambda code, stance, evidence: F.struct(code.alias("code"), stance.alias("stance"), evidence.alias("evidence"))
    k = F.pmod("o_custkey", F.lit(3))
    code = F.when(k == 0, "red").when(k == 1, "blue").otherwise("mauve")
    stance = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "rising").when(F.pmod("o_orderkey", F.lit(4)) == 1, "booming").otherwise("neutral")
    payload = F.to_json(F.struct((F.col("o_orderstatus") != "P").alias("is_relevant"),
                                 F.array(entry(code, stance, F.lit("a")), entry(code, F.lit("declining"), F.lit("b"))).alias("color"),
                                 F.array(entry(F.lit("metal"), F.lit("neutral"), F.col("o_orderpriority"))).alias("material"),
                                 F.array(F.lit("Zed"), F.lit("Acme"), F.lit("Zed")).alias("brands"), F.lit("résumé").alias("summary_fr")))
    return o.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not json")).otherwise(payload).alias("payload"))


ANSWERS = """an AS (SELECT o_orderkey AS document_id, o_orderstatus <> 'P' AS relevant, CASE o_custkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'mauve' END AS code,
  CASE o_orderkey % 4 WHEN 0 THEN 'rising' WHEN 1 THEN 'booming' ELSE 'neutral' END AS stance, o_orderpriority AS pr, o_orderdate AS published
  FROM orders WHERE o_orderpriority <> '5-LOW')"""


def entries(spark, sf):
    return A.annotation_entries(A.parsed_annotations(annotations(spark, sf), ("color", "material")), dictionary_rows(spark, PARTS), ("color", "material"))


@query("annotation_mentions", f"""
WITH {ANSWERS} SELECT document_id, 'color' AS dimension, code, CASE WHEN stance = 'booming' THEN 'declining' ELSE stance END AS stance,
  CASE WHEN stance = 'booming' THEN 'b' ELSE 'a' END AS evidence, CAST(CAST(published AS DATE) AS VARCHAR) AS occurred_on FROM an WHERE relevant AND code <> 'mauve'
UNION ALL SELECT document_id, 'material', 'metal', 'neutral', pr, CAST(CAST(published AS DATE) AS VARCHAR) FROM an WHERE relevant""")
def annotation_mentions(spark, sf):
    return A.annotation_mentions(entries(spark, sf), S.documents(spark, sf)).withColumn("occurred_on", F.col("occurred_on").cast("string"))


@query("rejected_annotations", f"""
WITH {ANSWERS} SELECT document_id, 'color' AS dimension, code, stance FROM an WHERE relevant AND (code = 'mauve' OR stance = 'booming')
UNION ALL SELECT document_id, 'color', code, 'declining' FROM an WHERE relevant AND code = 'mauve'""")
def rejected_annotations(spark, sf):
    return entries(spark, sf).where(~F.col("valid")).select("document_id", "dimension", "code", "stance")


@query("annotated_documents", f"""
WITH {ANSWERS} SELECT document_id, CASE WHEN relevant THEN 'extracted' ELSE 'irrelevant' END AS status, CASE WHEN relevant THEN 'Acme|Zed' END AS brands FROM an
UNION ALL SELECT o_orderkey, 'failed', NULL FROM orders WHERE o_orderpriority = '5-LOW'""")
def annotated_documents(spark, sf):
    rows = A.annotated_documents(A.parsed_annotations(annotations(spark, sf), ("color", "material")))
    return rows.select("document_id", "status", F.array_join("brands", "|").alias("brands"))


def reread(spark, sf):
    docs, ment = S.documents(spark, sf), S.mentions(spark, sf)
    item = F.struct(F.lit("violet").alias("code"), F.lit("rising").alias("stance"), F.col("title").alias("evidence"))
    answers = A.reread_candidates(docs, "color", "v2").where(F.pmod("id", F.lit(2)) == 0).select(
        F.col("id").alias("document_id"), (F.pmod("id", F.lit(4)) == 0).alias("relevant"), F.array(item, item).alias("items"))
    promo = F.when(F.col("dimension") == "PROMO", "color").otherwise(F.col("dimension"))  # one part type stands for the colours
    return A.reread_dimension(ment.withColumn("dimension", promo), docs, answers, "color", "v2")


STALE = """st AS (SELECT * FROM docs WHERE status = 'extracted' AND NOT is_demo AND (prompt_version IS NULL OR (prompt_version <> 'v2' AND prompt_version NOT LIKE '%+color@v2')))"""


@query("reread_candidates", with_views("docs", f"WITH {STALE} SELECT id, prompt_version FROM st"))
def reread_candidates(spark, sf):
    return A.reread_candidates(S.documents(spark, sf), "color", "v2").select("id", "prompt_version")


@query("reread_mentions", with_views("docs ment", f"""
WITH {STALE} SELECT document_id, CASE WHEN dimension = 'PROMO' THEN 'color' ELSE dimension END AS dimension, code, stance, evidence FROM ment
WHERE dimension <> 'PROMO' OR document_id NOT IN (SELECT id FROM st WHERE id % 4 = 0)
UNION ALL SELECT id, 'color', 'violet', 'rising', title FROM st WHERE id % 4 = 0"""))
def reread_mentions(spark, sf):
    return reread(spark, sf)[0].select("document_id", "dimension", "code", "stance", "evidence")


@query("reread_markers", with_views("docs", f"""
WITH {STALE} SELECT id, CASE WHEN id % 2 = 0 AND id IN (SELECT id FROM st) THEN coalesce(prompt_version, 'v?') || '+color@v2' ELSE prompt_version END AS prompt_version FROM docs"""))
def reread_markers(spark, sf):
    return reread(spark, sf)[1].select("id", "prompt_version")


@query("pending_documents", with_views("docs", "SELECT id FROM docs WHERE status = 'pending'"))
def pending_documents(spark, sf):
    return A.pending_documents(S.documents(spark, sf)).select("id")


@query("pending_page", with_views("docs", "SELECT id FROM docs WHERE status = 'pending' ORDER BY collected_at, id LIMIT 100"))
def pending_page(spark, sf):
    """The oldest hundred, as a run asks for them."""
    return A.pending_documents(S.documents(spark, sf), 100).select("id")


@query("document_status_tallies", with_views("docs", "SELECT status, count(*) AS documents FROM docs GROUP BY status"))
def document_status_tallies(spark, sf):
    return A.status_tallies(S.documents(spark, sf))


@query("loaded_dictionary", with_views("dict ment", """
SELECT dict.dimension, dict.code, label, hex, multicolor, coalesce(n, 0) AS mentions FROM dict LEFT JOIN (SELECT dimension, code, count(*) AS n FROM ment GROUP BY 1, 2) USING (dimension, code)"""))
def loaded_dictionary(spark, sf):
    """The sample's attributes written as a dictionary file, loaded from it and joined to the mentions of each."""
    items: dict[str, dict] = {}
    for r in S.dictionary(spark, sf).collect():  # a dictionary's rows
        items.setdefault(r["dimension"], {"label_fr": r["dimension"].title(), "items": {}})["items"][r["code"]] = {"fr": r["label"], "hex": r["hex"], "multicolor": r["multicolor"]}
    path = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"dimensions": items}),)], "value string").write.text(path)
    rows = dictionary_rows(spark, read_dictionary(spark, path))
    counts = S.mentions(spark, sf).groupBy("dimension", "code").agg(F.count(F.lit(1)).alias("mentions"))
    return rows.join(counts, ["dimension", "code"], "left").select("dimension", "code", "label", "hex", "multicolor", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("reading_cost", "SELECT count(*) AS documents, round(sum(length(text)) / 4 * 2e-6 + count(*) * 500 * 1e-5, 6) AS cost FROM documents")
def reading_cost(spark, sf):
    return A.reading_cost(S.load(spark, sf, "documents")).select("documents", F.round("cost", 6).alias("cost"))


@query("uncited_labels", with_views("dict", "SELECT label FROM dict WHERE dimension = 'PROMO'"))
def uncited_labels(spark, sf):
    return A.uncited_labels(S.dictionary(spark, sf).where(F.col("dimension") == "PROMO"), "Les montures épaisses redeviennent visibles.")


# --- URLs of the pages table -----------------------------------------------------------------------

@query("page_urls", r"""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '\.+$', ''), '^www\.', '') AS domain,
  nullif(regexp_extract(regexp_replace(url, '#.*$', ''), '[?&]page=([^&]+)', 1), '') AS page,
  CASE WHEN regexp_matches(url, '/([a-z]{2})/') THEN regexp_extract(url, '/([a-z]{2})/', 1) END AS model,
  CASE WHEN regexp_matches(url, '(/[a-z]{2}/)(\d+)') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_extract(url, '(/[a-z]{2}/)(\d+)', 1) || regexp_extract(url, '(/[a-z]{2}/)(\d+)', 2) ELSE url END AS canonical,
  replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '-', ' ') AS title FROM pages""")
def page_urls(spark, sf):
    url = F.col("url")
    return S.load(spark, sf, "pages").select(
        "page_id", U.domain(url).alias("domain"), U.query_value(url, "page").alias("page"), U.model_key(url, "/([a-z]{2})/").alias("model"),
        U.canonical(url, r"(/[a-z]{2}/)(\d+)").alias("canonical"), U.title_from_url(url).alias("title"))


@query("page_stored_urls", r"""
SELECT page_id, CASE WHEN length(url) <= 1000 THEN lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE '' END
  || regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) END AS stored FROM pages""")
def page_stored_urls(spark, sf):
    return S.load(spark, sf, "pages").select("page_id", U.stored(F.col("url")).alias("stored"))


@query("page_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages")
def page_text(spark, sf):
    flat = F.trim(F.regexp_replace(X.strip_tags(F.col("html")), r"\s+", " "))
    return S.load(spark, sf, "pages").select("page_id", F.md5(flat.cast("binary")).alias("text"))


