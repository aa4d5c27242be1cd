"""The registered queries of this package; each with its SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwave.session import ensure_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ensure_session(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.sketch import with_edits

    return with_edits(documents(spark, sf_dir))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 1024)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

OP5_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, coalesce(contains(url, '://'), false) AS full_url,
         regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^#?]*\?([^#]*)', 1, 's'), ''), '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'gi'), '^&', '') AS q
  FROM pages),
r(verdict, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
f AS (SELECT u.*, regexp_replace(host, ':\d+$', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS k, r.rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
g AS (SELECT k, bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false) AS hit FROM f WHERE n = 1 AND full_url GROUP BY k)
SELECT f.page_id, host, path, rule, coalesce(verdict, CASE WHEN full_url AND g.hit THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN g USING (k) WHERE n = 1"""


@query("op5_url_filters", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.url_filter import judged_urls

    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfwave.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.shards import sharded

    rows = sharded(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.packing import packed

    return packed(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.quality import quality

    return quality(documents(spark, sf_dir), keep=["doc_id"])


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda k: list_slice(words, k, k + 3))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
one AS (SELECT doc_id, md5(array_to_string(sh, ' ')) AS h FROM (SELECT doc_id, unnest(shingles) AS sh FROM s)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)
SELECT doc_id, n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM n JOIN reach ON a = doc_id GROUP BY doc_id, n_shingles"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.minhash import Banding, near_duplicates

    return near_duplicates(documents(spark, sf_dir), Banding(width=4)).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.toxicity import fit, held_out, toxicity

    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.pii import personal_data, train

    docs = documents(spark, sf_dir)
    return personal_data(docs, train(docs), keep=["doc_id"])


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS uses FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
cells AS (SELECT lang, source, term, count(*) AS uses FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(uses) AS n FROM cells GROUP BY 1, 2),
l AS (SELECT lang, count(*) AS v, sum(uses) AS n FROM kept GROUP BY 1),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(cells.uses, 0) AS uses,
         CAST(1 + (1000000000::HUGEINT * (coalesce(cells.uses, 0) + 2)) // (coalesce(n.n, 0) + 2 * l.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (kept.uses + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM groups g JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source JOIN kept ON kept.lang = g.lang
  LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source AND cells.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE uses > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.divergence import divergence

    return divergence(documents(spark, sf_dir))


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.alignment import aligned

    return aligned(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"), keep=["doc_id"])


OP11_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
s AS (SELECT doc_id, unnest(range(n - 49)) AS i, h FROM h WHERE n >= 50),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM s),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM w) WHERE least < doc_id),
g AS (SELECT *, sum(CASE WHEN i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM o)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r),
c AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last_, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept FROM p JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last_ + 1) END)) AS kept_sha256 FROM h LEFT JOIN c USING (doc_id)"""


@query("op11_repeated_passages", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwave.llm.runindex import without_repeats

    return without_repeats(documents(spark, sf_dir), keep=["doc_id"])
