"""Documents to training sequences: rules, toxicity, near duplicates, personal data, packing.

Each stage takes what its predecessor kept and decides on all of it; the last returns pieces of packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwave.session import ensure_session, shared_folder

#: Models and bounded edits of similarity have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    from shelfwave.llm.quality import FIELDS, quality

    ensure_session(spark)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    # the verdict's columns give way to columns of the documents that have their names
    clash = {n: f"__doc_{n}" for n in names if n in docs.columns}
    judged = quality(docs.withColumnsRenamed(clash))
    return judged.where("kept").drop(*names).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not call toxic; its labels come from the rows outside the held-out quarter."""
    from shelfwave.llm import toxicity as X

    ensure_session(spark)
    model = X.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~X.held_out()))
    clash = {n: f"__doc_{n}" for n in ("score", "predicted") if n in docs.columns}
    scored = X.toxicity(docs.withColumnsRenamed(clash), model)
    return scored.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    from shelfwave.llm.minhash import without_near_duplicates

    ensure_session(spark)
    return without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in the text; n_chars, where there is one, counts the new text."""
    from pyspark.sql import functions as F

    from shelfwave.llm.pii import masked, train

    ensure_session(spark)
    out = masked(docs, train(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with the pieces' ids."""
    import public_tokenizers

    from shelfwave.llm.packing import packed

    ensure_session(spark)
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
