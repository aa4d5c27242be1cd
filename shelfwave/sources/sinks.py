"""Writers: partitioned snapshots, search interest, the CSV export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwave.functions.numbers import fr_number
from shelfwave.operators.ingest import duplicate_keys, upserted_interest
from shelfwave.operators.trends import at_week, in_tenths, status_label


def write_partitioned(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions the frame holds. Rows of one partition are brought together, so a week is few files; the rebalance hint lets
    adaptive execution split a large one over several tasks."""
    (df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Store a micro-batch in its own folders (below those of `partitions`), where its tasks have the rows. A repeated batch overwrites itself."""
    (df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch").parquet(path))


def drop_partitions(spark: SparkSession, path: str, partition: str, doomed) -> list[str]:
    """Delete the partition folders whose value `doomed` accepts, through the table's own file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{partition}=") and doomed(name.split("=", 1)[1]):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def replace_snapshots(snapshots: DataFrame, path: str, start: date, weeks: list[date]) -> list[str]:
    """Store recomputed snapshots: every week from `start` on is replaced. Weeks that are no longer computed go first, so a failure in between
    leaves none of them behind; running it again completes the rest."""
    kept = {w.isoformat() for w in weeks}
    gone = drop_partitions(snapshots.sparkSession, path, "week", lambda v: v >= start.isoformat() and v not in kept)
    write_partitioned(snapshots, path, "week")
    return gone


def touched_weeks(batch: DataFrame) -> list:
    """Weeks of a batch: at most as many as the calendar has, so they may be listed and prune a scan."""
    return [r["week"] for r in batch.select("week").distinct().collect()]


def upsert_search_interest(batch: DataFrame, path: str, order: str | None = None) -> None:
    """Merge a batch into the week-partitioned table; only the batch's weeks are read and rewritten."""
    stored = batch.sparkSession.read.parquet(path).where(F.col("week").isin(touched_weeks(batch)))
    write_partitioned(upserted_interest(stored, batch, order), path, "week")


def publish(table: DataFrame, path: str, key: tuple[str, ...]) -> None:
    """Write a table after its key was checked."""
    doubled = duplicate_keys(table, key).limit(1).collect()
    if doubled:
        raise ValueError(f"key {key} is not unique, e.g. {doubled[0].asDict()}")
    table.write.mode("overwrite").parquet(path)


# Header of the French spreadsheet export.
CSV_HEADER = ("Attribut", "Code", "Semaine", "Mentions pondérées", "Part (%)", "Momentum (%)", "Statut",
              "Avis « en recul » sur 4 sem. (%)", "Intérêt de recherche (0-100)")
BOM = "﻿"


def export_rows(snapshots: DataFrame, dictionary: DataFrame, dimension: str, week: date) -> DataFrame:
    """One dimension and week as French text, most mentions first."""
    rows = at_week(snapshots.where(F.col("dimension") == dimension), week)
    total = rows.agg(F.coalesce(F.nullif(F.sum(in_tenths(F.col("mentions"))), F.lit(0)), F.lit(10)).alias("t")).scalar()
    labels = dictionary.where(F.col("dimension") == dimension).select("code", "label")
    shown = rows.join(labels, "code", "left").withColumn("part", F.lit(100.0) * in_tenths(F.col("mentions")) / total)
    texts = (F.col("label"), F.col("code"), F.col("week").cast("string"), fr_number(F.col("mentions")), fr_number(F.col("part")),
             fr_number(100 * F.col("momentum"), 0), status_label(F.col("status")), F.coalesce(fr_number(100 * F.col("decline_share"), 0), F.lit("")),
             F.coalesce(fr_number(F.col("search")), F.lit("")))
    return shown.orderBy(F.desc("mentions"), "code").select(*[t.alias(h) for t, h in zip(texts, CSV_HEADER)])


def write_export(rows: DataFrame, path: str) -> None:
    """One spreadsheet file: ";" between fields, CRLF, UTF-8 with a byte-order mark. A dimension's week is dictionary-sized."""
    first, *rest = rows.columns
    marked = rows.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in rest])
    (marked.coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").option("lineSep", "\r\n").option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").option("encoding", "UTF-8").csv(path))
