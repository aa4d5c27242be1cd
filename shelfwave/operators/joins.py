"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_BYTES = 8 << 20
PLACED_BYTES = 2 << 20  # of stored input for one task, where a stored row becomes several wider ones


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of a frame from the statistics of its scans; no job runs. Without statistics the size is beyond any bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def scanned_bytes(df: DataFrame) -> int:
    """Size of the files a frame is read from; 0 where it is read from none. No job runs."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def placed(df: DataFrame, *columns: str, each: int = PLACED_BYTES) -> DataFrame:
    """Rows brought together by `columns` in one task for every `each` bytes of stored input, so that a task holds no more when there is more
    input. Aggregates, windows and joins on these columns need no other exchange."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-scanned_bytes(df) // each))
    return df.repartition(n, *columns)


def bounded(side: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, measured: DataFrame | None = None) -> DataFrame:
    """Broadcast `side` only when its scans hold at most `max_bytes`; otherwise hand it back unhinted, and adaptive execution chooses by the real size
    (a shuffle join with skew handling, or a broadcast below its own threshold). `measured` is measured instead where `side` is computed from large
    tables but has at most one row for each of its rows."""
    return F.broadcast(side) if estimated_bytes(side if measured is None else measured) <= max_bytes else side


def numbered(rows: DataFrame, group: list[str], position: str, name: str = "n", bucket: int = 10_000) -> DataFrame:
    """1-based number of each row in its group by a distinct integer position. Rows are numbered inside position buckets and the
    bucket sizes are summed, so a group holding a large part of all rows is spread over many tasks."""
    from pyspark.sql import Window
    placed = rows.withColumn("_b", F.floor(F.col(position) / bucket))
    sizes = placed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(position))
    return placed.withColumn("_k", inside).join(offsets, [*group, "_b"]).withColumn(
        name, (F.col("_offset") + F.col("_k")).cast("long")).drop("_b", "_k", "_offset")
