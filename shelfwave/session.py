"""Session settings the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # static: call-site capture on every column expression costs seconds of driver time on wide plans
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str | None = None, app: str = "shelfwave", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, apply SETTINGS to the cluster's own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", str(cpus if cpus.isdigit() else 8)))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return ensure_session(session)


def ensure_session(spark: SparkSession) -> SparkSession:
    """UTC days and weeks whatever session the caller brings; Python workers find this package where the driver found it (on a cluster: --py-files)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; whole texts need smaller batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default; a Python worker holds a batch several times over
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a local session takes one in its warehouse; a cluster raises."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df, forget_size: bool = False):
    """Reliable checkpoint in the shared folder. A checkpointed frame keeps the size its plan was estimated at, and joins multiply sizes: in an
    iterative job the number doubles its digits every round until planning takes all the driver has. `forget_size` drops the estimate."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    done = df.checkpoint()
    if not forget_size:
        return done
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)
