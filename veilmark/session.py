"""Session helpers: a tuned local session for tests/bench and checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "veilmark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("VEILMARK_DRIVER_MEMORY", "16g"))
    for k, v in {**DEFAULT_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; only when unset (local tests) pick a scratch folder.

    On a cluster the shared folder comes from the session configuration and is
    never replaced by a machine-local one.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder; no machine-local fallback on a cluster")
        d = tempfile.mkdtemp(prefix="veilmark-ckpt-", dir=os.environ.get("VEILMARK_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables and logs that one query writes and reads."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilmark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts the lineage, keeps single columns readable."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Session setting with the number of partitions for CPU-heavy work on texts (unset: the scan's own).
TEXT_PARTITIONS = "spark.veilmark.textPartitions"


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition ``df`` on a unique row key for CPU-heavy row-local work.

    Only if the caller gives a number, here or as ``spark.veilmark.textPartitions``;
    otherwise the plan is left as it is.  Of use where a table is a few files of one
    row group each, which no split size can divide.
    """
    n = partitions or int(df.sparkSession.conf.get(TEXT_PARTITIONS, None) or 0)
    return df.repartition(n, key) if n else df


#: Rows from which a table is worth dealing, rows of a part of it.
DEAL_FROM, DEALT_ROWS = 20_000, 100_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The columns of a table from which texts are built, over all cores where its files leave most of them idle.

    A file of one row group is one task, however many rows it has.  Rows are counted by
    task of the scan (footers are read for it, no column); if one has more than twice its
    share of a core's, they are dealt by ``key`` before any text is built.  Nothing is
    done for small tables, and where ``spark.veilmark.textPartitions`` says how to deal.
    """
    spark = df.sparkSession
    if int(spark.conf.get(TEXT_PARTITIONS, None) or 0):
        return df
    cores = spark.sparkContext.defaultParallelism
    tasks = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    rows, most = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if rows < DEAL_FROM or most * cores <= 2 * rows:
        return df
    return df.repartition(max(cores, -(-rows // DEALT_ROWS)), key)
