"""Session settings, table loading and the shared-folder materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # parsing and typing cost far more per byte than a plain scan: keep small shuffles parallel
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # a megabyte of records becomes many of cells: tasks read little, and their number grows with the table
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.files.openCostInBytes": "256k",
}
PREFERRED = (
    "spark.sql.adaptive.coalescePartitions.minPartitionSize",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.files.openCostInBytes",
)
TASK_ROWS = 50_000  # records that one task parses, generates or rebuilds


def build_session(app: str = "cellwise", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to a session made elsewhere.

    Results depend on the first two. The partition sizes are preferences: what the session's maker
    has set is kept."""
    for key in ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys"):
        spark.conf.set(key, SETTINGS[key])
    for preferred in PREFERRED:
        if not spark.sparkContext.getConf().contains(preferred):
            spark.conf.set(preferred, SETTINGS[preferred])
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan by its keys over all task slots, and over more tasks if they would get over ``TASK_ROWS`` rows each;
    a scan of as many input splits stays as it is.

    Meant for plain scans, whose rows are counted from file footers: asking a plan with shuffles for its partitions would run them."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, *keys) if df.rdd.getNumPartitions() < parts else df


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder of its own, because
    on a cluster such a folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = os.environ.get("CELLWISE_LOCAL_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, *partition_by: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back, as ``schema`` if given.

    Cuts lineage like a checkpoint, survives lost executors, keeps column pruning
    and filter pushdown, and gives the optimizer real sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
