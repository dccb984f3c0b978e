"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "proofgrid", cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that later passes see the same rows even after lost executors.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local session without
    that setting gets a scratch folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="proofgrid-"))
    return df.checkpoint()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that Spark plans with its measured size.

    ``by`` names columns whose values get folders of their own; a filter on them reads no other.
    """
    folder = shared_folder(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def together(df: DataFrame, *key: str) -> DataFrame:
    """Rows of one key in one of ``spark.sql.shuffle.partitions`` partitions.

    For light rows that are about to grow or to be worked on hard: later grouping by the
    key and more columns needs no further shuffle. The number is stated because adaptive
    execution would merge partitions by their bytes, not by the work in them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def widened(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores is dealt out evenly; any other stays as it is.

    For few files whose rows take much work each.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sized(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables under the checkpoint folder that all executors share."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="proofgrid-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
