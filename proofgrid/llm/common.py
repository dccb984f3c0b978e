"""Small helpers that the operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run without ASCII white space
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*columns: str, names: tuple[str, str] = ("_k1", "_k2")) -> list[Column]:
    """128 bits that stand for a row's cells; equal rows, equal keys."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0001")) for c in columns]
    return [F.xxhash64(*cells).alias(names[0]), F.xxhash64(F.lit("second"), *cells).alias(names[1])]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read again.

    Cuts lineage like a checkpoint, and Spark then plans with the measured size of the files: it
    broadcasts what is small and shuffles what is not.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
