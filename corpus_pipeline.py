"""A training corpus from documents: quality, line spread, near-duplicates, mixing, packing.

Each stage takes what its predecessor kept, with the columns of ``documents``; the last one returns
pieces of packed sequences. A stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import cotraining, line_spread, mixing, near_dups, packing
from proofgrid.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from ``labels`` of the documents given."""
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    return cotraining.scored(docs, model).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites; one that has no line left goes."""
    cleaned = line_spread.without_boilerplate(docs).filter("n_lines = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumns({"text": F.col("clean_text"), "n_chars": n_chars}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of the document with the smallest id, the least row where rows share that id.

    Rows without an id are compared like all others, under a number from 2 ** 62 on, made of their cells, so they
    stay only where no document with a smaller id is linked with them.
    """
    cells = F.xxhash64(F.lit("row"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0001")) for c in docs.columns])
    own = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.pmod(cells, F.lit(1 << 62)))
    rows = docs.withColumn("_own", own)
    found = near_dups.near_duplicates(rows.select(F.col("_own").alias("doc_id"), "text"))
    gone = stored(found.filter("not kept").select(F.col("doc_id").alias("_own")).distinct(), "near-gone")
    left = rows.join(gone, "_own", "left_anti")
    ids = rows.select("_own").join(gone, "_own", "left_anti")
    repeated = stored(ids.groupBy("_own").count().filter("count > 1").select("_own"), "near-repeated")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    single = left.join(repeated, "_own", "left_anti").select(*docs.columns)
    least = left.join(repeated, "_own").groupBy("_own").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return single.union(least.select("_row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights of the sources ask for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.query(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
