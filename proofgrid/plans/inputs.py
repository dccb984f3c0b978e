"""Inputs of the catalogue, derived from the given tables: QA records, predictions, maps, tasks, documents.

Each has a twin in ``sqltext`` that says the same in SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions import answers
from proofgrid.functions.keys import hash60, item_id, joined, question_text, source_id
from proofgrid.operators import dedupe
from proofgrid.session import widened
from proofgrid.sources import records

CONDITIONS = ["paired", "unadapted", "question_only", "constant", "shuffled"]
CLASSES = ["colour", "count", "location", "size", "type"]
CONSTANT_IMAGE = "images/constant.png"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work on their texts."""
    return widened(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it, by an equi-join on unique keys."""
    said = table(spark, sf_dir, "conversations")
    user = widened(said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked")))
    reply = said.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    pairs = user.join(reply, ["conv_id", "turn"])
    return pairs.withColumn("h", hash60(joined(F.col("conv_id"), F.col("turn"))))


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested QA records."""
    h = F.col("h")
    pick = lambda i: F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (i % 5 + 1).cast("int"))
    classes = F.when(h % 3 == 0, F.array(pick(h), pick(F.shiftright(h, 3)))).otherwise(F.array(pick(h)))
    split = F.when(h % 10 == 0, "test").otherwise("train")
    return records.chat_records(
        turns(spark, sf_dir), F.col("asked"), F.col("said"), F.col("conv_id"), split=split, revision="pinned",
        complexity=1 + F.col("turn") % 3, question_class=F.when(h % 7 != 0, classes),
        original=F.concat(F.lit("turn "), F.col("turn").cast("string")),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA records with key columns and flat metadata."""
    keyed = records.with_keys(qa_records(spark, sf_dir))
    return keyed.select(
        "source", "question", "answer", "question_key", "answer_key", "item_id",
        F.col("metadata.complexity").alias("complexity"), F.col("metadata.question_class").alias("classes"),
        F.col("metadata.official_split").alias("split"), F.col("metadata.original").alias("original"),
        F.col("images")[0].alias("image"), hash60(F.col("item_id")).alias("ih"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five conditions per QA record: right, shortened, reversed or unrelated answers."""
    base = qa(spark, sf_dir)
    parts = F.split("answer", " ")
    shortened = F.array_join(F.filter(parts, lambda t, i: i % 5 != 4), " ")
    backwards = F.array_join(F.reverse(parts), " ")
    made = {
        "paired": F.when(F.col("ih") % 3 != 0, F.col("answer")).otherwise(shortened),
        "unadapted": shortened,
        "question_only": F.col("question"),
        "constant": F.when(F.col("ih") % 2 == 0, F.col("answer")).otherwise(shortened),
        "shuffled": backwards,
    }
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), made[c].alias("prediction")) for c in CONDITIONS])
    return base.select(
        "item_id", "source", "question", F.col("answer").alias("reference"), "complexity", "classes", "split", "image",
        "ih", F.inline(cells),
    )


def logprobs(text: str) -> F.Column:
    """One log probability per token, now and then null or not a number."""
    made = lambda t, i: F.when(i % 11 == 10, F.lit(None)).when(i % 13 == 12, F.lit(float("nan"))).otherwise(
        -F.length(t) / 16.0
    )
    return F.transform(F.split(F.col(text), " "), made)


def scored_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with exact match, mean log probability and confidence."""
    exact = answers.exact_match(answers.normalised(F.col("reference")), answers.normalised(F.col("prediction")))
    return (
        predictions(spark, sf_dir)
        .withColumn("exact_match", exact)
        .withColumn("token_logprobs", logprobs("prediction"))
        .withColumn("mean_logprob", answers.mean_logprob(F.col("token_logprobs")))
        .withColumn("confidence", answers.sequence_confidence(F.col("token_logprobs")))
    )


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as annotations with many duplicates and conflicts."""
    items = table(spark, sf_dir, "lineitem")
    digest = F.sha2(joined(*[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")]), 256)
    return items.select(
        F.col("l_orderkey").cast("string").alias("source"),
        F.col("l_linenumber").cast("string").alias("question_key"),
        F.lower("l_returnflag").alias("answer_key"),
        F.col("l_returnflag").alias("answer"),
        F.col("l_linestatus").alias("complexity"),
        F.when(F.col("l_suppkey") % 3 == 0, "test").otherwise("train").alias("origin"),
        F.col("l_partkey").alias("partkey"),
        digest.alias("row_digest"),
        F.lit(None).cast("array<string>").alias("classes"),
        F.lit(None).cast("string").alias("original"),
    )


def collapsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_rows(spark, sf_dir)
    marked = rows.withColumn(
        "digest", dedupe.metadata_digest(F.col("complexity"), F.col("classes"), F.col("original"))
    )
    rank = F.when(F.col("origin") == "train", 0).otherwise(1)
    keep = ["answer", "complexity", "partkey"]
    return dedupe.collapse(marked, "origin", rank, "digest", [F.col("row_digest")], keep)


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.flag_conflicts(collapsed_rows(spark, sf_dir))


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers with a confidence, a correctness label and a cluster."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", (F.col("value") / (F.col("value") + 50.0)).alias("confidence"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("correct"),
    )


GRID_SIDE = 8
METHODS = ("decoder_answer_to_image_attention", "answer_conditioned_grad_cam")


def map_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 patch grids with two maps each."""
    vectors = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda v: 127.0 + 100.0 * v.cast("double"))
    maps = F.create_map(F.lit(METHODS[0]), F.col("embedding"), F.lit(METHODS[1]), F.reverse("embedding"))
    return vectors.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("item_id"),
        F.concat(F.lit("s"), (F.col("vec_id") % 97).cast("string")).alias("source_img_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("target_text"),
        F.lit("m1").alias("model_revision"), F.lit("a1").alias("adapter_revision"),
        values.alias("values"), maps.alias("maps"), F.col("label"),
    )


def patch_weight(i):
    """Weights of the linear test scorer; sums of eighths."""
    return (i % 5 - 2) / 8.0


PRIORITY_CATEGORY = {
    "1-URGENT": "Milestone", "2-HIGH": "Publication", "3-MEDIUM": "Human Study", "4-NOT SPECIFIED": "Unplanned",
    "5-LOW": "Segmentation",
}


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks that start on the order date and last up to 89 days."""
    start = F.to_date("o_orderdate")
    category = F.col("o_orderpriority")
    for priority, name in PRIORITY_CATEGORY.items():
        category = F.when(F.col("o_orderpriority") == priority, name).otherwise(category)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("task "), F.col("o_orderkey").cast("string")).alias("task"),
        start.alias("start"), F.date_add(start, (F.col("o_custkey") % 90).cast("int")).alias("finish"),
        category.alias("category"), F.col("o_orderstatus").alias("status"),
    )


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with heading, separator, bullet and bold marks put in by line number."""
    mark = lambda l, i: (
        F.when(i % 9 == 4, F.lit("---"))
        .when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 4) % 4).cast("int")), F.lit(" "), l))
        .when(i % 4 == 1, F.concat(F.lit("- "), l))
        .when(i % 8 == 2, F.concat(F.lit("**"), l, F.lit("**:")))
        .when(i % 8 == 6, F.concat(F.lit("*"), l, F.lit("*")))
        .otherwise(l)
    )
    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))
