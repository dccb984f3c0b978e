"""QA records: build them from a table, key them, rewrite them, match them with images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import keys
from proofgrid.operators.ranking import first_per_group


def chat_records(
    table: DataFrame, question: Column, answer: Column, image_id: Column, *, folder: str = "images",
    split: Column | None = None, revision: str = "", complexity: Column | None = None,
    question_class: Column | None = None, original: Column | None = None,
) -> DataFrame:
    """Question, answer and id columns as ``messages``, ``images`` and ``metadata``."""
    null = F.lit(None).cast("string")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ident = image_id.cast("string")
    metadata = F.struct(
        ident.alias("img_id"),
        ident.alias("source_img_id"),
        (null if split is None else split).alias("official_split"),
        F.lit(revision).alias("dataset_revision"),
        (null if complexity is None else complexity.cast("string")).alias("complexity"),
        (F.array().cast("array<string>") if question_class is None else question_class).alias("question_class"),
        (null if original is None else original).alias("original"),
        F.lit("original").alias("image_variant"),
    )
    return table.select(
        F.array(message("user", F.concat(F.lit(keys.IMAGE_TAG), question)), message("assistant", answer)).alias("messages"),
        F.array(F.concat(F.lit(folder + "/"), ident, F.lit(".jpg"))).alias("images"),
        metadata.alias("metadata"),
    )


def with_keys(records: DataFrame) -> DataFrame:
    """Add the key columns that the dedupe, split and audit operators group by."""
    question = keys.question_text(F.col("messages")[0]["content"])
    return (
        records.withColumn("source", keys.source_id())
        .withColumn("question", question)
        .withColumn("answer", F.col("messages")[1]["content"])
        .withColumn("question_key", keys.canonical(F.col("question")))
        .withColumn("answer_key", keys.canonical(F.col("answer")))
        .withColumn("item_id", keys.item_id(F.col("source"), F.col("question")))
    )


def question_only(records: DataFrame, constant_image: str) -> DataFrame:
    """A copy that shows every record the same image and says so."""
    return records.withColumn("images", F.array(F.lit(constant_image))).withColumn(
        "metadata", F.col("metadata").withField("image_variant", F.lit("constant_training_control"))
    )


def one_image_per_id(images: DataFrame, required: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each required id."""
    wanted = images.join(required.select(key).distinct(), key, "left_semi")
    return first_per_group(wanted, [key], order)


def missing_images(images: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Required ids without an image row."""
    return required.select(key).distinct().join(images.select(key), key, "left_anti")
