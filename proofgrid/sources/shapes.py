"""Schemas of the tables that this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

METADATA = T.StructType(
    [
        T.StructField("img_id", T.StringType()),
        T.StructField("source_img_id", T.StringType()),
        T.StructField("official_split", T.StringType()),
        T.StructField("dataset_revision", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("question_class", T.ArrayType(T.StringType())),
        T.StructField("original", T.StringType()),
        T.StructField("image_variant", T.StringType()),
        T.StructField("official_origins", T.ArrayType(T.StringType())),
        T.StructField("partition", T.StringType()),
    ]
)

QA_RECORD = T.StructType(
    [
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("metadata", METADATA),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("source_image", T.StringType()),
        T.StructField("evaluated_image", T.StringType()),
        T.StructField("token_logprobs", T.ArrayType(T.DoubleType())),
        T.StructField("mean_sequence_logprob", T.DoubleType()),
        T.StructField("sequence_confidence", T.DoubleType()),
        T.StructField("metadata", METADATA),
    ]
)

INTERVENTION = T.StructType(
    [
        T.StructField("intervention_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("source_img_id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("intervention", T.StringType()),
        T.StructField("treatment", T.StringType()),
        T.StructField("fraction", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("repeat", T.IntegerType()),
        T.StructField("target_text", T.StringType()),
        T.StructField("original_fixed_answer_mean_logprob", T.DoubleType()),
        T.StructField("fixed_answer_mean_logprob", T.DoubleType()),
        T.StructField("attribution_sha256", T.StringType()),
        T.StructField("model_revision", T.StringType()),
        T.StructField("adapter_revision", T.StringType()),
    ]
)

TASK = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("start", T.DateType()),
        T.StructField("finish", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
