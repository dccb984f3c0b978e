"""Exact dedupe, annotation conflicts and the merge report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source", "question_key", "answer_key"]
PAIR = ["source", "question_key"]


def metadata_digest(complexity: Column, question_class: Column, original: Column) -> Column:
    """Hash of the fields that duplicates must share; the order inside the class list counts."""
    fields = F.struct(complexity.alias("a"), question_class.alias("b"), original.alias("c"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _number(hex_text: str, at: int) -> Column:
    """60 bits of a text of hex digits."""
    return F.conv(F.substring(hex_text, at, 15), 16, 10).cast("bigint")


def collapse(
    rows: DataFrame, origin: str, origin_rank: Column, digest: str, order: list[Column], keep: list[str]
) -> DataFrame:
    """One row per (source, question, answer): first row's ``keep`` columns, ordered origins, conflict flag.

    Rows of an origin with a lower rank come first, then ``order`` decides. The set of
    origins is as short as the list of origins, however often a key repeats. Equal
    extremes of the digest, as two numbers, mean that all duplicates agree; numbers of fixed
    length keep an aggregate of the counts alone a hash aggregate, which holds keys and not rows.
    """
    ranked = rows.withColumn("_rank", origin_rank).withColumn("_md5", F.md5(digest))
    differ = lambda at: F.min(_number("_md5", at)) != F.max(_number("_md5", at))
    origins = F.sort_array(F.collect_set(F.struct("_rank", F.col(origin).alias("origin"))))
    per_key = ranked.groupBy(*KEY).agg(
        F.count("*").alias("rows"),
        F.min_by(F.struct(*keep), F.struct("_rank", *order)).alias("first"),
        F.transform(origins, lambda o: o["origin"]).alias("official_origins"),
        (differ(1) | differ(16)).alias("metadata_conflict"),
    )
    return per_key.select(*KEY, "rows", "official_origins", "metadata_conflict", "first.*")


def answer_conflicts(collapsed: DataFrame) -> DataFrame:
    """Questions with more than one distinct answer."""
    return collapsed.groupBy(*PAIR).agg(F.count("*").alias("answers")).filter("answers > 1")


def flag_conflicts(collapsed: DataFrame) -> DataFrame:
    """Add ``answer_conflict`` and ``excluded``.

    A join with the conflicting questions alone, not a window, so one question with very
    many answers stays spread over tasks.
    """
    clash = answer_conflicts(collapsed).select(*PAIR, F.lit(True).alias("answer_conflict"))
    flagged = collapsed.join(clash, PAIR, "left").withColumn(
        "answer_conflict", F.coalesce("answer_conflict", F.lit(False))
    )
    return flagged.withColumn("excluded", F.col("answer_conflict") | F.col("metadata_conflict"))


def merge_report(collapsed: DataFrame) -> DataFrame:
    """The seven counts of a merge, by a cascade of ever smaller aggregates.

    A question's rows are all excluded if it has several answers, else those with a
    metadata conflict; that needs no join.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = lambda c: F.when(c, 1).otherwise(0)
    per_question = collapsed.groupBy(*PAIR).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("answers"), F.sum(one(F.col("metadata_conflict"))).alias("metadata")
    )
    clash = F.col("answers") > 1
    per_source = per_question.groupBy("source").agg(
        F.sum("rows").alias("rows"),
        F.sum("answers").alias("answers"),
        F.sum(one(clash)).alias("conflict_groups"),
        F.sum("metadata").alias("metadata_groups"),
        F.sum(F.when(clash, F.col("answers")).otherwise(F.col("metadata"))).alias("excluded"),
    )
    return per_source.agg(
        total("rows").alias("input_rows"),
        total(F.col("rows") - F.col("answers")).alias("exact_duplicates_removed"),
        total("conflict_groups").alias("conflicting_image_question_groups_removed"),
        total("metadata_groups").alias("metadata_conflict_groups_removed"),
        total("excluded").alias("conflicting_rows_removed"),
        total(F.col("answers") - F.col("excluded")).alias("primary_rows_after_exclusions"),
        total(one(F.col("answers") > F.col("excluded"))).alias("primary_source_images_after_exclusions"),
    )
