"""The queries of the operators over their whole tables, and the same in SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofgrid.llm import (
    cotraining, flac, language_id, line_rules, line_spread, merkle, mixing, near_dups, packing, periodic_runs, secrets, toxicity,
    url_rules,
)
from proofgrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.query(table(spark, sf_dir, "documents"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.query(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.query(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.query(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.query(spark, table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.query(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_line_rules": op2_line_rules,
    "op3_quality_cotraining": op3_quality_cotraining,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_line_spread": op6_line_spread,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_mixing": op8_mixing,
    "op9_flac": op9_flac,
    "op10_url_rules": op10_url_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle": op12_merkle,
    "op13_toxicity": op13_toxicity,
}
SQL: dict[str, str] = {
    "op2_line_rules": line_rules.SQL,
    "op6_line_spread": line_spread.SQL,
    "op8_mixing": mixing.SQL,
    "op10_url_rules": url_rules.SQL,
    "op12_merkle": merkle.SQL,
}
