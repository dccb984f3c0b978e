"""Task intervals: active months, monthly workload, category lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Colour of each task category.
CATEGORY_COLOURS = {
    "Administrative": "rgb(200, 200, 200)",
    "Admin": "rgb(150, 150, 150)",
    "Segmentation": "rgb(100, 149, 237)",
    "VLM": "rgb(255, 140, 0)",
    "Human Study": "rgb(34, 139, 34)",
    "Publication": "rgb(220, 20, 60)",
    "Milestone": "rgb(255, 215, 0)",
}


def colour_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORY_COLOURS.items()), "category string, colour string")


def with_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join; unknown keys get null. Spark broadcasts the table if its measured size allows."""
    return df.join(table, key, "left")


def active_months(tasks: DataFrame, start: str = "start", finish: str = "finish") -> DataFrame:
    """One row per task and month in which it is active: it starts by month end and ends at or after month start."""
    first, last = F.trunc(start, "MM"), F.trunc(finish, "MM")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return tasks.select("*", F.explode(months).alias("month_start"))


def monthly_workload(tasks: DataFrame, category: str = "category") -> DataFrame:
    return active_months(tasks).groupBy("month_start", category).agg(F.count("*").alias("task_count"))
