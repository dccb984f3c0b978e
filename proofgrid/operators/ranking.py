"""Global order without a single-task sort, and first row per group without a hot task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.session import durable

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _place(df: DataFrame, order: list) -> DataFrame:
    """Range-partition and sort, then fix each row's (bucket, slot) in a checkpoint.

    Range bounds come from sampling; without the checkpoint the passes below could see
    different bounds.
    """
    placed = df.repartitionByRange(_buckets(df), *order).sortWithinPartitions(*order)
    placed = durable(placed.withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_bucket", F.shiftright("_at", _SLOT_BITS)).withColumn(
        "_slot", F.col("_at").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    ).drop("_at")


def _starts(totals: DataFrame, names: list[str]) -> DataFrame:
    """Running totals before each bucket; one row per partition, so the window is tiny."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in names]
    )


def with_position(df: DataFrame, *order: Column | str, out: str = "position") -> DataFrame:
    """Add the 0-based position of every row under ``order``, which must be total."""
    placed = _place(df, list(order))
    starts = _starts(placed.groupBy("_bucket").agg(F.count("*").alias("n")), ["n"])
    ranked = placed.join(F.broadcast(starts), "_bucket")
    return ranked.withColumn(out, F.col("_start_n") + F.col("_slot")).drop("_bucket", "_slot", "_start_n")


def with_running_sums(df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """Add ``<value>_before`` columns: the sum over all rows that come earlier in ``order``.

    Callers group by the order columns first, so no two rows tie and no bucket is hot.
    """
    placed = _place(df, order)
    starts = _starts(placed.groupBy("_bucket").agg(*[F.sum(v).alias(v) for v in values]), values)
    earlier = Window.partitionBy("_bucket").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    summed = reduce(
        lambda d, v: d.withColumn(f"_in_{v}", F.coalesce(F.sum(v).over(earlier), F.lit(0))), values, placed
    ).join(F.broadcast(starts), "_bucket")
    for v in values:
        summed = summed.withColumn(f"{v}_before", F.col(f"_start_{v}") + F.col(f"_in_{v}"))
    return summed.drop("_bucket", "_slot", *[f"_start_{v}" for v in values], *[f"_in_{v}" for v in values])


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group as an aggregate: hot groups shrink before the shuffle."""
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*group).agg(first).select(*group, "_first.*").select(*df.columns)


def order_statistic(df: DataFrame, key: str, rank: int, small: int = 4096) -> str:
    """The value at a 0-based rank of a uniform hex key, found by leading digits.

    Each pass counts rows by three more digits and keeps one bucket, until the bucket is
    small enough to sort. The driver sees at most 4096 counts per pass.
    """
    near, width = df.select(key), 3
    while True:
        prefix = F.substring(key, 1, width)
        counts = near.groupBy(prefix.alias("b")).agg(F.count("*").alias("n")).collect()
        for bucket, n in sorted((r["b"], r["n"]) for r in counts):
            if rank < n:
                break
            rank -= n
        near, width = near.filter(prefix == bucket), width + 3
        if n <= small:
            return near.orderBy(key).limit(rank + 1).agg(F.max(key)).first()[0]
