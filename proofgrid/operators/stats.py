"""Clustered bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from proofgrid.functions.keys import hash60, joined
from proofgrid.operators import gates
from proofgrid.operators.ranking import with_position

BROADCAST_CLUSTERS = 1_000_000  # up to here the cluster sums are a few dozen megabytes


BLOCK = 4096  # cluster positions whose multiplicities are drawn at once
AT_ONCE = 256  # replicates of a block held at once


def _generator(seed: int, low: int, high: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, low, high])))


@lru_cache(maxsize=4)
def block_draws(clusters: int, block: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of each replicate's ``clusters`` draws fall into a block of positions.

    The range of blocks is halved again and again; at every cut a binomial number, drawn from a generator that
    seed and range decide, says how many draws go left. All tasks walk the same numbers without meeting.
    """
    low, high = 0, -(-clusters // BLOCK)
    drawn = np.full(n_boot, clusters, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        size = min(high * BLOCK, clusters) - low * BLOCK
        left = _generator(seed, low, high).binomial(drawn, (middle - low) * BLOCK / size)
        drawn, low, high = (left, low, middle) if block < middle else (drawn - left, middle, high)
    return drawn


def multiplicities(clusters: int, block: int, n_boot: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For some replicates at a time: the first one's number, and how often each draws each position of the block."""
    drawn = block_draws(clusters, block, n_boot, seed)
    size = min(clusters - block * BLOCK, BLOCK)
    generator = _generator(seed, block, block + 1)
    for first in range(0, n_boot, AT_ONCE):
        yield first, generator.multinomial(drawn[first : first + AT_ONCE], np.full(size, 1 / size))


def _split_sums(placed: DataFrame, group: list[str], values: list[str], clusters: int, n_boot: int, seed: int) -> DataFrame:
    """``replicate, <group>, <values>`` summed with the multiplicities of the rows' ``position``.

    Every task draws the multiplicities of its own positions for all replicates and hands on one row per replicate and
    group it has met. No row stands for a draw, and nothing is joined.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for block, rows in batch.groupby(batch["position"] // BLOCK):
                at = (rows["position"] - block * BLOCK).to_numpy()
                numbers = rows[values].to_numpy(float)
                codes, names = pd.factorize(pd.MultiIndex.from_frame(rows[group])) if group else (np.zeros(len(rows), int), [()])
                sides = [(totals.setdefault(tuple(name), np.zeros((n_boot, len(values)))), codes == i) for i, name in enumerate(names)]
                for first, times in multiplicities(clusters, int(block), n_boot, seed):
                    for total, own in sides:
                        total[first : first + len(times)] += times[:, at[own]] @ numbers[own]
        for name, total in totals.items():
            out = pd.DataFrame(total, columns=values)
            for column, cell in zip(group, name):
                out[column] = cell
            out["replicate"] = np.arange(n_boot)
            yield out[["replicate", *group, *values]]

    fields = [StructField("replicate", LongType()), *[placed.schema[g] for g in group], *[StructField(v, DoubleType()) for v in values]]
    cells = placed.select("position", *group, *[F.col(v).cast("double") for v in values])
    if group:  # joined rows lie anywhere; a block's rows go to one task, which then draws for its own blocks only
        cells = cells.repartition(F.expr(f"position div {BLOCK}")).sortWithinPartitions("position")
    parts = cells.mapInPandas(work, StructType(fields))
    return parts.groupBy("replicate", *group).agg(*[F.sum(v).alias(v) for v in values])


def _checked(draws: str) -> str:
    if draws not in ("slots", "split"):
        raise ValueError("draws are made by slots or by splitting")
    return draws


def _draws(df: DataFrame, clusters: int, n_boot: int, seed: int) -> DataFrame:
    """``replicate, position``: as many hashed cluster positions per replicate as there are clusters."""
    ids = df.sparkSession.range(n_boot * clusters)
    replicate, slot = F.floor(F.col("id") / clusters), F.col("id") % clusters
    placed = ids.select(replicate.alias("replicate"), slot.alias("slot"))
    draw = hash60(joined(F.lit(seed), F.col("replicate"), F.col("slot"))) % clusters
    return placed.select("replicate", draw.alias("position"))


def interval_positions(n_boot: int, ci: float) -> tuple[int, int]:
    """0-based places of both ends among the sorted replicates (fixed rule of the interval)."""
    alpha = 1 - ci
    return int((alpha / 2) * n_boot), int((1 - alpha / 2) * n_boot) - 1


def _sized(clusters: DataFrame, n: int) -> DataFrame:
    return F.broadcast(clusters) if n <= BROADCAST_CLUSTERS else clusters


def replicate_means(
    rows: DataFrame, cluster: str, values: list[str], n_boot: int, seed: int, draws: str = "slots"
) -> tuple[DataFrame, DataFrame, int]:
    """Means of each replicate, the cluster sums, and the number of clusters.

    A replicate's mean needs only sum and count of each drawn cluster, so rows shrink to
    one per cluster before anything is drawn. A null value fails the job.

    ``draws``: by ``slots``, a hashed position for each draw, which SQL can state and which makes a row per replicate
    and cluster; or by ``split``, the numbers of draws themselves, cut down a tree of positions, which makes
    a row per replicate and task. Both draw as many clusters as there are, with equal chances.
    """
    _checked(draws)
    key = F.col(cluster).cast("string")
    sums = rows.groupBy(key.alias("cluster")).agg(
        F.count("*").alias("n"), *[F.sum(gates.number(v, "a resampled value").cast("double")).alias(v) for v in values]
    )
    placed = with_position(sums, "cluster")
    clusters = placed.count()
    if clusters == 0:
        empty = placed.select(F.lit(0).cast("bigint").alias("replicate"), *[F.col(v) for v in values])
        return empty, placed, 0
    if draws == "split":
        pooled = _split_sums(placed, [], ["n", *values], clusters, n_boot, seed)
        return pooled.select("replicate", *[(F.col(v) / F.col("n")).alias(v) for v in values]), placed, clusters
    drawn = _draws(rows, clusters, n_boot, seed).join(_sized(placed.drop("cluster"), clusters), "position")
    means = drawn.groupBy("replicate").agg(*[(F.sum(v) / F.sum("n")).alias(v) for v in values])
    return means, placed, clusters


def cluster_bootstrap(
    rows: DataFrame, cluster: str, values: list[str], n_boot: int = 2000, ci: float = 0.95, seed: int = 42, draws: str = "slots",
) -> DataFrame:
    """``measure, estimate, low, high, n_rows, n_clusters, n_boot`` for the mean of each value column."""
    means, placed, clusters = replicate_means(rows, cluster, values, n_boot, seed, draws)
    low, high = interval_positions(n_boot, ci)
    # n_boot numbers per measure: a fixed size, whatever the data.
    ordered = means.agg(F.struct(*[F.sort_array(F.collect_list(v)).alias(v) for v in values]).alias("sorted"))
    whole = placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), *[F.try_divide(F.sum(v), F.sum("n")).alias(v) for v in values]
    ).withColumn("_sorted", ordered.scalar())
    at = lambda v, i: F.get(F.col("_sorted")[v], F.lit(i))
    cells = [
        F.struct(
            F.lit(v).alias("measure"), F.col(v).alias("estimate"), at(v, low).alias("low"), at(v, high).alias("high"),
            F.col("_n").alias("n_rows"),
        )
        for v in values
    ]
    report = whole.select(F.inline(F.array(*cells)))
    return report.withColumn("n_clusters", F.lit(clusters).cast("bigint")).withColumn(
        "n_boot", F.lit(n_boot).cast("bigint")
    )


def cluster_bootstrap_statistic(
    rows: DataFrame, cluster: str, group: list[str], sums: list[str],
    statistic: Callable[[DataFrame], DataFrame], n_boot: int = 2000, ci: float = 0.95, seed: int = 42, draws: str = "slots",
) -> DataFrame:
    """Interval of a statistic that is not a mean but follows from sums per ``group``.

    ``statistic`` takes ``replicate, <group>, <sums>`` and returns ``replicate, estimate``.
    Rows shrink to sums per cluster and group; a replicate adds them as often as each
    cluster was drawn (``draws`` as in ``replicate_means``; with ``split`` a task
    holds ``n_boot`` sums per group). A null among the sums fails the job.
    """
    _checked(draws)
    key = F.col(cluster).cast("string")
    parts = rows.groupBy(key.alias("cluster"), *group).agg(*[F.sum(gates.number(s, "a resampled value").cast("double")).alias(s) for s in sums])
    placed = with_position(parts.select("cluster").distinct(), "cluster")
    clusters = placed.count()
    located = parts.join(placed, "cluster")
    if draws == "split":
        pooled = _split_sums(located, group, sums, clusters, n_boot, seed)
    else:
        # a draw is added where it meets its cluster; counting draws per position first would hold nearly all of them
        drawn = _draws(rows, clusters, n_boot, seed).join(located.drop("cluster"), "position")
        pooled = drawn.groupBy("replicate", *group).agg(*[F.sum(s).alias(s) for s in sums])
    whole = parts.groupBy(*group).agg(*[F.sum(s).alias(s) for s in sums]).withColumn("replicate", F.lit(-1).cast("bigint"))
    low, high = interval_positions(n_boot, ci)
    ordered = statistic(pooled).agg(F.sort_array(F.collect_list("estimate")).alias("e"))
    estimate = statistic(whole).select("estimate")
    return ordered.select(
        estimate.scalar().alias("estimate"), F.get("e", F.lit(low)).alias("low"), F.get("e", F.lit(high)).alias("high"),
        F.lit(clusters).cast("bigint").alias("n_clusters"), F.lit(n_boot).cast("bigint").alias("n_boot"),
    )
