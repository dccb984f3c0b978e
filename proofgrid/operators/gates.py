"""Gates: a DataFrame of violations, and one place that turns violations into a failed job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A gate found violations."""


def enforce(violations: DataFrame, message: str) -> None:
    """Fail with at most three examples if there is any violation."""
    examples = violations.limit(3).collect()
    if examples:
        raise GateError(f"{message}: {[r.asDict(True) for r in examples]}")


def require(condition: Column, value: Column, message: str) -> Column:
    """``value``, or a failed job from inside the plan where ``condition`` does not hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def wrong_revision(records: DataFrame, file: str, revision: str, expected: str) -> DataFrame:
    """Files with any revision but the expected one."""
    per_file = records.groupBy(file, revision).agg(F.count("*").alias("rows"))
    return per_file.filter(~F.col(revision).eqNullSafe(F.lit(expected)))


def pinned_mismatch(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Report fields (``field, value``) that differ from the pinned values or lack one."""
    pinned = expected.withColumnRenamed("value", "expected")
    both = report.join(pinned, "field", "right")
    return both.filter(~F.col("value").eqNullSafe(F.col("expected")))


def long_report(report: DataFrame) -> DataFrame:
    """A one-row report as ``field, value`` rows."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in report.columns]
    return report.select(F.inline(F.array(*cells)))


def shared_ids(assigned: DataFrame, key: str, partition: str) -> DataFrame:
    """Ids in more than one partition; two extremes replace a distinct count."""
    sides = assigned.groupBy(key).agg(F.min(partition).alias("first"), F.max(partition).alias("last"))
    return sides.filter(F.col("first") != F.col("last"))


def unknown_ids(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def split_membership(partitions: dict[str, DataFrame], known: DataFrame, key: str) -> DataFrame:
    """Where each id stands: ``<key>``, a flag per partition, and ``known``.

    All tables are read as ids with one bit each; one shuffle ors the bits, so copies of an id shrink before it.
    """
    sides = {**partitions, "known": known}
    bits = [df.select(F.col(key), F.lit(1 << i).alias("_bit")) for i, df in enumerate(sides.values())]
    masks = reduce(DataFrame.unionByName, bits).groupBy(key).agg(F.bit_or("_bit").alias("_mask"))
    return masks.select(key, *[(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(sides)])


def split_audit(partitions: dict[str, DataFrame], known: DataFrame, key: str) -> DataFrame:
    """One row: ids per partition, ids that two partitions share, ids unknown to ``known``, known ids lost from all partitions."""
    names = list(partitions)
    places = split_membership(partitions, known, key)
    anywhere = reduce(lambda a, b: a | b, [F.col(n) for n in names])
    cells = [F.count_if(F.col(n)).alias(f"{n}_ids") for n in names]
    cells += [F.count_if(F.col(a) & F.col(b)).alias(f"shared_{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    return places.agg(*cells, F.count_if(anywhere & ~F.col("known")).alias("unknown_ids"), F.count_if(F.col("known") & ~anywhere).alias("lost_ids"))


def enforce_split(report: DataFrame) -> dict:
    """The row of ``split_audit``; fails if partitions share ids or hold unknown ones. Lost ids are reported only."""
    row = report.first().asDict()
    wrong = {k: v for k, v in row.items() if v and (k.startswith("shared_") or k == "unknown_ids")}
    if wrong:
        raise GateError(f"the split leaks or holds unknown ids: {wrong}")
    return row


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def unmatched(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` without a partner."""
    return wanted.join(present.select(key), key, "left_anti")


def one_sided_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table that the other lacks, as one aggregate instead of a full join."""
    sides = a.select(key, F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(
        b.select(key, F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    )
    seen = sides.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return seen.filter(~(F.col("in_a") & F.col("in_b")))


def outside_unit_interval(df: DataFrame, column: str) -> DataFrame:
    """Rows without a number in [0, 1]; null and NaN are outside."""
    c = F.col(column).cast("double")
    return df.filter(c.isNull() | F.isnan(c) | (c < 0) | (c > 1))


def number(df_column: str, what: str) -> Column:
    """A column as it is, or a failed job from inside the plan where it is null."""
    c = F.col(df_column)
    return require(c.isNotNull(), c, f"{what} must not be null")


def single_class(df: DataFrame, label: str) -> DataFrame:
    """One row if the labels do not hold both classes."""
    ends = df.agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return ends.filter(F.col("low").isNull() | (F.col("low") == F.col("high")))


def missing_metadata(maps: DataFrame, required: list[str], metadata: str = "metadata") -> DataFrame:
    """Maps whose metadata lacks a required key, with the missing keys."""
    wanted = F.array(*[F.lit(k) for k in sorted(required)])
    absent = F.array_except(wanted, F.map_keys(metadata))
    return maps.withColumn("missing_keys", absent).filter(F.size("missing_keys") > 0)


def wrong_shape(maps: DataFrame, values: str, height: str, width: str) -> DataFrame:
    return maps.filter(F.size(values) != F.col(height) * F.col(width))


def changed_provenance(current: DataFrame, stored: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Stored rows whose provenance fields differ from a re-run; nulls equal nulls."""
    old = stored.select(*key, *[F.col(f).alias(f"stored_{f}") for f in fields])
    same = reduce(lambda a, f: a & F.col(f).eqNullSafe(F.col(f"stored_{f}")), fields, F.lit(True))
    return current.join(old, key).filter(~same)


def compared_hashes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Every recorded or present file with ``state``: ``same``, ``changed``, ``gone`` or ``new``."""
    now = current.select("path", F.col("sha256").alias("current_sha256"))
    both = recorded.select("path", "sha256").join(now, "path", "full_outer")
    state = (
        F.when(F.col("sha256").isNull(), "new").when(F.col("current_sha256").isNull(), "gone")
        .when(F.col("sha256") != F.col("current_sha256"), "changed").otherwise("same")
    )
    return both.withColumn("state", state)


def changed_hashes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Files that are gone or whose sha256 is not the recorded one."""
    now = current.select("path", F.col("sha256").alias("current_sha256"))
    both = recorded.join(now, "path", "left")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("current_sha256")))
