"""Dataset audits and split-overlap audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions import keys
from proofgrid.operators.dedupe import KEY, PAIR
from proofgrid.sources.files import stored_table

SKETCH_BITS = 12  # a sketch holds up to 4096 hashes: distinct counts up to there are exact
SKETCH_ERROR = 3 / 2 ** (SKETCH_BITS / 2)  # three standard errors of a larger count, as a share of it
_LEVELS = {"sources": ("source",), "pairs": tuple(PAIR), "triples": tuple(KEY)}


def dataset_audit(rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row: total, distinct sources, repeated exact triples, missing images, mean answer words.

    ``rows`` has the key columns, ``answer`` and ``image``. Grouping by triple, then by
    source, then over all gives the distinct counts without multiplying rows.
    """
    triples = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(keys.word_count(F.col("answer"))).alias("words"))
    sources = triples.groupBy("source").agg(
        F.sum("n").alias("n"), F.count("*").alias("triples"), F.sum("words").alias("words")
    )
    report = sources.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("unique_source_images"),
        F.coalesce(F.sum(F.col("n") - F.col("triples")), F.lit(0)).alias("repeated_exact_qa_pairs"),
        F.coalesce(F.try_divide(F.sum("words"), F.sum("n")), F.lit(0.0)).alias("mean_answer_words"),
    )
    if images is None:
        return report
    absent = missing_images(rows, images).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("missing"))
    return report.withColumn("missing_images", absent.scalar())


def missing_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Image paths that no file has, with how many rows name each."""
    named = rows.groupBy("image").agg(F.count("*").alias("rows"))
    return named.join(images.select(F.col("path").alias("image")).distinct(), "image", "left_anti")


def value_counts(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(keys.stratum_text(key).alias("value")).agg(F.count("*").alias("rows"))


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """Counts of list members; rows without labels add nothing."""
    return value_counts(df.select(F.explode(labels).alias("label")), F.col("label"))


def span(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.agg(F.min(low).alias("first"), F.max(high).alias("last"), F.count("*").alias("rows"))


def overlap_audit(rows: DataFrame, in_train: Column, in_test: Column) -> DataFrame:
    """What two splits share: sources, (source, question) pairs and whole triples, from one scan.

    Each level is grouped from the one below it, so the data shrinks at every shuffle.
    """
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    both = (F.col("train") * F.col("test")).alias("both")
    triples = rows.groupBy(*KEY).agg(
        F.count_if(in_train).alias("train_rows"), F.count_if(in_test).alias("test_rows"),
        flag(in_train).alias("train"), flag(in_test).alias("test"),
    ).withColumn("triples", both)
    carry = lambda *names: [F.sum(n).alias(n) for n in names]
    sides = [F.max("train").alias("train"), F.max("test").alias("test")]
    pairs = triples.groupBy(*PAIR).agg(*carry("train_rows", "test_rows", "triples"), *sides).withColumn("pairs", both)
    sources = pairs.groupBy("source").agg(*carry("train_rows", "test_rows", "triples", "pairs"), *sides)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sources.agg(
        total("train_rows").alias("train_rows"),
        total("test_rows").alias("test_rows"),
        total("train").alias("train_source_images"),
        total("test").alias("test_source_images"),
        total(both).alias("overlapping_source_images"),
        total("pairs").alias("overlapping_image_question_pairs"),
        total("triples").alias("overlapping_image_question_answer_triples"),
    ).withColumn(
        "test_image_overlap_fraction",
        F.try_divide(F.col("overlapping_source_images"), F.col("test_source_images")).cast("double"),
    )


def file_sketches(rows: DataFrame, file: str) -> DataFrame:
    """Per file: rows, answer words, and theta sketches of its sources, pairs and triples.

    A sketch has a fixed size, so a file of any size becomes one small row, from partial aggregates. Sketches of
    different files merge without a second look at the rows.
    """
    sketches = [F.theta_sketch_agg(F.xxhash64(*columns), SKETCH_BITS).alias(name) for name, columns in _LEVELS.items()]
    words = F.coalesce(F.sum(keys.word_count(F.col("answer"))), F.lit(0)).alias("words")
    return rows.groupBy(file).agg(F.count("*").alias("rows"), words, *sketches)


def sketch_new_files(spark: SparkSession, read: Callable[[list[str]], DataFrame], paths: list[str], file: str, store: str) -> DataFrame:
    """Sketches of all files, kept in the folder ``store``; only files that it does not hold are read.

    ``read`` takes paths and returns their rows with the column ``file``, the path. A file is known by its path, so a
    changed file needs a new name. A file without rows leaves no sketch and is looked at again next time.
    """
    held = stored_table(spark, store)
    # as many names as the scan lists, which the driver holds anyway
    known = set() if held is None else {r[0] for r in held.select(file).collect()}
    new = sorted(set(paths) - known)
    if new:
        file_sketches(read(new), file).write.mode("append").parquet(store)
    return stored_table(spark, store)


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def sketched_audit(sketches: DataFrame) -> DataFrame:
    """``dataset_audit`` from sketches: totals are exact, distinct counts within ``SKETCH_ERROR`` in 997 cases of 1000."""
    merged = sketches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), F.coalesce(F.try_divide(F.sum("words"), F.sum("rows")), F.lit(0.0)).alias("mean_answer_words"),
        F.theta_union_agg("sources").alias("sources"), F.theta_union_agg("triples").alias("triples"),
    )
    repeated = F.greatest(F.col("total") - _estimate(F.col("triples")), F.lit(0))
    return merged.select("total", _estimate(F.col("sources")).alias("unique_source_images"), repeated.alias("repeated_exact_qa_pairs"), "mean_answer_words")


def sketched_overlap(sketches: DataFrame, in_train: Column, in_test: Column) -> DataFrame:
    """What two sets of files share, from their sketches; off by at most ``SKETCH_ERROR`` of the sets' union in 997 cases of 1000."""
    side = lambda level, inside, name: F.theta_union_agg(F.when(inside, F.col(level))).alias(f"{name}_{level}")
    merged = sketches.agg(
        F.coalesce(F.sum(F.when(in_train, F.col("rows"))), F.lit(0)).alias("train_rows"), F.coalesce(F.sum(F.when(in_test, F.col("rows"))), F.lit(0)).alias("test_rows"),
        *[side(level, inside, name) for level in _LEVELS for name, inside in (("train", in_train), ("test", in_test))],
    )
    shared = lambda level: _estimate(F.theta_intersection(f"train_{level}", f"test_{level}"))
    return merged.select(
        "train_rows", "test_rows", _estimate(F.col("train_sources")).alias("train_source_images"), _estimate(F.col("test_sources")).alias("test_source_images"),
        shared("sources").alias("overlapping_source_images"), shared("pairs").alias("overlapping_image_question_pairs"),
        shared("triples").alias("overlapping_image_question_answer_triples"),
    )


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared ids as a count and as a share of ``b``."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    ids = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    shared = F.sum(F.col("a") * F.col("b"))
    return ids.agg(
        F.sum("a").alias("first_ids"), F.sum("b").alias("second_ids"), shared.alias("shared_ids"),
        F.try_divide(shared, F.sum("b")).cast("double").alias("shared_fraction"),
    )


def subset_summary(df: DataFrame, value: str, conditions: dict[str, Column]) -> DataFrame:
    """Count and mean of one column over several subsets in one pass."""
    cells = []
    for name, keep in conditions.items():
        cells += [F.count_if(keep).alias(f"{name}_rows"), F.avg(F.when(keep, F.col(value))).alias(f"{name}_mean")]
    return df.agg(*cells)
