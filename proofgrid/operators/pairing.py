"""Control images and paired comparisons of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.operators import gates
from proofgrid.operators.ranking import with_position


def shifted_sources(rows: DataFrame, source: str, image: str, order: list[Column]) -> DataFrame:
    """``source, shifted_image``: each source gets the image of the next one in sorted order, the last of the first."""
    own = rows.groupBy(source).agg(F.min_by(image, F.struct(*order)).alias(image))
    ranked = with_position(own, source)
    n = ranked.count()
    if n < 2:
        raise ValueError("one source alone has no other to swap images with")
    following = ranked.select(F.pmod(F.col("position") - 1, F.lit(n)).alias("position"), F.col(image).alias("shifted_image"))
    return ranked.join(following, "position").select(source, "shifted_image")


def control_images(rows: DataFrame, source: str, image: str, constant: str, order: list[Column]) -> DataFrame:
    """Each row three times: with its own, a constant and another source's image."""
    shifted = rows.join(shifted_sources(rows, source, image, order), source)
    as_ = lambda name, c: F.struct(F.lit(name).alias("image_mode"), c.alias("evaluated_image"))
    modes = F.array(
        as_("paired", F.col(image)), as_("constant", F.lit(constant)), as_("shuffled", F.col("shifted_image"))
    )
    return shifted.select(*rows.columns, F.inline(modes))


def with_predictions(subset: DataFrame, predictions: DataFrame, key: str = "item_id") -> DataFrame:
    """Inner join after the gates: prediction keys are unique and every subset item has one."""
    gates.enforce(gates.repeated_keys(predictions, key), "duplicate item ids in predictions")
    gates.enforce(gates.unmatched(subset, predictions, key), "items without a saved prediction")
    return subset.join(predictions, key)


def paired_differences(
    scored: DataFrame, condition: str, a: str, b: str, metrics: list[str], key: str = "item_id", source: str = "source"
) -> DataFrame:
    """Per item: metric under ``a`` minus metric under ``b``, for all metrics in one aggregate.

    A key that lacks one side fails the job from inside the plan.
    """
    two = scored.filter(F.col(condition).isin(a, b))
    side = lambda c, m: F.max(F.when(F.col(condition) == c, F.col(m)))
    count = lambda c: F.count_if(F.col(condition) == c)
    grouped = two.groupBy(key).agg(
        F.max(source).alias(source), count(a).alias("_a"), count(b).alias("_b"),
        *[(side(a, m) - side(b, m)).alias(f"{m}_difference") for m in metrics],
    )
    complete = (F.col("_a") == 1) & (F.col("_b") == 1)
    checked = gates.require(complete, F.col(key), "an item lacks one of the two conditions or has one twice")
    return grouped.withColumn(key, checked).drop("_a", "_b")
