"""Saliency maps on a patch grid: validation, patch masks, random maps, agreement.

A map is an array in one row, so ranking its patches is an array sort inside the row and
needs no shuffle. What is the same for all patches goes into the lambdas as an array of
equal values: Spark would evaluate an expression inside a lambda again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.keys import hash60

# The smallest range and side a valid map may have.
MIN_RANGE = 1e-12
MIN_SIDE = 2


def invalid_reason(values: Column, height: Column, width: Column) -> Column:
    """Why a map is unusable, or null."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    flat = (F.array_max(values) - F.array_min(values)).cast("double") <= MIN_RANGE
    return (
        F.when((F.least(height, width) < MIN_SIDE) | (F.size(values) != height * width), "shape")
        .when(~F.forall(values, finite), "non-finite")
        .when(flat, "constant")
    )


def _for_each(values: Column, constant: Column) -> Column:
    return F.array_repeat(constant, F.size(values))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the lambdas inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised_map(values: Column) -> Column:
    """Min-max scaled values in single precision."""
    low, high = F.array_min(values).alias("low"), F.array_max(values).alias("high")
    ends = _for_each(values, F.struct(low, high))
    return F.zip_with(values, ends, lambda v, e: ((v - e["low"]) / (e["high"] - e["low"])).cast("float"))


def validate(maps: DataFrame, values: str = "raw", height: str = "height", width: str = "width") -> tuple[DataFrame, DataFrame]:
    """Valid maps with ``normalised``, and the excluded maps with their reason."""
    judged = maps.withColumn("reason", invalid_reason(F.col(values), F.col(height), F.col(width)))
    valid = judged.filter("reason is null").drop("reason").withColumn("normalised", normalised_map(F.col(values)))
    return valid, judged.filter("reason is not null")


def mask_size(values: Column, fraction: Column) -> Column:
    """Half-even share of the patches, at least one."""
    return F.greatest(F.lit(1), F.rint(F.size(values) * fraction).cast("int"))


def ranked_patches(values: Column) -> Column:
    """Patch numbers from least to most salient; equal values in patch order."""
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.sort_array(pairs), lambda p: p["i"])


def _draws(values: Column, seed: Column, digits) -> Column:
    text = _for_each(values, F.concat(seed.cast("string"), F.lit("|")))
    return F.transform(text, lambda t, i: digits(F.concat(t, i.cast("string")), i))


def shuffled_patches(values: Column, seed: Column) -> Column:
    """Patch numbers in an order that only the seed decides: that of ``hash60`` of seed and number.

    The hex digits sort like the number they stand for.
    """
    pair = lambda text, i: F.struct(_hex(text).alias("h"), i.alias("i"))
    return F.transform(F.sort_array(_draws(values, seed, pair)), lambda p: p["i"])


def _hex(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 15)


def random_mask(values: Column, seed: Column, size: Column) -> Column:
    """The first ``size`` of ``shuffled_patches`` in ascending order.

    They are the patches whose hash is at most that of the last of them, so bare hashes are sorted, which is much
    quicker than pairs. Only if equal hashes lie on both sides of the cut do patch numbers decide, and pairs are sorted.
    """
    up_to = lambda h, last: F.filter(F.transform(h, lambda x, i: F.when(x <= last, i)), lambda i: i.isNotNull())
    chosen = lambda h: bound(F.get(F.sort_array(h), size - 1), lambda last: up_to(h, last))
    by_pairs = F.sort_array(F.slice(shuffled_patches(values, seed), 1, size))
    hashes = _draws(values, seed, lambda text, i: _hex(text))
    return bound(bound(hashes, chosen), lambda mask: F.when(F.size(mask) == size, mask).otherwise(by_pairs))


def patch_mask(ranked: Column, shuffled: Column, mode: Column, patches: Column, size: Column) -> Column:
    """The masked patch numbers in ascending order: most salient, least salient or random."""
    start = F.when(mode == "targeted", patches - size + 1).otherwise(1)
    order = F.when(mode == "random", shuffled).when(mode.isin("targeted", "least_salient"), ranked)
    return F.sort_array(F.slice(order, start, size))


def random_map(values: Column, seed: Column) -> Column:
    """Uniform values in [0, 1) for every patch."""
    return _draws(values, seed, lambda text, i: hash60(text) / F.lit(float(2**60)))


def overlap(mask: Column, region: Column) -> Column:
    """Intersection over union of two patch sets."""
    return F.try_divide(F.size(F.array_intersect(mask, region)), F.size(F.array_union(mask, region))).cast("double")


def pointing_hit(ranked: Column, region: Column) -> Column:
    """Whether the most salient patch lies in the region."""
    return F.array_contains(region, F.element_at(ranked, -1)).cast("double")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of equal length; null if one is constant."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    da = _centred(a)
    db = _centred(b)
    cross = total(F.zip_with(da, db, lambda x, y: x * y))
    return F.try_divide(cross, F.sqrt(total(_squares(da)) * total(_squares(db))))


def _centred(c: Column) -> Column:
    doubles = F.transform(c, lambda x: x.cast("double"))
    mean = F.try_divide(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x), F.size(c).cast("double"))
    return F.zip_with(doubles, _for_each(c, mean), lambda x, m: x - m)


def _squares(c: Column) -> Column:
    return F.transform(c, lambda x: x * x)


def map_stability(maps: DataFrame, key: list[str], repeat: str, values: str) -> DataFrame:
    """Correlation of each repeat of a map with its first repeat."""
    first = maps.filter(F.col(repeat) == 0).select(*key, F.col(values).alias("_first"))
    later = maps.filter(F.col(repeat) > 0)
    return later.join(first, key).select(*key, repeat, correlation(F.col(values), F.col("_first")).alias("correlation"))
