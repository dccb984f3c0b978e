"""Reliability, rater and human-study measures; each is a plain aggregate."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.keys import hash60, joined
from proofgrid.session import stored

SHIFT = 10  # the series below start this far up, where they are exact to the last digits
# Coefficients of the asymptotic series, by power of 1 / x.
DIGAMMA = {1: -1 / 2, 2: -1 / 12, 4: 1 / 120, 6: -1 / 252, 8: 1 / 240, 10: -1 / 132}
TRIGAMMA = {1: 1.0, 2: 1 / 2, 3: 1 / 6, 5: -1 / 30, 7: 1 / 42, 9: -1 / 30, 11: 5 / 66}
NEWTON_STEPS, SETTLED = 60, 1e-11


def fold_reliability(rows: DataFrame, group: str, fold: str, correct: str) -> DataFrame:
    """Accuracy of each class as seen from outside each fold."""
    parts = rows.groupBy(group, fold).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("double")).alias("k"))
    whole = Window.partitionBy(group)  # one row per fold
    n, k = F.sum("n").over(whole) - F.col("n"), F.sum("k").over(whole) - F.col("k")
    return parts.select(group, fold, n.alias("n_outside"), F.try_divide(k, n).alias("reliability"))


def shrunken_reliability(rows: DataFrame, group: str, answer: str, correct: str, strength: float) -> DataFrame:
    """``(k + a m) / (n + a)`` per class and answer, where m is the mean of the class."""
    parts = rows.groupBy(group, answer).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("double")).alias("k"))
    classes = parts.groupBy(group).agg((F.sum("k") / F.sum("n")).alias("class_mean"))
    shrunk = (F.col("k") + strength * F.col("class_mean")) / (F.col("n") + strength)
    return parts.join(classes, group).select(group, answer, "n", "class_mean", shrunk.alias("reliability"))


def digamma(x: Column) -> Column:
    """Derivative of the logarithm of the gamma function, for x above 0."""
    y = x + SHIFT
    return F.log(y) + reduce(add, [c / F.pow(y, F.lit(p)) for p, c in DIGAMMA.items()]) - reduce(add, [1 / (x + i) for i in range(SHIFT)])


def trigamma(x: Column) -> Column:
    """Derivative of ``digamma``, for x above 0."""
    y = x + SHIFT
    return reduce(add, [c / F.pow(y, F.lit(p)) for p, c in TRIGAMMA.items()]) + reduce(add, [1 / ((x + i) * (x + i)) for i in range(SHIFT)])


def beta_binomial(units: DataFrame, group: str) -> DataFrame:
    """``<group>, units, kind, class_mean, strength`` by maximum likelihood; ``units`` has ``<group>, n, k`` per answer.

    A class's answers have reliabilities from a beta distribution with ``class_mean`` and ``strength`` (the number of
    observations the prior is worth), and k of n trials each. Answers with equal (n, k) are counted first, so
    each Newton step is one aggregate over that histogram, for all classes at once. Steps are taken in the
    logarithms of both beta parameters, at most a factor e each; where the curvature does not fit, a fixed-point
    step that always climbs takes the place.

    Where the likelihood has no peak inside, ``kind`` says what holds: ``constant`` (all right or all wrong; the mean is 1 or
    0), ``pooled`` (answers differ no more than chance lets them, as with one answer or one trial each; strength
    null for infinite, the mean is the pooled one), ``separate`` (each answer is always right or always
    wrong; strength 0, the mean is the share of right ones). The others are ``fitted``. Answers without trials do not count.
    """
    k, n, w = F.col("k").cast("double"), F.col("n").cast("double"), F.col("w").cast("double")
    counted = units.filter("n > 0").groupBy(group, F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")).agg(F.count("*").alias("w"))
    histogram = stored(counted, "beta-histogram")
    pooled = histogram.groupBy(group).agg(F.sum(w * k).alias("right"), F.sum(w * n).alias("trials"))
    m = F.col("right") / F.col("trials")
    # the slope of the likelihood where strength is infinite
    spread = F.sum(w * (k * (k - 1) / m + (n - k) * (n - k - 1) / (1 - m) - n * (n - 1)))
    constant = (F.col("right") == 0) | (F.col("right") == F.col("trials"))
    met = _same(histogram, pooled, group)
    inner = met.filter(~constant).groupBy(group).agg(
        spread.alias("spread"), F.bool_and((F.col("k") == 0) | (F.col("k") == F.col("n"))).alias("split"),
        (F.sum(F.when(F.col("k") > 0, F.col("w"))) / F.sum("w")).alias("share"),
    )
    sizes = histogram.groupBy(group).agg(F.sum("w").alias("units"), F.sum(w * k).alias("right"), F.sum(w * n).alias("trials"))
    kind = (
        F.when(constant, "constant").when(F.coalesce("spread", F.lit(0.0)) <= 1e-9 * F.col("trials"), "pooled")
        .when(F.col("split"), "separate").otherwise("fitted")
    )
    known = stored(_same(sizes, inner, group, "left").select(group, "units", m.alias("_m"), "share", kind.alias("kind")), "beta-classes")
    fitted = _newton(histogram, known.filter("kind = 'fitted'").select(group, (2 * F.col("_m")).alias("a"), (2 * (1 - F.col("_m"))).alias("b")), group)
    mean = F.when(F.col("kind") == "fitted", F.col("a") / (F.col("a") + F.col("b"))).when(F.col("kind") == "separate", F.col("share")).otherwise(F.col("_m"))
    strength = F.when(F.col("kind") == "fitted", F.col("a") + F.col("b")).when(F.col("kind") == "separate", 0.0)
    return _same(known, fitted, group, "left").select(group, "units", "kind", mean.alias("class_mean"), strength.alias("strength"))


def _same(left: DataFrame, right: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """Joined on the group, where null is a group like others."""
    other = right.withColumnRenamed(group, "_group")
    return left.join(other, left[group].eqNullSafe(other["_group"]), how).drop("_group")


def _newton(histogram: DataFrame, start: DataFrame, group: str) -> DataFrame:
    """Both beta parameters ``a, b`` of each class, from ``start``."""
    a, b, n, k, w = (F.col(c).cast("double") for c in ("a", "b", "n", "k", "w"))
    s = a + b
    now = stored(start.withColumn("moved", F.lit(1.0)), "beta-step")
    for _ in range(NEWTON_STEPS):
        if (now.agg(F.max("moved")).first()[0] or 0.0) < SETTLED:
            break
        sums = _same(histogram, now.drop("moved"), group).groupBy(group).agg(
            F.first("a").alias("a"), F.first("b").alias("b"),
            F.sum(w * (digamma(a + k) - digamma(a))).alias("ga"), F.sum(w * (digamma(b + n - k) - digamma(b))).alias("gb"),
            F.sum(w * (digamma(s + n) - digamma(s))).alias("g"), F.sum(w * (trigamma(a + k) - trigamma(a))).alias("qa"),
            F.sum(w * (trigamma(b + n - k) - trigamma(b))).alias("qb"), F.sum(w * (trigamma(s) - trigamma(s + n))).alias("z"),
        )
        slopes = sums.select("*", (a * (F.col("ga") - F.col("g"))).alias("sa"), (b * (F.col("gb") - F.col("g"))).alias("sb"))
        curves = slopes.select(
            "*", (a * a * (F.col("qa") + F.col("z")) + F.col("sa")).alias("ca"), (b * b * (F.col("qb") + F.col("z")) + F.col("sb")).alias("cb"),
            (a * b * F.col("z")).alias("cab"),
        )
        sa, sb, ca, cb, cab = (F.col(c) for c in ("sa", "sb", "ca", "cb", "cab"))
        det = ca * cb - cab * cab
        peaked = (ca < 0) & (det > 0)
        step = lambda newton, fixed: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(peaked, newton / det).otherwise(F.log(F.col(fixed) / F.col("g")))))
        moved = curves.select(group, "a", "b", step(cab * sb - cb * sa, "ga").alias("da"), step(cab * sa - ca * sb, "gb").alias("db"))
        now = stored(moved.select(group, (a * F.exp("da")).alias("a"), (b * F.exp("db")).alias("b"), F.greatest(F.abs("da"), F.abs("db")).alias("moved")), "beta-step")
    return now.drop("moved")


def fitted_reliability(rows: DataFrame, group: str, answer: str, correct: str) -> DataFrame:
    """Reliability per class and answer, drawn towards the class as far as the answers of that class suggest.

    Mean and strength come from ``beta_binomial``; an answer's reliability is ``(k + s m) / (n + s)``, the mean itself
    where strength is infinite. A null in ``correct`` counts as no trial.
    """
    parts = rows.groupBy(group, answer).agg(F.count(correct).alias("n"), F.coalesce(F.sum(F.col(correct).cast("double")), F.lit(0.0)).alias("k"))
    classes = beta_binomial(parts, group)
    m, s = F.col("class_mean"), F.col("strength")
    shrunk = F.when(s.isNull(), m).when(F.col("n") + s > 0, (F.col("k") + s * m) / (F.col("n") + s))
    met = _same(parts, classes, group)
    return met.select(group, answer, "n", "kind", "class_mean", "strength", shrunk.alias("reliability"))


def answer_changes(original: DataFrame, regenerated: DataFrame, key: list[str]) -> DataFrame:
    """Flip of the normalised answer and change of correctness; both sides have ``answer, correct``."""
    again = regenerated.select(*key, F.col("answer").alias("_answer"), F.col("correct").alias("_correct"))
    return original.join(again, key).select(
        *key, (F.col("answer") != F.col("_answer")).cast("double").alias("flip"),
        (F.col("_correct") - F.col("correct")).alias("correctness_change"),
    )


def stratified_examples(rows: DataFrame, stratum: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    """The first rows of each stratum in hash order; Spark cuts each task to that many before it shuffles."""
    order = Window.partitionBy(stratum).orderBy(hash60(joined(F.lit(seed), F.col(key))), key)
    return rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= per_stratum)


def classification_quality(rows: DataFrame, group: list[str], truth: Column, guess: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 of a binary decision per group, such as condition and question type."""
    counts = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return counts.select(
        *group, "n", ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def answer_entropy(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """Entropy and disagreement of the answers that repeats gave to one item."""
    counts = rows.groupBy(key, answer).agg(F.count("*").alias("c"))
    # -sum(p ln p) = ln n - sum(c ln c) / n needs no second look at the counts
    sums = counts.groupBy(key).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c"))).alias("clogc"), F.max("c").alias("top"),
        F.count("*").alias("answers"),
    )
    return sums.select(
        key, "answers", (F.log("n") - F.col("clogc") / F.col("n")).alias("entropy"),
        (1 - F.col("top") / F.col("n")).alias("disagreement"),
    )


def detection_rates(rows: DataFrame, condition: str, wrong: Column, flagged: Column) -> DataFrame:
    """Share of the model's errors that people flagged, per condition."""
    return rows.filter(wrong).groupBy(condition).agg(
        F.count("*").alias("errors"), F.avg(flagged.cast("double")).alias("detection_rate")
    )


def detection_difference(rates: DataFrame, condition: str, a: str, b: str) -> DataFrame:
    at = lambda c: F.max(F.when(F.col(condition) == c, F.col("detection_rate")))
    return rates.agg(at(a).alias("first_rate"), at(b).alias("second_rate"), (at(a) - at(b)).alias("difference"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    marks = cells.select(F.inline(F.array(
        F.struct(F.col("a").alias("mark"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"),
                 F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("agree")),
        F.struct(F.col("b").alias("mark"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"),
                 F.lit(0).cast("bigint").alias("agree")),
    )))
    sides = marks.groupBy("mark").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("agree").alias("agree"))
    n = F.col("n").cast("double")
    sums = sides.agg(
        F.sum("na").alias("n"), F.sum("agree").alias("agree"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"),
    )
    observed, chance = F.col("agree") / n, F.col("chance") / (n * n)
    return sums.select(
        "n", observed.alias("observed"), chance.alias("expected"),
        F.try_divide(observed - chance, 1 - chance).alias("kappa"),
    )


def contradictions(traces: DataFrame, case: str, attribute: str, value: str) -> DataFrame:
    """Per case: attributes in all, and attributes whose trace fields disagree."""
    ends = traces.groupBy(case, attribute).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.groupBy(case).agg(
        F.count("*").alias("attributes"), F.count_if(F.col("low") != F.col("high")).alias("contradictions")
    )


def leakage_inflation(rows: DataFrame, seen: str, metric: str) -> DataFrame:
    """Mean metric over sources that training saw minus the mean over unseen ones."""
    return rows.agg(
        F.count_if(F.col(seen)).alias("seen_rows"), F.count_if(~F.col(seen)).alias("unseen_rows"),
        F.avg(F.when(F.col(seen), F.col(metric))).alias("seen_mean"),
        F.avg(F.when(~F.col(seen), F.col(metric))).alias("unseen_mean"),
    ).withColumn("inflation", F.col("seen_mean") - F.col("unseen_mean"))
