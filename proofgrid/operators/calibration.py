"""Calibration bins and summary, risk-coverage, threshold curves, logistic map."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.operators import gates
from proofgrid.operators.ranking import with_running_sums

COVERAGES = (0.25, 0.50, 0.75, 1.00)


def bin_index(confidence: Column, bins: int = 10) -> Column:
    """How many inner edges lie at or below the value; the edges are those of an even float grid."""
    edges = np.linspace(0.0, 1.0, bins + 1)[1:-1]
    passed = [F.when(confidence >= F.lit(float(e)), 1).otherwise(0) for e in edges]
    return sum(passed[1:], passed[0])


def _bin_sums(rows: DataFrame, confidence: str, label: str, bins: int) -> DataFrame:
    p, y = gates.number(confidence, "a confidence"), F.col(label).cast("double")
    return rows.groupBy(bin_index(p, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(p).alias("confidence"), F.sum(y).alias("correct"),
        F.sum((p - y) * (p - y)).alias("squares"),
    )


def calibration_bins(rows: DataFrame, confidence: str, label: str, bins: int = 10) -> DataFrame:
    """Non-empty bins with size, mean confidence and accuracy. A null confidence fails the job."""
    return _bin_sums(rows, confidence, label, bins).select(
        "bin", "n", (F.col("confidence") / F.col("n")).alias("mean_confidence"),
        (F.col("correct") / F.col("n")).alias("accuracy"),
    )


def calibration_summary(rows: DataFrame, confidence: str, label: str, bins: int = 10) -> DataFrame:
    """``n, accuracy, mean_confidence, brier_score, ece``; only n when there are no rows.

    A null confidence fails the job.
    """
    sums = _bin_sums(rows, confidence, label, bins)
    n = F.sum("n")
    return sums.agg(
        F.coalesce(n, F.lit(0)).alias("n"),
        F.try_divide(F.sum("correct"), n).alias("accuracy"),
        F.try_divide(F.sum("confidence"), n).alias("mean_confidence"),
        F.try_divide(F.sum("squares"), n).alias("brier_score"),
        F.try_divide(F.sum(F.abs(F.col("confidence") - F.col("correct"))), n).alias("ece"),
    )


def checked_summary(rows: DataFrame, confidence: str, label: str, bins: int = 10) -> DataFrame:
    """The summary after the range gate."""
    gates.enforce(gates.outside_unit_interval(rows, confidence), "confidences outside the unit interval")
    return calibration_summary(rows, confidence, label, bins)


def risk_coverage(rows: DataFrame, confidence: str, label: str, coverages=COVERAGES) -> DataFrame:
    """Accuracy and risk of the most confident share of rows; equal confidences take correct rows first.

    Rows are first counted per (confidence, label), so ties of any size are one row, and
    a share is cut inside a tie by arithmetic. No row gets a rank. A null confidence fails the job.
    """
    levels = rows.groupBy(gates.number(confidence, "a confidence").alias("p"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"))
    running = with_running_sums(levels, [F.desc("p"), F.desc("y")], ["n"])
    total = running.agg(F.sum("n").alias("total"))
    sized = running.withColumn("total", total.scalar())
    cells = []
    for i, share in enumerate(coverages):
        keep = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(share)))
        taken = F.least(F.col("n"), F.greatest(F.lit(0), keep - F.col("n_before")))
        cells += [F.max(keep).alias(f"k{i}"), F.sum(taken * F.col("y")).alias(f"c{i}")]
    sums = sized.agg(*cells)
    rows_out = [
        F.struct(
            F.lit(float(share)).alias("coverage"), F.col(f"k{i}").alias("n"),
            (F.col(f"c{i}") / F.col(f"k{i}")).alias("accuracy"),
            (1 - F.col(f"c{i}") / F.col(f"k{i}")).alias("risk"),
        )
        for i, share in enumerate(coverages)
    ]
    return sums.select(F.inline(F.array(*rows_out))).filter(F.col("n").isNotNull())


def _levels(rows: DataFrame, score: str, label: str) -> DataFrame:
    y = F.col(label).cast("int")
    return rows.groupBy(gates.number(score, "a score").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def ranking_quality(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``auroc`` (ties count half) and ``auprc`` (average precision), from counts per distinct score."""
    levels = with_running_sums(_levels(rows, score, label), [F.desc("score")], ["pos", "neg"])
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    sums = levels.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0)).alias("wins"),
        F.sum(F.col("pos") * F.try_divide(tp, tp + fp)).alias("precision_sum"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        "positives", "negatives", F.try_divide(F.col("wins"), pairs).alias("auroc"),
        F.try_divide(F.col("precision_sum"), F.col("positives").cast("double")).alias("auprc"),
    )


def selective_risk(rows: DataFrame, score: str, label: str, target: float) -> DataFrame:
    """The largest coverage of a score threshold whose empirical risk is at most ``target``."""
    levels = with_running_sums(_levels(rows, score, label), [F.desc("score")], ["pos", "neg"])
    kept = F.col("pos_before") + F.col("neg_before") + F.col("pos") + F.col("neg")
    curve = levels.select("score", kept.alias("kept"), (F.col("neg_before") + F.col("neg")).alias("errors"))
    total = curve.agg(F.max("kept"))
    allowed = curve.filter(F.col("errors") <= F.lit(target) * F.col("kept"))
    best = allowed.agg(F.max(F.struct("kept", "errors", "score")).alias("b"))
    return best.select(
        F.lit(float(target)).alias("target_risk"),
        F.coalesce(F.col("b.kept"), F.lit(0)).alias("kept"),
        F.col("b.score").alias("threshold"),
        F.coalesce(F.col("b.kept") / total.scalar(), F.lit(0.0)).alias("coverage"),
        (F.col("b.errors") / F.col("b.kept")).alias("risk"),
    )


def _polished(rows: DataFrame, coefficient: float, intercept: float) -> tuple[float, float]:
    """Newton steps from close by, one aggregate each, until they no longer change the numbers."""
    for _ in range(20):
        p = 1.0 / (1.0 + F.exp(-(F.lit(coefficient) * F.col("x") + F.lit(intercept))))
        w, x, miss = p * (1.0 - p), F.col("x"), p - F.col("label")
        row = rows.agg(F.sum(miss * x).alias("ga"), F.sum(miss).alias("gb"), F.sum(w * x * x).alias("aa"), F.sum(w * x).alias("ab"), F.sum(w).alias("bb")).first()
        ga, aa = row["ga"] + coefficient, row["aa"] + 1.0
        det = aa * row["bb"] - row["ab"] ** 2
        step = (row["bb"] * ga - row["ab"] * row["gb"]) / det, (aa * row["gb"] - row["ab"] * ga) / det
        coefficient, intercept = coefficient - step[0], intercept - step[1]
        if max(map(abs, step)) <= 1e-12 * (1 + abs(coefficient) + abs(intercept)):
            break
    return coefficient, intercept


def fit_logistic(development: DataFrame, logprob: str, label: str) -> tuple[float, float, int]:
    """Coefficient, intercept and rows of the logistic map from mean log probability to correctness.

    Unit L2 strength on the coefficient, free intercept. The fit of ``pyspark.ml`` stops at its
    tolerance; Newton steps take it to the last digits, so that any engine finds the same numbers.
    """
    gates.enforce(gates.single_class(development, label), "a logistic map needs right and wrong answers")
    rows = development.select(F.col(logprob).cast("double").alias("x"), F.col(label).cast("double").alias("label"))
    n = rows.count()
    features = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    learner = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200)
    model = learner.fit(features)
    return *_polished(rows, float(model.coefficients[0]), float(model.intercept)), n


def with_probability(rows: DataFrame, logprob: str, coefficient: float, intercept: float) -> DataFrame:
    """All columns plus ``calibrated_correctness_probability``."""
    line = F.lit(coefficient) * F.col(logprob) + F.lit(intercept)
    return rows.withColumn("calibrated_correctness_probability", 1.0 / (1.0 + F.exp(-line)))


def fit_and_evaluate(development: DataFrame, test: DataFrame, logprob: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The calibration report of ``test`` and its calibrated rows.

    The report is one row: summary, fitted numbers, ``bins`` and ``risk_coverage`` as arrays of fixed
    size. A probability that is null or outside [0, 1] fails the job.
    """
    coefficient, intercept, n = fit_logistic(development, logprob, label)
    rows = with_probability(test, logprob, coefficient, intercept)
    scored = "calibrated_correctness_probability"
    summary = checked_summary(rows, scored, label)
    nested = lambda part: part.agg(F.sort_array(F.collect_list(F.struct(*part.columns)))).scalar()
    return (
        summary.withColumn("bins", nested(calibration_bins(rows, scored, label)))
        .withColumn("risk_coverage", nested(risk_coverage(rows, scored, label)))
        .withColumn("development_n", F.lit(n))
        .withColumn("logistic_coefficient", F.lit(coefficient))
        .withColumn("logistic_intercept", F.lit(intercept)),
        rows,
    )
