"""Means and corpus BLEU by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import keys
from proofgrid.operators import textscore

BLEU_COUNTS = ["r1", *[f"{side}{n}" for n in range(1, textscore.BLEU_ORDER + 1) for side in ("m", "p")]]


def strata(complexity: Column, classes: Column) -> Column:
    """All strata of a row: overall, its complexity, each of its classes."""
    stratum = lambda kind, value: F.struct(F.lit(kind).alias("stratum_kind"), value.alias("stratum"))
    return F.concat(
        F.array(stratum("overall", F.lit("all")), stratum("complexity", keys.stratum_text(complexity))),
        F.transform(keys.labels_or_default(classes), lambda c: stratum("question_class", c)),
    )


def stratified_means(
    scored: DataFrame, complexity: Column, classes: Column, metrics: list[str], by: tuple[str, ...] = ()
) -> DataFrame:
    """``stratum_kind, stratum, n`` and the mean of each metric, from one scan.

    Rows with several classes count in each of them. If the rows carry corpus BLEU counts,
    the result also has ``corpus_bleu``, pooled per stratum and not a mean of row scores.
    ``by`` keeps sets of predictions apart. Without it, no input gives one overall row with ``n`` 0.

    All strata follow from complexity and class list, so rows are first summed per pair of these, inside
    each task; only those sums are multiplied by their strata.
    """
    pooled = [c for c in BLEU_COUNTS if c in scored.columns]
    finest = scored.groupBy(*by, keys.stratum_text(complexity).alias("_complexity"), keys.labels_or_default(classes).alias("_classes")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(m).cast("double")).alias(m) for m in metrics],
        *[F.count(m).alias(f"_n_{m}") for m in metrics],
        *[F.sum(c).alias(c) for c in pooled],
    )
    spread = finest.withColumn("_strata", strata(F.col("_complexity"), F.col("_classes"))).select(*by, F.inline("_strata"), "n", *metrics, *[f"_n_{m}" for m in metrics], *pooled)
    grouped = spread.groupBy(*by, "stratum_kind", "stratum").agg(
        F.sum("n").alias("n"),
        *[F.try_divide(F.sum(m), F.sum(f"_n_{m}")).alias(m) for m in metrics],
        *[F.sum(c).alias(c) for c in pooled],
    )
    if pooled:
        bleu = textscore.corpus_bleu_value({c: F.col(c) for c in pooled})
        grouped = grouped.withColumn("corpus_bleu", bleu).drop(*pooled)
    if by:
        return grouped
    nothing = scored.sparkSession.range(1).select(F.lit("overall").alias("stratum_kind"), F.lit("all").alias("stratum"), F.lit(0).cast("long").alias("n"))
    absent = nothing.filter(spread.agg(F.count("*")).scalar() == 0)
    return grouped.unionByName(absent, allowMissingColumns=True)
