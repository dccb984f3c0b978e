"""Answer normalisation and sequence confidence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofgrid.functions.keys import SPACE

# Characters that compatibility normalisation leaves alone when no others are present.
INERT = "^[\\x00-\\x7f\\u00c0-\\u00ff]*$"


@F.pandas_udf(StringType())
def _compatibility_form(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(text: Column) -> Column:
    """Compatibility form, lower case, one blank between words; punctuation, decimals and units stay.

    Spark has no such normaliser, so rows with unusual characters go through Arrow. All
    other rows hand the Python worker a null and keep their native value.
    """
    unusual = F.when(~text.rlike(INERT), text)
    composed = F.coalesce(_compatibility_form(unusual), text)
    return F.trim(F.regexp_replace(F.lower(composed), SPACE, " "))


def normalised_tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def exact_match(normal_reference: Column, normal_prediction: Column) -> Column:
    return (normal_reference == normal_prediction).cast("double")


def finite(logprobs: Column) -> Column:
    """Token log probabilities that are numbers."""
    return F.filter(logprobs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def mean_logprob(logprobs: Column) -> Column:
    kept = finite(logprobs)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.try_divide(total, F.size(kept).cast("double"))


def sequence_confidence(logprobs: Column) -> Column:
    """Geometric mean token probability; null without finite tokens."""
    return F.exp(mean_logprob(logprobs))
