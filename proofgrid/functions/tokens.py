"""Tokenisers and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.keys import strip

# The published 13a tokeniser, in order.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
RULES_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def present(parts: Column) -> Column:
    return F.filter(parts, lambda t: t != "")


def tokens_13a(text: Column) -> Column:
    """The tokens that corpus BLEU counts; case and punctuation stay."""
    line = F.regexp_replace(text, r"(?U)\s+$", "")
    line = F.replace(F.replace(F.replace(line, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(char))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in RULES_13A:
        line = F.regexp_replace(line, pattern, replacement)
    return present(F.split(strip(line), r"(?U)[\s\x1c-\x1f]+"))


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return present(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as text, in order."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
