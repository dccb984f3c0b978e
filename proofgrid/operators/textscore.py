"""Answer scores: exact match, sentence and corpus BLEU, ROUGE, METEOR.

Every function takes rows with a unique ``key`` and works on the tokens of a row. Rows are
first hash-partitioned by key and a key's tokens are counted and aligned in one place, so
the text is shuffled once, and its tokens and n-grams never become rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from proofgrid.functions import answers, tokens
from proofgrid.functions.stem import stem_of
from proofgrid.session import stored, together

# Fixed values of the published metrics.
BLEU_ORDER = 4
BLEU_EPSILON = 0.1
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5

# Names of the scores.
METRICS = ["exact_match", "bleu", "rouge1", "rouge2", "rougeL", "meteor"]


def _split(text: str) -> list[str]:
    return text.split(" ") if text else []


def _clipped(references: list[str], predictions: list[str], orders: range) -> list[int]:
    """Per order: n-grams common to both sides of a key's rows, each as often as the rarer side has it.

    A row with no n-gram twice on one side counts its common ones at once, the others are counted together.
    """
    rows = [(_split(r), _split(p)) for r, p in zip(references, predictions)]
    found = []
    for n in orders:
        matched, in_ref, in_pred = 0, Counter(), Counter()
        for row in rows:
            r, p = row if n == 1 else (list(zip(*[side[i:] for i in range(n)])) for side in row)
            distinct_r, distinct_p = set(r), set(p)
            if len(distinct_r) == len(r) or len(distinct_p) == len(p):
                matched += len(distinct_r & distinct_p)
            else:
                in_ref.update(r)
                in_pred.update(p)
        found.append(matched + sum(min(k, in_pred[g]) for g, k in in_ref.items() if g in in_pred))
    return found


def ngram_overlap(rows: DataFrame, key: list[str], reference: str, prediction: str, orders: range) -> DataFrame:
    """Per key and n: clipped matches and the n-gram counts of both sides (``m1, r1, p1, ...``).

    Tokens hold no blank. A key's n-grams are counted where its tokens are and never become rows, so the work is
    linear in the tokens and a task holds the n-grams of one key. Rows that share a key are summed. A row without one side has no matches; it
    counts only if its other side has no token twice.
    """

    @F.pandas_udf(ArrayType(LongType()))
    def matches(references: pd.Series, predictions: pd.Series) -> pd.Series:
        return pd.Series([_clipped(r, p, orders) for r, p in zip(references, predictions)])

    r, p = F.col(reference), F.col(prediction)
    unrepeated = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    counts = F.coalesce((r.isNotNull() & p.isNotNull()) | unrepeated(r) | unrepeated(p), F.lit(False))
    # decided in the aggregate: as a filter it would make the tokens once more
    text = lambda c: F.collect_list(F.when(counts, F.coalesce(F.array_join(c, " "), F.lit(""))).otherwise(""))
    size = lambda c: F.sum(F.when(counts, F.size(c)))
    per_key = rows.groupBy(*key).agg(
        text(r).alias("_ref"), text(p).alias("_pred"), size(r).alias("_size_r"), size(p).alias("_size_p"),
        F.max(counts).alias("_counts"),
    ).filter("_counts")
    sums = per_key.select(*key, "_size_r", "_size_p", matches("_ref", "_pred").alias("_matches"))
    matched = [F.get("_matches", F.lit(i)).alias(f"m{n}") for i, n in enumerate(orders)]
    totals = [F.greatest(F.col(f"_size_{s}") - (n - 1), F.lit(0)).alias(f"{s}{n}") for n in orders for s in "rp"]
    return sums.select(*key, *matched, *totals)


def brevity_penalty(reference_length: Column, prediction_length: Column) -> Column:
    shorter = F.exp(1 - F.try_divide(reference_length, prediction_length))
    return F.when(prediction_length == 0, 0.0).when(prediction_length > reference_length, 1.0).otherwise(shorter)


def sentence_bleu_value() -> Column:
    """BLEU-4 from ``m*, r1, p*``; an order without match counts 0.1 over its n-grams."""
    logs = []
    for n in range(1, BLEU_ORDER + 1):
        matched = F.when(F.col(f"m{n}") > 0, F.col(f"m{n}").cast("double")).otherwise(BLEU_EPSILON)
        logs.append(F.log(matched / F.greatest(F.col(f"p{n}"), F.lit(1))) / BLEU_ORDER)
    score = brevity_penalty(F.col("r1"), F.col("p1")) * F.exp(sum(logs[1:], logs[0]))
    return F.when(F.col("m1") == 0, 0.0).otherwise(score)


def _normal_tokens(rows: DataFrame, key: list[str], reference: str, prediction: str) -> DataFrame:
    """Tokens of both normalised answers; Spark forgets a partitioning at a Python function, so that comes first."""
    normal = rows.select(
        *key, answers.normalised(F.col(reference)).alias("ref"), answers.normalised(F.col(prediction)).alias("pred")
    )
    split = [answers.normalised_tokens(F.col(c)).alias(c) for c in ("ref", "pred")]
    return together(normal, *key).select(*key, *split)


def sentence_bleu(rows: DataFrame, key: list[str], reference: str, prediction: str) -> DataFrame:
    """``key, bleu`` on the tokens of the normalised answers."""
    normal = _normal_tokens(rows, key, reference, prediction)
    counts = ngram_overlap(normal, key, "ref", "pred", range(1, BLEU_ORDER + 1))
    return counts.select(*key, sentence_bleu_value().alias("bleu"))


def corpus_bleu_counts(rows: DataFrame, key: list[str], reference: str, prediction: str) -> DataFrame:
    """Per-row counts that add up to corpus BLEU over any group of rows; raw text, 13a tokens."""
    listed = together(rows.select(*key, reference, prediction), *key).select(
        *key,
        tokens.tokens_13a(F.col(reference)).alias("ref"),
        tokens.tokens_13a(F.col(prediction)).alias("pred"),
    )
    return ngram_overlap(listed, key, "ref", "pred", range(1, BLEU_ORDER + 1))


def corpus_bleu_value(counts: dict[str, Column]) -> Column:
    """Corpus BLEU in [0, 1] from pooled counts, with exponential smoothing of empty orders."""
    misses, logs = F.lit(0), []
    for n in range(1, BLEU_ORDER + 1):
        matched, total = counts[f"m{n}"], counts[f"p{n}"]
        misses = misses + F.when(matched == 0, 1).otherwise(0)
        smooth = F.log(1.0 / (F.pow(F.lit(2.0), misses) * total))
        logs.append(F.when(matched > 0, F.log(matched / total)).otherwise(smooth))
    nothing = (counts["m1"] == 0) | (counts[f"p{BLEU_ORDER}"] == 0)
    score = brevity_penalty(counts["r1"], counts["p1"]) * F.exp(sum(logs[1:], logs[0]) / BLEU_ORDER)
    return F.when(nothing, 0.0).otherwise(score)


def f_measure(matched: Column, reference_total: Column, prediction_total: Column) -> Column:
    """Harmonic mean of precision and recall of an overlap; 0 without overlap."""
    return F.coalesce(F.try_divide(2.0 * matched, reference_total + prediction_total), F.lit(0.0))


VOCABULARY_LIMIT = 1_000_000

_STEMS: dict[str, str] = {}  # one per worker


def _stem(word: str, limit: int) -> str:
    """The stem of a word; a worker remembers those of ``limit`` words."""
    found = _STEMS.get(word)
    if found is None:
        if len(_STEMS) >= limit:
            _STEMS.clear()
        found = _STEMS[word] = stem_of(word)
    return found


def rouge_ready(
    rows: DataFrame, key: list[str], reference: str, prediction: str, stemming: bool = True,
    vocabulary_limit: int = VOCABULARY_LIMIT,
) -> DataFrame:
    """``key, ref_stems, pred_stems`` for the three ROUGE scores, from raw text.

    Words are stemmed where they are, without a row of their own.
    """
    listed = together(rows.select(*key, reference, prediction), *key).select(
        *key,
        tokens.rouge_tokens(F.col(reference)).alias("ref"),
        tokens.rouge_tokens(F.col(prediction)).alias("pred"),
    )
    if not stemming:
        return listed.withColumnsRenamed({"ref": "ref_stems", "pred": "pred_stems"})
    word = lambda w: _stem(w, vocabulary_limit) if len(w) > 3 else w

    @F.pandas_udf(ArrayType(StringType()))
    def stems(texts: pd.Series) -> pd.Series:
        placed = ([(i, word(w)) for text in one for i, w in enumerate(_split(text))] for one in texts)
        return pd.Series([[w for _, w in (sorted(p) if len(one) > 1 else p)] for one, p in zip(texts, placed)], dtype="object")

    per_key = listed.groupBy(*key).agg(*_texts("ref", "pred"), F.count("*").cast("int").alias("_rows"))
    gathered = per_key.select(*key, stems("ref").alias("ref_stems"), stems("pred").alias("pred_stems"), "_rows")
    return gathered.select(*key, "ref_stems", "pred_stems", F.explode(F.array_repeat(F.lit(0), F.col("_rows")))).drop("col")


def _texts(reference: str, prediction: str) -> list[Column]:
    """Both sides of a key's rows as text, tokens with a blank between; a row without one side has no token."""
    whole = F.col(reference).isNotNull() & F.col(prediction).isNotNull()
    side = lambda c: F.collect_list(F.when(whole, F.array_join(c, " ")).otherwise("")).alias(c)
    return [side(reference), side(prediction)]


def rouge_n(ready: DataFrame, key: list[str]) -> DataFrame:
    counts = ngram_overlap(ready, key, "ref_stems", "pred_stems", range(1, 3))
    f = lambda n: f_measure(F.col(f"m{n}"), F.col(f"r{n}"), F.col(f"p{n}")).alias(f"rouge{n}")
    return counts.select(*key, f(1), f(2))


def _lcs(a, b) -> int:
    """Longest common subsequence with one machine word per 64 tokens of ``a`` at each token of ``b``."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_ = full
    for token in b:
        hit = open_ & where.get(token, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(x, y) for x, y in zip(a, b)], dtype="int64")


def rouge_l(ready: DataFrame, key: list[str]) -> DataFrame:
    common = lcs_length(F.col("ref_stems"), F.col("pred_stems"))
    return ready.select(*key, f_measure(common, F.size("ref_stems"), F.size("pred_stems")).alias("rougeL"))


def _paired(refs: list, preds: list, form: Callable[[str], str]) -> tuple[list, list, list]:
    """Pair tokens (position, word) of equal form, the k-th last of one side with the k-th last of the other.

    Both sides ascend by position. Returns the pairs of positions and what is left of both sides.
    """
    open_: dict[str, list] = {}
    for token in refs:
        open_.setdefault(form(token[1]), []).append(token)
    pairs, rest = [], []
    for token in reversed(preds):
        same = open_.get(form(token[1]))
        if same:
            pairs.append((same.pop()[0], token[0]))
        else:
            rest.append(token)
    return pairs, sorted(t for same in open_.values() for t in same), rest[::-1]


def _aligned(references: list[str], predictions: list[str], limit: int) -> tuple[list, list, list]:
    """Pairs of positions from equal words, then equal stems, and the lone tokens of both sides."""
    refs, preds = (sorted(t for text in texts for t in enumerate(_split(text))) for texts in (references, predictions))
    exact, refs, preds = _paired(refs, preds, lambda w: w)
    by_stem, refs, preds = _paired(refs, preds, lambda w: _stem(w, limit))
    return exact + by_stem, refs, preds


def _chunks(pairs: list[tuple[int, int]]) -> int:
    """Runs of pairs that follow each other on both sides."""
    along = sorted((p, r) for r, p in pairs)
    return sum(1 for i, (p, r) in enumerate(along) if not i or (p - along[i - 1][0], r - along[i - 1][1]) != (1, 1))


def _match_groups(found: DataFrame, key: list[str], synonyms: DataFrame) -> DataFrame:
    """Pairs of lone tokens (``open_word``) that share a group, each token in one pair at most.

    In each group the k-th last of one side meets the k-th last of the other; a token that meets
    several keeps the last.
    """
    lone = found.filter("ref is null or pred is null")
    groups = synonyms.filter("word is not null and synonym_group is not null").select(F.col("word").alias("open_word"), "synonym_group").distinct()
    side = F.col("ref").isNotNull().alias("_side")
    spread = lone.join(groups, "open_word").select(*key, "ref", "pred", "synonym_group", side)
    from_end = Window.partitionBy(*key, "_side", "synonym_group").orderBy(F.desc(F.coalesce("ref", "pred")))
    met = spread.withColumn("_k", F.row_number().over(from_end)).groupBy(*key, "synonym_group", "_k").agg(F.max("ref").alias("ref"), F.max("pred").alias("pred"))
    once = met.filter("ref is not null and pred is not null").groupBy(*key, "pred").agg(F.max("ref").alias("ref"))
    return once.groupBy(*key, "ref").agg(F.max("pred").alias("pred")).select(*key, "ref", "pred")


def meteor(
    rows: DataFrame, key: list[str], reference: str, prediction: str, synonyms: DataFrame | None = None,
    vocabulary_limit: int = VOCABULARY_LIMIT,
) -> DataFrame:
    """``key, meteor``: exact matches, then stems, then synonym groups; fewer chunks score higher.

    ``synonyms`` (``word, synonym_group``) is optional; without it the third stage is empty. A word may
    stand in several groups; a token is matched once all the same.
    """
    listed = _normal_tokens(rows, key, reference, prediction)
    sizes = F.collect_list(F.struct(F.size("ref").alias("r"), F.size("pred").alias("p"))).alias("_sizes")
    per_key = listed.groupBy(*key).agg(*_texts("ref", "pred"), sizes)
    if synonyms is None:

        @F.pandas_udf(ArrayType(LongType()))
        def totals(references: pd.Series, predictions: pd.Series) -> pd.Series:
            pairs = (_aligned(r, p, vocabulary_limit)[0] for r, p in zip(references, predictions))
            return pd.Series([[len(found), _chunks(found)] for found in pairs])

        found = per_key.select(*key, "_sizes", totals("ref", "pred").alias("_totals"))
        m = F.get("_totals", F.lit(0))
        scored = found.select(*key, F.inline("_sizes"), F.when(m > 0, m).alias("m"), F.get("_totals", F.lit(1)).alias("chunks"))
    else:

        @F.pandas_udf("array<struct<ref int, pred int, open_word string>>")
        def alignment(references: pd.Series, predictions: pd.Series) -> pd.Series:
            cells = lambda pairs, refs, preds: [
                *[{"ref": r, "pred": p, "open_word": None} for r, p in pairs],
                *[{"ref": r, "pred": None, "open_word": w} for r, w in refs],
                *[{"ref": None, "pred": p, "open_word": w} for p, w in preds],
            ]
            return pd.Series([cells(*_aligned(r, p, vocabulary_limit)) for r, p in zip(references, predictions)], dtype="object")

        found = per_key.select(*key, alignment("ref", "pred").alias("_found")).select(*key, F.inline("_found"))
        pairs = found.filter("ref is not null and pred is not null").select(*key, "ref", "pred")
        pairs = pairs.union(_match_groups(found, key, synonyms))
        along = Window.partitionBy(*key).orderBy("pred")
        follows = lambda c: F.coalesce(F.col(c) - F.lag(c).over(along) == 1, F.lit(False))
        chained = pairs.withColumn("_new", ~(follows("pred") & follows("ref")))
        counts = chained.groupBy(*key).agg(F.count("*").alias("m"), F.count_if("_new").alias("chunks"))
        scored = per_key.select(*key, F.inline("_sizes")).join(counts, key, "left")
    precision, recall = F.col("m") / F.col("p"), F.col("m") / F.col("r")
    mean = precision * recall / (METEOR_ALPHA * precision + (1 - METEOR_ALPHA) * recall)
    penalty = METEOR_GAMMA * F.pow(F.col("chunks") / F.col("m"), F.lit(METEOR_BETA))
    return scored.select(*key, F.coalesce(mean * (1 - penalty), F.lit(0.0)).alias("meteor"))


def score_answers(
    predictions: DataFrame, key: list[str], reference: str = "reference", prediction: str = "prediction",
    synonyms: DataFrame | None = None,
) -> DataFrame:
    """All input columns plus a ``metrics`` struct of the six scores; the stems, which two of them need, are made once."""
    exact = answers.exact_match(answers.normalised(F.col(reference)), answers.normalised(F.col(prediction)))
    ready = stored(rouge_ready(predictions, key, reference, prediction), "stems")
    scored = predictions.withColumn("exact_match", exact)
    for part in (
        sentence_bleu(predictions, key, reference, prediction),
        rouge_n(ready, key),
        rouge_l(ready, key),
        meteor(predictions, key, reference, prediction, synonyms),
    ):
        scored = scored.join(part, key)
    return scored.withColumn("metrics", F.struct(*METRICS)).drop(*METRICS)
