"""Catalogue: text scores, strata, calibration, ranking quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from proofgrid.functions import stem
from proofgrid.operators import calibration, strata, textscore
from proofgrid.plans import inputs, sqltext
from proofgrid.plans.registry import query
from proofgrid.plans.sqltext import words

KEY = ["item_id", "condition"]
K = "item_id, condition"


# ---- SQL building blocks -----------------------------------------------------------


def _grams_sql(src: str, order: int, prefix: str = "") -> str:
    """Clipped matches per order from token lists ``r`` and ``p`` of ``src``."""
    side = lambda c, a, b: f"""SELECT {K}, n, unnest(list_transform(generate_series(1, len({c}) - n + 1),
        lambda i: array_to_string({c}[i:i + n - 1], ' '))) AS gram, {a} AS a, {b} AS b FROM {src}, range(1, {order + 1}) t(n)"""
    cells = ", ".join(
        f"coalesce(sum(least(a, b)) FILTER (n = {n}), 0) AS m{n}, coalesce(sum(a) FILTER (n = {n}), 0) AS r{n}, "
        f"coalesce(sum(b) FILTER (n = {n}), 0) AS p{n}"
        for n in range(1, order + 1)
    )
    return f"""
{prefix}gram AS ({side('r', 1, 0)} UNION ALL {side('p', 0, 1)}),
{prefix}cnt AS (SELECT {K}, n, gram, sum(a) AS a, sum(b) AS b FROM {prefix}gram GROUP BY ALL),
{prefix}stat AS (SELECT {K}, {cells} FROM {prefix}cnt GROUP BY ALL)"""


_BP = "CASE WHEN p1 = 0 THEN 0 WHEN p1 > r1 THEN 1 ELSE exp(1 - r1::DOUBLE / p1) END"

_SENTENCE = f"""WITH {sqltext.PRED},
tok AS (SELECT {K}, {words('reference')} AS r, {words('prediction')} AS p FROM pred),
{_grams_sql('tok', 4)}
SELECT {K}, CASE WHEN m1 = 0 THEN 0 ELSE {_BP} * exp((
  {" + ".join(f"ln((CASE WHEN m{n} > 0 THEN m{n}::DOUBLE ELSE 0.1::DOUBLE END) / greatest(p{n}, 1))" for n in range(1, 5))}) / 4) END AS bleu
FROM stat"""


def _tokens_13a_sql(x: str) -> str:
    out = f"regexp_replace({x}, '\\s+$', '')"
    for a, b in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                 ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        out = f"replace({out}, {a}, {b})"
    out = f"(' ' || {out} || ' ')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda t: t <> '')"


_COUNTS_13A = f"""{sqltext.SCORED},
tok AS (SELECT {K}, {_tokens_13a_sql('reference')} AS r, {_tokens_13a_sql('prediction')} AS p FROM pred),
{_grams_sql('tok', 4)}"""


def _corpus_value_sql() -> str:
    """Corpus BLEU from pooled counts."""
    logs = []
    for n in range(1, 5):
        misses = " + ".join(f"CASE WHEN m{i} = 0 THEN 1 ELSE 0 END" for i in range(1, n + 1))
        logs.append(f"CASE WHEN m{n} > 0 THEN ln(m{n}::DOUBLE / p{n}) ELSE ln(1.0 / (pow(2.0, {misses}) * p{n})) END")
    return f"CASE WHEN m1 = 0 OR p4 = 0 THEN 0 ELSE {_BP} * exp(({' + '.join(logs)}) / 4) END"


_STRATA = """
strata AS (
  SELECT *, unnest(list_concat([{'k': 'overall', 's': 'all'}, {'k': 'complexity', 's': coalesce(complexity, 'None')}],
    list_transform(coalesce(classes, ['unlabelled']), lambda c: {'k': 'question_class', 's': c}))) AS st
  FROM scored)"""


# ---- the stemmer in SQL ------------------------------------------------------------


def _stem_sql(vocabulary: str) -> str:
    """Porter stems of ``vocabulary(word)`` as a chain of common table expressions ending in ``stems(word, stem)``."""
    shape = lambda x: f"regexp_replace(regexp_replace({x}, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    has = lambda x, p: f"regexp_matches({shape(x)}, '{p}')"
    drop = lambda x, n: f"substr({x}, 1, greatest(length({x}) - {n}, 0))"
    ends = lambda x, s: f"ends_with({x}, '{s}')"
    suffix = lambda x, rules: f"regexp_extract({x}, '({stem._longest(rules)})$', 1)"

    def table(x, rules):
        s = suffix(x, rules)
        rest = f"substr({x}, 1, length({x}) - length({s}))"
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items())
        return f"CASE WHEN {s} <> '' AND {has(rest, stem.M_OVER_0)} THEN {rest} || (CASE {s} {cases} END) ELSE {x} END"

    w = "w"
    s4 = suffix(w, stem.STEP_4)
    rest4 = f"substr(w, 1, length(w) - length({s4}))"
    base = f"""CASE WHEN {ends(w, 'ied')} OR {ends(w, 'eed')} THEN NULL
      WHEN {ends(w, 'ed')} AND {has(drop(w, 2), stem.V)} THEN {drop(w, 2)}
      WHEN {ends(w, 'ing')} AND {has(drop(w, 3), stem.V)} THEN {drop(w, 3)} END"""
    mended = f"""CASE WHEN {ends('b', 'at')} OR {ends('b', 'bl')} OR {ends('b', 'iz')} THEN b || 'e'
      WHEN length(b) >= 2 AND right(b, 1) = substr(b, length(b) - 1, 1) AND {has('b', stem.C + '$')}
        THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE {drop('b', 1)} END
      WHEN {has('b', stem.M_IS_1)} AND {has('b', stem.CVC)} THEN b || 'e' ELSE b END"""
    past = f"""CASE WHEN {ends(w, 'ied')} THEN CASE WHEN length(w) = 4 THEN {drop(w, 1)} ELSE {drop(w, 2)} END
      WHEN {ends(w, 'eed')} THEN CASE WHEN {has(drop(w, 3), stem.M_OVER_0)} THEN {drop(w, 1)} ELSE w END
      WHEN b IS NOT NULL THEN {mended} ELSE w END"""
    steps = [
        f"""CASE WHEN {ends(w, 'ies')} AND length(w) = 4 THEN {drop(w, 1)}
          WHEN {ends(w, 'sses')} OR {ends(w, 'ies')} THEN {drop(w, 2)}
          WHEN {ends(w, 's')} AND NOT {ends(w, 'ss')} THEN {drop(w, 1)} ELSE w END""",
        f"(SELECT {past} FROM (SELECT {base} AS b))",
        f"CASE WHEN {ends(w, 'y')} AND length(w) > 2 AND {has(drop(w, 1), stem.C + '$')} THEN {drop(w, 1)} || 'i' ELSE w END",
        f"CASE WHEN {ends(w, 'alli')} AND {has(drop(w, 4), stem.M_OVER_0)} THEN {drop(w, 2)} ELSE w END",
        f"CASE WHEN {ends(w, 'logi')} THEN CASE WHEN {has(drop(w, 3), stem.M_OVER_0)} THEN {drop(w, 1)} ELSE w END ELSE {table(w, stem.STEP_2)} END",
        table(w, stem.STEP_3),
        f"CASE WHEN {s4} <> '' AND {has(rest4, stem.M_OVER_1)} AND ({s4} <> 'ion' OR regexp_matches({rest4}, '[st]$')) THEN {rest4} ELSE w END",
        f"""CASE WHEN {ends(w, 'e')} AND ({has(drop(w, 1), stem.M_OVER_1)} OR ({has(drop(w, 1), stem.M_IS_1)}
          AND NOT {has(drop(w, 1), stem.CVC)})) THEN {drop(w, 1)} ELSE w END""",
        f"CASE WHEN {ends(w, 'll')} AND {has(drop(w, 1), stem.M_OVER_1)} THEN {drop(w, 1)} ELSE w END",
    ]
    parts = [f"st0 AS (SELECT word, word AS w FROM {vocabulary})"]
    parts += [f"st{i + 1} AS (SELECT word, {s} AS w FROM st{i})" for i, s in enumerate(steps)]
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stem.IRREGULAR.items())
    parts.append(
        f"stems AS (SELECT word, coalesce(CASE word {known} END, CASE WHEN length(word) <= 2 THEN word END, w) AS stem FROM st{len(steps)})"
    )
    return ",\n".join(parts)


# ---- text scores -------------------------------------------------------------------


@query("h2_sentence_bleu", _SENTENCE, doubles=("bleu",))
def sentence_bleu(spark, sf):
    """BLEU-4 of every prediction."""
    return textscore.sentence_bleu(inputs.predictions(spark, sf), KEY, "reference", "prediction")


def _rouge_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


_RAW_TOKENS = f"""{sqltext.PRED},
raw AS (SELECT {K}, {_rouge_words('reference')} AS r, {_rouge_words('prediction')} AS p FROM pred)"""

_F = lambda n: f"coalesce(2.0 * m{n} / nullif(r{n} + p{n}, 0), 0)"


@query(
    "h3_rouge_n_unstemmed",
    f"WITH {_RAW_TOKENS}, {_grams_sql('raw', 2)} SELECT {K}, {_F(1)} AS rouge1, {_F(2)} AS rouge2 FROM stat",
    doubles=("rouge1", "rouge2"),
)
def rouge_n_unstemmed(spark, sf):
    """ROUGE-1 and ROUGE-2 on plain tokens."""
    ready = textscore.rouge_ready(inputs.predictions(spark, sf), KEY, "reference", "prediction", stemming=False)
    return textscore.rouge_n(ready, KEY)


def _spread_sql(src: str) -> str:
    return f"""
spread AS (
  SELECT {K}, 'r' AS side, unnest(r) AS word, generate_subscripts(r, 1) AS pos FROM {src} UNION ALL
  SELECT {K}, 'p', unnest(p), generate_subscripts(p, 1) FROM {src}),
vocab AS MATERIALIZED (SELECT DISTINCT word FROM spread),
{_stem_sql('vocab')}"""


_STEMMED = f"""{_RAW_TOKENS}, {_spread_sql('raw')},
tok AS (
  SELECT {K}, coalesce(list(CASE WHEN length(word) > 3 THEN stem ELSE word END ORDER BY pos) FILTER (side = 'r'), []) AS r,
    coalesce(list(CASE WHEN length(word) > 3 THEN stem ELSE word END ORDER BY pos) FILTER (side = 'p'), []) AS p
  FROM spread JOIN stems USING (word) GROUP BY ALL)"""


@query(
    "h3_rouge_n",
    f"WITH {_STEMMED}, {_grams_sql('tok', 2)} SELECT {K}, {_F(1)} AS rouge1, {_F(2)} AS rouge2 FROM stat",
    doubles=("rouge1", "rouge2"),
)
def rouge_n(spark, sf):
    """ROUGE-1 and ROUGE-2 on stems."""
    ready = textscore.rouge_ready(inputs.predictions(spark, sf), KEY, "reference", "prediction")
    return textscore.rouge_n(ready, KEY)


@query("h3_vocabulary_stems", f"""WITH src AS (SELECT unnest({_rouge_words('text')}) AS word FROM documents),
vocab AS MATERIALIZED (SELECT DISTINCT word FROM src), {_stem_sql('vocab')} SELECT word, stem FROM stems""")
def vocabulary_stems(spark, sf):
    """Stems of every word of the documents."""
    from proofgrid.functions.tokens import rouge_tokens

    vocabulary = inputs.documents(spark, sf).select(F.explode(rouge_tokens(F.col("text"))).alias("word")).distinct()
    return stem.stemmed(vocabulary)


#: The table of subsequence lengths, a row per token of ``r`` that ``p`` holds: where ``p`` has that token, the
#: length before its last place so far grows by one.
_ROUGE_L = f"""WITH {_STEMMED},
places AS (
  SELECT {K}, r, p, list_filter(list_transform(r, lambda t: list_filter(generate_series(1, len(p)), lambda x: p[x] = t)), lambda q: len(q) > 0) AS qs
  FROM tok),
lcs AS (
  SELECT {K}, len(r) AS rl, len(p) AS pl, coalesce(list_reduce(list_prepend(list_transform(p, lambda t: 0::BIGINT), qs), lambda old, q:
    list_transform(old, lambda v, j: greatest(v, CASE WHEN q[1] <= j THEN coalesce(old[list_filter(q, lambda x: x <= j)[-1] - 1], 0) + 1 ELSE 0 END)))[-1], 0) AS ml
  FROM places)
SELECT {K}, coalesce(2.0 * ml / nullif(rl + pl, 0), 0) AS rougeL FROM lcs"""


@query("h4_rouge_l", _ROUGE_L, doubles=("rougeL",))
def rouge_l(spark, sf):
    """ROUGE-L on stems."""
    ready = textscore.rouge_ready(inputs.predictions(spark, sf), KEY, "reference", "prediction")
    return textscore.rouge_l(ready, KEY)


_METEOR = f"""WITH {sqltext.PRED},
raw AS (SELECT {K}, {words('reference')} AS r, {words('prediction')} AS p FROM pred),
{_spread_sql('raw')},
toks AS (SELECT {K}, side, pos, word, stem FROM spread JOIN stems USING (word)),
k1 AS (SELECT *, row_number() OVER (PARTITION BY {K}, side, word ORDER BY pos DESC) AS k FROM toks),
m1 AS (SELECT a.item_id, a.condition, a.pos AS rp, b.pos AS pp FROM k1 a JOIN k1 b
  ON a.item_id = b.item_id AND a.condition = b.condition AND a.word = b.word AND a.k = b.k AND a.side = 'r' AND b.side = 'p'),
left1 AS (
  SELECT t.* FROM toks t ANTI JOIN m1 x ON t.item_id = x.item_id AND t.condition = x.condition
    AND t.pos = CASE WHEN t.side = 'r' THEN x.rp ELSE x.pp END),
k2 AS (SELECT *, row_number() OVER (PARTITION BY {K}, side, stem ORDER BY pos DESC) AS k FROM left1),
m2 AS (SELECT a.item_id, a.condition, a.pos AS rp, b.pos AS pp FROM k2 a JOIN k2 b
  ON a.item_id = b.item_id AND a.condition = b.condition AND a.stem = b.stem AND a.k = b.k AND a.side = 'r' AND b.side = 'p'),
al AS (SELECT *, lag(rp) OVER w AS lr, lag(pp) OVER w AS lpos FROM (FROM m1 UNION ALL FROM m2)
  WINDOW w AS (PARTITION BY {K} ORDER BY pp)),
agg AS (SELECT {K}, count(*) AS m, count(*) FILTER (lr IS NULL OR NOT (rp = lr + 1 AND pp = lpos + 1)) AS chunks FROM al GROUP BY ALL),
f AS (SELECT raw.item_id, raw.condition, m, chunks, m::DOUBLE / len(p) AS pr, m::DOUBLE / len(r) AS rc
  FROM raw LEFT JOIN agg ON raw.item_id = agg.item_id AND raw.condition = agg.condition)
SELECT {K}, coalesce(pr * rc / (0.9::DOUBLE * pr + 0.1::DOUBLE * rc) * (1 - 0.5 * pow(chunks::DOUBLE / m, 3)), 0) AS meteor FROM f"""


@query("h5_meteor", _METEOR, doubles=("meteor",))
def meteor(spark, sf):
    """METEOR from exact and stem matches."""
    return textscore.meteor(inputs.predictions(spark, sf), KEY, "reference", "prediction")


@query(
    "h6_corpus_bleu",
    f"""WITH {_COUNTS_13A}, pooled AS (
      SELECT condition, {", ".join(f"sum(m{n}) AS m{n}, sum(p{n}) AS p{n}" for n in range(1, 5))}, sum(r1) AS r1 FROM stat GROUP BY 1)
    SELECT condition, {_corpus_value_sql()} AS corpus_bleu FROM pooled""",
    doubles=("corpus_bleu",),
)
def corpus_bleu(spark, sf):
    """Corpus BLEU of each condition."""
    counts = textscore.corpus_bleu_counts(inputs.predictions(spark, sf), KEY, "reference", "prediction")
    pooled = counts.groupBy("condition").agg(*[F.sum(c).alias(c) for c in strata.BLEU_COUNTS])
    return pooled.select("condition", textscore.corpus_bleu_value({c: F.col(c) for c in strata.BLEU_COUNTS}).alias("corpus_bleu"))


_ROUGE_N = f"WITH {_STEMMED}, {_grams_sql('tok', 2)} SELECT {K}, {_F(1)} AS rouge1, {_F(2)} AS rouge2 FROM stat"


@query(
    "h7_score_all",
    f"""SELECT * FROM (WITH {sqltext.SCORED} SELECT {K}, source, exact_match FROM scored) JOIN ({_SENTENCE}) USING ({K})
    JOIN ({_ROUGE_N}) USING ({K}) JOIN ({_ROUGE_L}) USING ({K}) JOIN ({_METEOR}) USING ({K})""",
    doubles=("exact_match", "bleu", "rouge1", "rouge2", "rougeL", "meteor"),
)
def score_all(spark, sf):
    """All six scores next to every input row."""
    scored = textscore.score_answers(inputs.predictions(spark, sf), KEY)
    return scored.select(*KEY, "source", "metrics.*")


# ---- strata ------------------------------------------------------------------------


@query(
    "e6_stratified_means",
    f"""WITH {sqltext.SCORED}, {_STRATA}
    SELECT condition, st.k AS stratum_kind, st.s AS stratum, count(*) AS n, avg(exact_match) AS exact_match,
      avg(confidence) AS confidence FROM strata GROUP BY ALL""",
    doubles=("exact_match", "confidence"),
)
def stratified_means(spark, sf):
    """Scores of every condition overall, by complexity and by class."""
    rows = inputs.scored_exact(spark, sf)
    return strata.stratified_means(rows, F.col("complexity"), F.col("classes"), ["exact_match", "confidence"], by=("condition",))


@query(
    "e7_stratified_corpus_bleu",
    f"""WITH {_COUNTS_13A}, {_STRATA}, pooled AS (
      SELECT condition, st.k AS stratum_kind, st.s AS stratum, count(*) AS n, avg(exact_match) AS exact_match,
        {", ".join(f"sum(m{n}) AS m{n}, sum(p{n}) AS p{n}" for n in range(1, 5))}, sum(r1) AS r1
      FROM strata JOIN stat USING ({K}) GROUP BY ALL)
    SELECT condition, stratum_kind, stratum, n, exact_match, {_corpus_value_sql()} AS corpus_bleu FROM pooled""",
    doubles=("exact_match", "corpus_bleu"),
)
def stratified_corpus_bleu(spark, sf):
    """Pooled corpus BLEU of every stratum of each condition next to its mean exact match."""
    rows = inputs.scored_exact(spark, sf)
    counts = textscore.corpus_bleu_counts(rows, KEY, "reference", "prediction").select(*KEY, *strata.BLEU_COUNTS)
    return strata.stratified_means(rows.join(counts, KEY), F.col("complexity"), F.col("classes"), ["exact_match"], by=("condition",))


# ---- calibration -------------------------------------------------------------------

_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)[1:-1]]
_BIN = " + ".join(f"CASE WHEN confidence >= '{e!r}'::DOUBLE THEN 1 ELSE 0 END" for e in _EDGES)
_BINS = f"""
bins AS (
  SELECT {_BIN} AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(correct) AS accuracy,
    sum(pow(confidence - correct, 2)) AS squares FROM conf GROUP BY 1)"""


@query(
    "e8_calibration_bins",
    f"WITH {sqltext.CONFIDENT}, {_BINS} SELECT bin, n, mean_confidence, accuracy FROM bins",
    doubles=("mean_confidence", "accuracy"),
)
def calibration_bins(spark, sf):
    """Size, mean confidence and accuracy of each confidence bin."""
    return calibration.calibration_bins(inputs.confident(spark, sf), "confidence", "correct")


@query(
    "e9_calibration_summary",
    f"""WITH {sqltext.CONFIDENT}, {_BINS}
    SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * accuracy) / sum(n) AS accuracy, sum(n * mean_confidence) / sum(n) AS mean_confidence,
      sum(squares) / sum(n) AS brier_score, sum(n * abs(mean_confidence - accuracy)) / sum(n) AS ece FROM bins""",
    doubles=("accuracy", "mean_confidence", "brier_score", "ece"),
)
def calibration_summary(spark, sf):
    """Accuracy, Brier score and expected calibration error."""
    return calibration.checked_summary(inputs.confident(spark, sf), "confidence", "correct")


def _risk_sql(cte: str, name: str, p: str, y: str) -> str:
    return f"""WITH {cte}, rk AS (
      SELECT {y} AS y, row_number() OVER (ORDER BY {p} DESC, {y} DESC) AS rn, count(*) OVER () AS total FROM {name}),
    tot AS (SELECT max(total) AS total FROM rk),
    cov AS (SELECT c, greatest(1, CAST(ceil(total * c) AS BIGINT)) AS k FROM tot,
      unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) t(c))
    SELECT c AS coverage, k AS n, sum(y) / k AS accuracy, 1 - sum(y) / k AS risk FROM cov JOIN rk ON rn <= k GROUP BY c, k"""


@query("j3_risk_coverage", _risk_sql(sqltext.CONFIDENT, "conf", "confidence", "correct"), doubles=("coverage", "accuracy", "risk"))
def risk_coverage(spark, sf):
    """Accuracy and risk of the most confident quarter, half, three quarters, all."""
    return calibration.risk_coverage(inputs.confident(spark, sf), "confidence", "correct")


_COEF, _INTERCEPT = 2.5, 0.75

_CALIBRATED = f"""{sqltext.SCORED},
cal AS (SELECT *, 1.0 / (1.0 + exp(-({_COEF}::DOUBLE * mean_logprob + {_INTERCEPT}::DOUBLE))) AS probability FROM scored)"""


def _newton_sql(steps: int) -> str:
    """Newton steps from zero on ``dev(x, y)``, one after the other, with a penalty on the coefficient only."""
    parts = ["b0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b)"]
    for i in range(1, steps + 1):
        parts.append(f"""
g{i} AS (
  SELECT any_value(a) AS a, any_value(b) AS b, sum((h - y) * x) + any_value(a) AS ga, sum(h - y) AS gb,
    sum(h * (1 - h) * x * x) + 1 AS aa, sum(h * (1 - h) * x) AS ab, sum(h * (1 - h)) AS bb
  FROM (SELECT x, y, a, b, 1 / (1 + exp(-(a * x + b))) AS h FROM dev, b{i - 1})),
b{i} AS MATERIALIZED (SELECT a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM g{i})""")
    return ",".join(parts)


_FITTED = f"""{sqltext.SCORED},
dev AS MATERIALIZED (SELECT mean_logprob AS x, exact_match AS y FROM scored WHERE ih % 2 = 0), {_newton_sql(12)}"""


@query(
    "i1_logistic_fit",
    f"WITH {_FITTED} SELECT (SELECT count(*) FROM dev) AS development_n, a AS coefficient, b AS intercept FROM b12",
    doubles=("coefficient", "intercept"),
)
def logistic_fit(spark, sf):
    """Logistic map fitted on the development half of the predictions."""
    development = inputs.scored_exact(spark, sf).filter("ih % 2 = 0")
    coefficient, intercept, _ = calibration.fit_logistic(development, "mean_logprob", "exact_match")
    return development.agg(F.count("*").alias("development_n")).withColumn("coefficient", F.lit(coefficient)).withColumn(
        "intercept", F.lit(intercept)
    )


@query(
    "i2_calibrated_probability",
    f"WITH {_CALIBRATED} SELECT {K}, probability AS calibrated_correctness_probability FROM cal",
    doubles=("calibrated_correctness_probability",),
)
def calibrated_probability(spark, sf):
    """Predictions with the probability of a given logistic map."""
    rows = calibration.with_probability(inputs.scored_exact(spark, sf), "mean_logprob", _COEF, _INTERCEPT)
    return rows.select(*KEY, "calibrated_correctness_probability")


_REPORT_DOUBLES = ("level", "accuracy", "mean_confidence", "brier_score", "ece", "risk", "logistic_coefficient", "logistic_intercept")


@query(
    "i3_fit_and_evaluate",
    f"""WITH {_FITTED},
    conf AS MATERIALIZED (SELECT 1 / (1 + exp(-(a * mean_logprob + b))) AS confidence, exact_match AS correct FROM scored, b12 WHERE ih % 2 = 1), {_BINS},
    report AS (
      SELECT 'summary' AS part, NULL::DOUBLE AS level, CAST(sum(n) AS BIGINT) AS n, sum(n * accuracy) / sum(n) AS accuracy,
        sum(n * mean_confidence) / sum(n) AS mean_confidence, sum(squares) / sum(n) AS brier_score,
        sum(n * abs(mean_confidence - accuracy)) / sum(n) AS ece, NULL::DOUBLE AS risk FROM bins
      UNION ALL SELECT 'bin', bin, n, accuracy, mean_confidence, NULL, NULL, NULL FROM bins
      UNION ALL SELECT 'coverage', coverage, n, accuracy, NULL, NULL, NULL, risk FROM ({_risk_sql("cal AS (FROM conf)", "cal", "confidence", "correct")}))
    SELECT report.*, (SELECT count(*) FROM dev) AS development_n, a AS logistic_coefficient, b AS logistic_intercept FROM report, b12""",
    doubles=_REPORT_DOUBLES,
)
def fit_and_evaluate(spark, sf):
    """The calibration report of the test half under the map of the development half: a row for the summary, each bin and each coverage."""
    rows = inputs.scored_exact(spark, sf)
    report, _ = calibration.fit_and_evaluate(rows.filter("ih % 2 = 0"), rows.filter("ih % 2 = 1"), "mean_logprob", "exact_match")
    figures = ("accuracy", "mean_confidence", "brier_score", "ece", "risk")

    def cell(part, level, n, **known):
        own = [known.get(f, F.lit(None)).cast("double").alias(f) for f in figures]
        return F.struct(F.lit(part).alias("part"), level.cast("double").alias("level"), n.cast("long").alias("n"), *own)

    own = cell("summary", F.lit(None), F.col("n"), **{f: F.col(f) for f in figures[:4]})
    binned = F.transform("bins", lambda x: cell("bin", x.bin, x.n, accuracy=x.accuracy, mean_confidence=x.mean_confidence))
    covered = F.transform("risk_coverage", lambda x: cell("coverage", x.coverage, x.n, accuracy=x.accuracy, risk=x.risk))
    fitted = ["development_n", "logistic_coefficient", "logistic_intercept"]
    return report.select(F.explode(F.concat(F.array(own), binned, covered)).alias("cell"), *fitted).select("cell.*", *fitted)


_LEVELS = """
lev AS (SELECT confidence AS s, sum(correct) AS pos, sum(1 - correct) AS neg FROM conf GROUP BY 1),
cum AS (SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM lev
  WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "n1_auroc_auprc",
    f"""WITH {sqltext.CONFIDENT}, {_LEVELS}
    SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
      sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auroc,
      sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos) AS auprc FROM cum""",
    doubles=("auroc", "auprc"),
)
def auroc_auprc(spark, sf):
    """Area under the ROC and the precision-recall curve."""
    return calibration.ranking_quality(inputs.confident(spark, sf), "confidence", "correct")


@query(
    "n4_selective_risk",
    f"""WITH {sqltext.CONFIDENT}, {_LEVELS},
    ok AS (SELECT * FROM cum WHERE fp <= 0.55::DOUBLE * (tp + fp)),
    best AS (SELECT arg_max(s, tp + fp) AS s, max(tp + fp) AS kept, arg_max(fp, tp + fp) AS fp FROM ok)
    SELECT 0.55 AS target_risk, CAST(coalesce(kept, 0) AS BIGINT) AS kept, s AS threshold,
      coalesce(kept / (SELECT count(*) FROM conf), 0) AS coverage, fp / kept AS risk FROM best""",
    doubles=("target_risk", "threshold", "coverage", "risk"),
)
def selective_risk(spark, sf):
    """Largest coverage with a risk of at most 0.55."""
    return calibration.selective_risk(inputs.confident(spark, sf), "confidence", "correct", 0.55)
