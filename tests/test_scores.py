import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.functions import stem
from proofgrid.operators import calibration, gates, strata, textscore
from proofgrid.operators.textscore import _lcs

PAIRS = [
    ("the polyp is in the sigmoid colon", "the polyp is in the colon"),
    ("a small red polyp", "a small red polyp"),
    ("the the the cat", "the cat the the the"),
    ("no abnormality", "yes"),
    ("", "something"),
    ("something", ""),
    ("", ""),
    ("Polyps were removed, 2.5 cm.", "polyp was removing 2.5 cm"),
    ("one two three", "three two one"),
    ("alpha beta gamma delta epsilon", "alpha beta gamma delta zeta epsilon"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(PAIRS)], "i int, reference string, prediction string")


def by_key(df):
    return {r["i"]: r for r in df.collect()}


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def plain_bleu(reference, prediction):
    r, p = reference.lower().split(), prediction.lower().split()
    if not r or not p or not (grams(r, 1) & grams(p, 1)):
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        hits = sum((grams(r, n) & grams(p, n)).values())
        logs += 0.25 * math.log((hits or 0.1) / max(1, len(p) - n + 1))
    return (1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p))) * math.exp(logs)


def test_sentence_bleu_agrees_with_a_plain_count(rows):
    got = by_key(textscore.sentence_bleu(rows, ["i"], "reference", "prediction"))
    for i, (r, p) in enumerate(PAIRS):
        assert got[i]["bleu"] == pytest.approx(plain_bleu(r, p)), (r, p)
    assert got[1]["bleu"] == pytest.approx(1.0)


def test_rouge_n_and_l_on_stems(rows):
    ready = textscore.rouge_ready(rows, ["i"], "reference", "prediction")
    n, l = by_key(textscore.rouge_n(ready, ["i"])), by_key(textscore.rouge_l(ready, ["i"]))
    assert n[1]["rouge1"] == n[1]["rouge2"] == l[1]["rougeL"] == 1.0
    for i in (3, 4, 5, 6):
        assert n[i]["rouge1"] == n[i]["rouge2"] == l[i]["rougeL"] == 0.0
    # polyp were remov 2 5 cm / polyp was remov 2 5 cm
    assert n[7]["rouge1"] == pytest.approx(5 / 6) and n[7]["rouge2"] == pytest.approx(3 / 5)
    assert l[7]["rougeL"] == pytest.approx(5 / 6) and l[8]["rougeL"] == pytest.approx(1 / 3)
    assert n[2]["rouge1"] == pytest.approx(8 / 9)


def test_large_vocabularies_are_stemmed_in_place_with_equal_results(rows):
    small = by_key(textscore.rouge_ready(rows, ["i"], "reference", "prediction"))
    large = by_key(textscore.rouge_ready(rows, ["i"], "reference", "prediction", vocabulary_limit=2))
    assert small == large


def table_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_subsequence_length_agrees_with_the_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(90))] for _ in "ab")
        assert _lcs(a, b) == table_lcs(a, b)


def test_meteor_on_worked_examples(rows):
    got = by_key(textscore.meteor(rows, ["i"], "reference", "prediction"))
    assert got[1]["meteor"] == pytest.approx(1 - 0.5 / 4**3)
    assert got[3]["meteor"] == got[4]["meteor"] == got[5]["meteor"] == got[6]["meteor"] == 0.0
    # all three words match in three chunks
    assert got[8]["meteor"] == pytest.approx(0.5)
    # 6 of 6 and 6 of 7 words; the chunk breaks where a word is missing
    p, r = 1.0, 6 / 7
    assert got[0]["meteor"] == pytest.approx(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (2 / 6) ** 3))


def test_meteor_takes_stems_and_synonyms_after_exact_words(spark):
    rows = spark.createDataFrame([(0, "big lesion seen", "large lesions seen")], "i int, reference string, prediction string")
    plain = textscore.meteor(rows, ["i"], "reference", "prediction").first()["meteor"]
    assert plain == pytest.approx(2 / 3 * (1 - 0.5 * (1 / 2) ** 3))
    groups = spark.createDataFrame([("big", "size"), ("large", "size")], "word string, synonym_group string")
    full = textscore.meteor(rows, ["i"], "reference", "prediction", synonyms=groups).first()["meteor"]
    assert full == pytest.approx(1 - 0.5 / 3**3)


def corpus(spark, pairs):
    rows = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(pairs)], "i int, reference string, prediction string")
    counts = textscore.corpus_bleu_counts(rows, ["i"], "reference", "prediction")
    pooled = counts.agg(*[F.sum(c).alias(c) for c in strata.BLEU_COUNTS])
    return pooled.select(textscore.corpus_bleu_value({c: F.col(c) for c in strata.BLEU_COUNTS})).first()[0]


def test_corpus_bleu_pools_counts(spark):
    same = [("The cat is on the mat.", "The cat is on the mat."), ("It has 2,000 cells - or so.", "It has 2,000 cells - or so.")]
    assert corpus(spark, same) == pytest.approx(1.0)
    assert corpus(spark, [("a b c d e", "v w x y z")]) == 0.0
    assert corpus(spark, [("a b c", "a b c")]) == 0.0  # no run of four words
    # 4/5, 2/4, 1/3 and a first empty order that counts half of 1/2
    expected = math.exp((math.log(4 / 5) + math.log(2 / 4) + math.log(1 / 3) + math.log(1 / (2 * 2))) / 4)
    assert corpus(spark, [("a b c x e", "a b c y e")]) == pytest.approx(expected)


def test_13a_tokens(spark):
    from proofgrid.functions.tokens import tokens_13a

    text = 'He said &quot;3.5, or 1,000-2,000&quot; (ca.) non-\nsense'
    got = spark.range(1).select(tokens_13a(F.lit(text))).first()[0]
    assert got == ["He", "said", '"', "3.5", ",", "or", "1,000", "-", "2,000", '"', "(", "ca", ".", ")", "nonsense"]


def test_score_answers_keeps_columns_and_adds_six_scores(rows):
    scored = textscore.score_answers(rows.withColumn("extra", F.lit("x")), ["i"])
    got = by_key(scored)
    assert len(got) == len(PAIRS) and got[0]["extra"] == "x"
    assert got[1]["metrics"].asDict().keys() == set(textscore.METRICS)
    assert got[6]["metrics"]["exact_match"] == 1.0 and got[6]["metrics"]["bleu"] == 0.0


def test_strata_count_rows_once_per_class(spark):
    df = spark.createDataFrame([("1", ["a", "b"], 1.0), (None, None, 0.0), ("1", [], 0.5)], "c string, k array<string>, m double")
    got = {(r[0], r[1]): (r["n"], r["m"]) for r in strata.stratified_means(df, F.col("c"), F.col("k"), ["m"]).collect()}
    assert got == {
        ("overall", "all"): (3, 0.5), ("complexity", "1"): (2, 0.75), ("complexity", "None"): (1, 0.0),
        ("question_class", "a"): (1, 1.0), ("question_class", "b"): (1, 1.0), ("question_class", "unlabelled"): (2, 0.25),
    }


def conf(spark, pairs):
    return spark.createDataFrame([(float(p), int(y)) for p, y in pairs], "p double, y int")


def test_bins_use_the_edges_of_the_float_grid(spark):
    values = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 0.95, 1.0]
    got = [r[0] for r in conf(spark, [(v, 1) for v in values]).select(calibration.bin_index(F.col("p"))).collect()]
    assert got == [min(int(np.digitize(v, np.linspace(0, 1, 11)[1:-1])), 9) for v in values] == [0, 1, 2, 3, 5, 6, 9, 9]


def test_summary_and_range_gate(spark):
    got = calibration.checked_summary(conf(spark, [(0.9, 1), (0.95, 0), (0.2, 0), (0.2, 1)]), "p", "y").first()
    assert got["ece"] == pytest.approx(0.5 * abs(0.925 - 0.5) + 0.5 * abs(0.2 - 0.5))
    assert got["brier_score"] == pytest.approx((0.01 + 0.9025 + 0.04 + 0.64) / 4)
    with pytest.raises(gates.GateError):
        calibration.checked_summary(conf(spark, [(1.1, 1)]), "p", "y")
    empty = calibration.calibration_summary(conf(spark, [(0.5, 1)]).filter("p > 1"), "p", "y").first()
    assert empty["n"] == 0 and empty["ece"] is None


def test_risk_coverage_breaks_ties_in_favour_of_right_answers(spark):
    rng = random.Random(2)
    pairs = [(rng.choice([0.5, 0.75, 0.75, 0.9]), rng.randrange(2)) for _ in range(101)]
    got = {r["coverage"]: r for r in calibration.risk_coverage(conf(spark, pairs), "p", "y").collect()}
    ordered = sorted(pairs, reverse=True)
    for share in (0.25, 0.5, 0.75, 1.0):
        n = max(1, math.ceil(101 * share))
        assert (got[share]["n"], got[share]["accuracy"]) == (n, pytest.approx(sum(y for _, y in ordered[:n]) / n))
    assert calibration.risk_coverage(conf(spark, pairs).filter("p > 2"), "p", "y").count() == 0


def test_ranking_quality_and_selective_risk_against_all_pairs(spark):
    rng = random.Random(4)
    pairs = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(120)]
    got = calibration.ranking_quality(conf(spark, pairs), "p", "y").first()
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got["auroc"] == pytest.approx(wins / (len(pos) * len(neg)))
    best, area = (0, None), 0.0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        kept = [y for p, y in pairs if p >= t]
        area += sum(y for p, y in pairs if p == t) / len(pos) * sum(kept) / len(kept)
        if kept.count(0) <= 0.5 * len(kept):
            best = max(best, (len(kept), t))
    assert got["auprc"] == pytest.approx(area)
    chosen = calibration.selective_risk(conf(spark, pairs), "p", "y", 0.5).first()
    assert (chosen["kept"], chosen["threshold"]) == best


def test_logistic_map_is_the_penalised_optimum(spark):
    rng = random.Random(6)
    pairs = [(x, int(rng.random() < 1 / (1 + math.exp(-(2 * x + 1))))) for x in (rng.uniform(-3, 1) for _ in range(200))]
    df = spark.createDataFrame(pairs, "x double, y int")
    coefficient, intercept, n = calibration.fit_logistic(df, "x", "y")
    x, y = np.array(pairs).T
    design, w = np.stack([x, np.ones(n)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + np.array([w[0], 0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1.0, 0.0])
        w -= np.linalg.solve(hessian, gradient)
    assert (coefficient, intercept, n) == (pytest.approx(w[0], abs=1e-11), pytest.approx(w[1], abs=1e-11), 200)
    with pytest.raises(gates.GateError):
        calibration.fit_logistic(df.filter("y = 1"), "x", "y")


def test_a_word_has_the_same_stem_in_a_row_and_in_a_vocabulary(spark):
    made = [a + b for a in ("rat", "hopp", "sky", "y", "ye", "agre", "tri", "analog", "fall", "controll", "é", "") for b in (
        "", "s", "ies", "sses", "ied", "eed", "ed", "ing", "y", "ational", "alli", "logi", "ization", "iveness", "icate", "ical", "ion", "ement", "ate", "e", "ll"
    )]
    vocabulary = spark.createDataFrame([(w,) for w in sorted({*made, *stem.IRREGULAR})], "word string")
    assert all(stem.stem_of(r["word"]) == r["stem"] for r in stem.stemmed(vocabulary).collect())


def test_tokens_and_n_grams_of_a_key_never_become_rows(spark, rows):
    for scored in (
        textscore.sentence_bleu(rows, ["i"], "reference", "prediction"),
        textscore.corpus_bleu_counts(rows, ["i"], "reference", "prediction"),
        textscore.rouge_n(textscore.rouge_ready(rows, ["i"], "reference", "prediction"), ["i"]),
        textscore.meteor(rows, ["i"], "reference", "prediction"),
    ):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert not [step for step in ("Window", "Join", "gram#", "side#") if step in plan]


def test_rows_that_share_a_key_are_summed(rows):
    once = by_key(textscore.corpus_bleu_counts(rows, ["i"], "reference", "prediction"))
    twice = by_key(textscore.corpus_bleu_counts(rows.union(rows), ["i"], "reference", "prediction"))
    assert twice.keys() == once.keys()
    assert all(twice[i][c] == 2 * once[i][c] for i in once for c in ("m1", "m2", "m3", "m4", "r1", "p1"))
