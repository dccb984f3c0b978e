"""Inputs that the derived tables lack: nulls, short passages, words in several groups, maps that cannot be used."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from proofgrid.operators import calibration, gates, intervene, stats, strata, textscore
from proofgrid.plans import preparation


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "p double, y int")


def test_null_confidences_fail_everywhere(spark):
    rows = scored(spark, [(0.9, 1), (0.8, 0), (None, 1), (None, 0)])
    with pytest.raises(gates.GateError):
        calibration.checked_summary(rows, "p", "y")
    for build in (
        calibration.calibration_bins, calibration.calibration_summary, calibration.risk_coverage, calibration.ranking_quality,
        lambda *a: calibration.selective_risk(*a, 0.5),
    ):
        with pytest.raises(SparkRuntimeException):
            build(rows, "p", "y").collect()
    assert gates.outside_unit_interval(scored(spark, [(float("nan"), 1), (0.5, 1)]), "p").count() == 1


def test_null_differences_fail_the_interval(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", None)], "s string, v double")
    with pytest.raises(SparkRuntimeException):
        stats.cluster_bootstrap(rows, "s", ["v"], n_boot=10).collect()


def test_report_of_a_fitted_map_holds_bins_and_risk(spark):
    rng = random.Random(3)
    made = [(-rng.random() * 3, 0) for _ in range(60)] + [(-rng.random(), 1) for _ in range(60)]
    rows = spark.createDataFrame(made, "x double, y int")
    report, calibrated = calibration.fit_and_evaluate(rows, rows, "x", "y")
    got = report.first()
    assert sum(b["n"] for b in got["bins"]) == got["n"] == 120 and [r["coverage"] for r in got["risk_coverage"]] == [0.25, 0.5, 0.75, 1.0]
    assert calibrated.count() == 120


def test_meteor_with_words_in_several_groups_stays_below_one(spark):
    rows = spark.createDataFrame(
        [(0, "big mass near lung", "large lump by lung"), (1, "big big", "large huge"), (2, "big", "none")],
        "i int, reference string, prediction string",
    )
    pairs = [(w, g) for w in ("big", "large", "huge") for g in ("size", "extent", "amount")] + [("mass", "a"), ("lump", "a"), ("mass", "b"), ("lump", "b"), ("near", "c"), ("by", "c"), (None, "c"), ("by", None)]
    groups = spark.createDataFrame(pairs, "word string, synonym_group string")
    got = {r["i"]: r["meteor"] for r in textscore.meteor(rows, ["i"], "reference", "prediction", synonyms=groups).collect()}
    assert got[0] == pytest.approx(1 - 0.5 / 4**3) and got[1] == pytest.approx(1 - 0.5 / 2**3) and got[2] == 0
    assert textscore.meteor(rows.limit(0), ["i"], "reference", "prediction", synonyms=groups).count() == 0


def test_passages_of_any_length_are_found_word_for_word(spark, monkeypatch):
    rng = random.Random(5)
    words = "a b c d e".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(30, None), (31, "")]
    passages = [(i, " ".join(rng.choice(words) for _ in range(1 + i % 9))) for i in range(36)]
    passages += [(100, docs[3][1]), (101, ""), (102, None), (103, "Quick  brown\tfox")]
    docs.append((40, "the quick brown fox runs"))
    tables = {
        "benchmark": spark.createDataFrame(passages, "item_id int, text string"),
        "documents": spark.createDataFrame(docs, "doc_id int, text string"),
    }
    monkeypatch.setattr(preparation, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(preparation.inputs, "documents", lambda spark, sf: tables["documents"])
    from proofgrid.functions import keys

    plain = {
        n: {r[0]: " ".join(r["w"]) for r in df.select(df.columns[0], keys.words(F.col("text")).alias("w")).collect() if r["w"] is not None}
        for n, df in tables.items()
    }
    want = {(p, d) for p, a in plain["benchmark"].items() for d, t in plain["documents"].items() if a and f" {a} " in f" {t} "}
    got = {(r["item_id"], r["doc_id"]) for r in preparation.contained_passages(spark, "").collect()}
    assert got == want and (103, 40) in got


def test_no_input_gives_one_overall_row(spark):
    rows = spark.createDataFrame([], "c int, k array<string>, m double")
    got = strata.stratified_means(rows, F.col("c"), F.col("k"), ["m"]).collect()
    assert [(r["stratum_kind"], r["stratum"], r["n"], r["m"]) for r in got] == [("overall", "all", 0, None)]
    two = spark.createDataFrame([("x", 1, ["a"], 1.0), ("y", 1, ["a"], 3.0)], "set string, c int, k array<string>, m double")
    got = strata.stratified_means(two, F.col("c"), F.col("k"), ["m"], by=("set",)).filter("stratum_kind = 'overall'").collect()
    assert {r["set"]: r["m"] for r in got} == {"x": 1.0, "y": 3.0}


def items(spark, maps):
    values = [float(i) for i in range(16)]
    row = ("i0", "s0", "t", "r", "a", values, {"m": maps})
    return spark.createDataFrame([row], "item_id string, source_img_id string, target_text string, model_revision string, adapter_revision string, values array<double>, maps map<string, array<double>>")



def mean_score(values):
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def test_maps_that_cannot_be_ranked_fail(spark):
    design = intervene.Design(methods=("m",), levels=(0.25,), random_repeats=1)
    for bad in ([1.0] * 16, [float("nan"), *[1.0, 2.0] * 7, 3.0], [None, *[1.0, 2.0] * 7, 3.0]):
        with pytest.raises(SparkRuntimeException):
            intervene.run(items(spark, bad), mean_score, 4, design).collect()
    for levels in ((0.0,), (1.5,)):
        with pytest.raises(ValueError):
            intervene.Design(levels=levels)


def test_a_changed_map_stops_a_resumed_run(spark, tmp_path):
    store = str(tmp_path / "store")
    few, more = (intervene.Design(methods=("m",), levels=(0.25,), random_repeats=n) for n in (1, 2))
    first = [float(i % 5 + i / 100) for i in range(16)]
    rows = intervene.run_and_append(items(spark, first), mean_score, 4, store, few)
    assert rows.filter("attribution_sha256 is null").count() == 0
    with pytest.raises(gates.GateError):
        intervene.run_and_append(items(spark, first[::-1]), mean_score, 4, store, more)
    assert intervene.run_and_append(items(spark, first), mean_score, 4, store, more).count() > rows.count() / 2
