import datetime as dt
import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.operators import intervals, ratings, sections, stats


def h60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_replicates(rows, n_boot, seed, statistic):
    clusters = {}
    for c, v in rows:
        clusters.setdefault(str(c), []).append(v)
    ids = sorted(clusters)
    n = len(ids)
    out = []
    for rep in range(n_boot):
        sample = []
        for slot in range(n):
            sample += clusters[ids[h60(f"{seed}|{rep}|{slot}") % n]]
        out.append(statistic(sample))
    return sorted(out)


def test_bootstrap_agrees_with_resampled_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(13), rng.random()) for _ in range(150)]
    df = spark.createDataFrame(rows, "c int, v double")
    ends = plain_replicates(rows, 200, 42, statistics.mean)
    for limit in (stats.BROADCAST_CLUSTERS, 1):  # broadcast and shuffled cluster sums
        monkeypatch.setattr(stats, "BROADCAST_CLUSTERS", limit)
        got = stats.cluster_bootstrap(df, "c", ["v"], n_boot=200).first()
        low, high = stats.interval_positions(200, 0.95)
        assert got["low"] == pytest.approx(ends[low]) and got["high"] == pytest.approx(ends[high])
        assert got["estimate"] == pytest.approx(statistics.mean(v for _, v in rows))
        assert (got["n_rows"], got["n_clusters"], got["n_boot"]) == (150, 13, 200)


def test_interval_positions():
    assert stats.interval_positions(2000, 0.95) == (50, 1949)


def test_bootstrap_of_nothing_has_no_estimate(spark):
    df = spark.createDataFrame([(1, 1.0)], "c int, v double").filter("c > 1")
    got = stats.cluster_bootstrap(df, "c", ["v"], n_boot=10).first()
    assert (got["estimate"], got["low"], got["high"], got["n_rows"], got["n_clusters"]) == (None, None, None, 0, 0)


def test_bootstrap_of_a_ratio_of_group_sums(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(7), rng.choice("ab"), rng.random()) for _ in range(90)]

    def plain(sample):
        groups = {}
        for g, v in sample:
            groups.setdefault(g, []).append(v)
        return sum(abs(sum(vs)) for vs in groups.values()) / len(sample) ** 2

    ends = plain_replicates([(c, (g, v)) for c, g, v in rows], 60, 42, plain)

    def statistic(sums):
        return sums.groupBy("replicate").agg((F.sum(F.abs("v")) / F.pow(F.sum("n"), F.lit(2))).alias("estimate"))

    df = spark.createDataFrame(rows, "c int, g string, v double").withColumn("n", F.lit(1))
    got = stats.cluster_bootstrap_statistic(df, "c", ["g"], ["v", "n"], statistic, n_boot=60).first()
    low, high = stats.interval_positions(60, 0.95)
    assert got["low"] == pytest.approx(ends[low]) and got["high"] == pytest.approx(ends[high])
    assert got["estimate"] == pytest.approx(plain([(g, v) for _, g, v in rows]))


def test_a_bootstrap_draw_is_not_counted_per_position_first(spark):
    df = spark.createDataFrame([(c, "a", float(c)) for c in range(9)], "c int, g string, v double")
    seen = []

    def total(sums):
        seen.append(sums._jdf.queryExecution().optimizedPlan().toString())
        return sums.groupBy("replicate").agg(F.sum("v").alias("estimate"))

    stats.cluster_bootstrap_statistic(df, "c", ["g"], ["v"], total, n_boot=20).first()
    assert not any("times#" in plan for plan in seen)


def test_active_months_touch_the_month_at_either_end(spark):
    day = dt.date
    rows = [("a", day(2026, 1, 31), day(2026, 3, 1), "x"), ("b", day(2026, 2, 10), day(2026, 2, 10), "x"),
            ("same month, backwards", day(2026, 2, 20), day(2026, 2, 3), "x"), ("backwards", day(2026, 4, 1), day(2026, 2, 3), "x")]
    tasks = spark.createDataFrame(rows, "task string, start date, finish date, category string")
    got = sorted((r["task"], r["month_start"].month) for r in intervals.active_months(tasks).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("same month, backwards", 2)]
    assert {(r[0].month, r[1], r[2]) for r in intervals.monthly_workload(tasks).collect()} == {(1, "x", 1), (2, "x", 3), (3, "x", 1)}


def test_unknown_categories_have_no_colour(spark):
    rows = spark.createDataFrame([("VLM",), ("other",)], "category string")
    got = {r[0]: r[1] for r in intervals.with_lookup(rows, intervals.colour_table(spark), "category").collect()}
    assert got == {"VLM": "rgb(255, 140, 0)", "other": None}


DOCUMENT = """lost words
# Title
intro
#### still text
## Part one
- point **bold** and **more**
---
lost again
  ---
### Deep
*all italic*
**Sub**:

plain"""


def test_sections_and_lines(spark):
    docs = spark.createDataFrame([(1, DOCUMENT), (2, "# Only"), (3, "nothing"), (4, "---\n## A \nx\n"), (5, "#none\n# "), (6, "")], "d int, t string")
    got = {}
    for r in sections.sections(docs, "d", "t").orderBy("d", "section_no").collect():
        got.setdefault(r["d"], []).append((r["type"], r["level"], r["text"], r["content"]))
    assert got[1] == [
        ("title", 1, "Title", "intro\n#### still text"),
        ("heading", 2, "Part one", "- point **bold** and **more**"),
        ("separator", None, None, None),
        ("separator", None, None, None),
        ("heading", 3, "Deep", "*all italic*\n**Sub**:\n\nplain"),
    ]
    assert got[2] == [("title", 1, "Only", "")]
    assert 3 not in got and 6 not in got
    assert got[4] == [("separator", None, None, None), ("heading", 2, "A", "x\n")]
    assert got[5] == [("title", 1, "", "")]
    numbers = [r["section_no"] for r in sections.sections(docs.filter("d = 1"), "d", "t").orderBy("section_no").collect()]
    assert numbers == [1, 2, 3, 4, 5]
    parts = sections.sections(docs.filter("d = 1"), "d", "t").filter("content is not null")
    lines = [(r["kind"], r["line"], r["bold"]) for r in sections.content_lines(parts, ["d", "section_no"]).orderBy("section_no", "line_no").collect()]
    assert lines == [
        ("paragraph", "intro", []), ("paragraph", "#### still text", []),
        ("bullet", "point **bold** and **more**", ["bold", "more"]), ("italic", "all italic", []),
        ("subheading", "**Sub**:", ["Sub"]), ("paragraph", "plain", []),
    ]


def test_kappa_entropy_and_quality(spark):
    marks = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    got = ratings.cohen_kappa(marks, "a", "b").first()
    assert (got["observed"], got["expected"], got["kappa"]) == (0.7, pytest.approx(0.5), pytest.approx(0.4))
    repeats = spark.createDataFrame([("i", "x"), ("i", "x"), ("i", "y"), ("j", "z")], "i string, a string")
    entropy = {r["i"]: r for r in ratings.answer_entropy(repeats, "i", "a").collect()}
    assert entropy["i"]["entropy"] == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    assert entropy["i"]["disagreement"] == pytest.approx(1 / 3) and entropy["j"]["entropy"] == 0.0
    quality = ratings.classification_quality(marks.withColumn("g", F.lit("x")), "g", F.col("a") == 1, F.col("b") == 1).first()
    assert (quality["precision"], quality["recall"]) == (pytest.approx(2 / 3), 0.8)
    assert quality["f1"] == pytest.approx(40 / 55) and quality["accuracy"] == 0.7


def test_reliability_of_folds_and_shrinkage(spark):
    rows = spark.createDataFrame([("c", 0, "x", 1), ("c", 0, "y", 0), ("c", 1, "x", 1), ("d", 1, "x", 0)], "c string, f int, a string, y int")
    folds = {(r["c"], r["f"]): r["reliability"] for r in ratings.fold_reliability(rows, "c", "f", "y").collect()}
    assert folds == {("c", 0): 1.0, ("c", 1): 0.5, ("d", 1): None}
    shrunk = {(r["c"], r["a"]): r["reliability"] for r in ratings.shrunken_reliability(rows, "c", "a", "y", 3.0).collect()}
    assert shrunk[("c", "x")] == pytest.approx((2 + 3 * 2 / 3) / 5) and shrunk[("c", "y")] == pytest.approx(2 / 4)


def log_likelihood(units, a, b):
    rising = lambda x, n: math.lgamma(x + n) - math.lgamma(x)
    return sum(rising(a, k) + rising(b, n - k) - rising(a + b, n) for n, k in units)


def test_beta_binomial_stands_at_the_peak(spark):
    rnd = random.Random(4)
    rows, by = [], {}
    for c, strength in (("tight", 60.0), ("loose", 2.0), ("skew", 8.0)):
        for i in range(400):
            p, n = rnd.betavariate(strength * 0.3, strength * 0.7), rnd.randrange(1, 40)
            k = sum(rnd.random() < p for _ in range(n))
            rows.append((c, n, k))
            by.setdefault(c, []).append((n, k))
    found = ratings.beta_binomial(spark.createDataFrame(rows, "c string, n long, k long"), "c").collect()
    assert {r.kind for r in found} == {"fitted"}
    for r in found:
        a, b = r.strength * r.class_mean, r.strength * (1 - r.class_mean)
        top = log_likelihood(by[r.c], a, b)
        for fa in (0.99, 1.0, 1.01):
            for fb in (0.99, 1.0, 1.01):
                assert log_likelihood(by[r.c], a * fa, b * fb) <= top + 1e-9
        assert r.class_mean == pytest.approx(0.3, abs=0.06)
    strengths = {r.c: r.strength for r in found}
    assert strengths["loose"] < strengths["skew"] < strengths["tight"]


def test_classes_without_a_peak(spark):
    rows = [("wrong", "a", 0)] * 5 + [("wrong", "b", 0)] * 2 + [("right", "a", 1)] * 3
    rows += [("split", a, int(a < "c")) for a in "abcd" for _ in range(6)]
    rows += [("even", a, i % 2) for a in "abcd" for i in range(6)] + [("single", a, int(a > "b")) for a in "abcd"]
    rows += [(None, a, int(i < n)) for a, n in (("a", 1), ("b", 5), ("c", 3)) for i in range(6)] + [("none", "a", None), ("right", "z", None)]
    df = spark.createDataFrame(rows, "c string, a string, y int")
    found = {(r.c, r.a): r for r in ratings.fitted_reliability(df, "c", "a", "y").collect()}
    kinds = {c: r.kind for (c, _), r in found.items()}
    assert kinds == {"wrong": "constant", "right": "constant", "split": "separate", "even": "pooled", "single": "pooled", None: "fitted"}
    assert [found["split", a].reliability for a in "abcd"] == [1, 1, 0, 0] and found["split", "a"].class_mean == 0.5
    assert found["wrong", "b"].reliability == 0 and found["even", "a"].reliability == 0.5 and found["even", "a"].strength is None
    assert found["right", "z"].reliability == 1 and found["right", "z"].n == 0
    low, high = found[None, "a"].reliability, found[None, "b"].reliability
    assert 1 / 6 < low < 0.5 < high < 5 / 6
    assert ratings.fitted_reliability(df.limit(0), "c", "a", "y").count() == 0


@pytest.mark.parametrize("clusters", [1, 7, 5000, 20_000])
def test_split_draws_have_the_moments_of_resampling(clusters):
    n_boot = 400
    blocks = range(-(-clusters // stats.BLOCK))
    times = np.concatenate([np.concatenate([t for _, t in stats.multiplicities(clusters, b, n_boot, 5)]) for b in blocks], axis=1)
    assert times.shape == (n_boot, clusters) and (times.sum(axis=1) == clusters).all()
    again = np.concatenate([t for _, t in stats.multiplicities(clusters, 0, n_boot, 5)])
    assert (again == times[:, : again.shape[1]]).all()
    if clusters > 1:
        share = 1 / clusters
        assert times.mean() == pytest.approx(1) and times.var() == pytest.approx(1 - share, rel=0.05)
        pairs = times[:, :-1] * times[:, 1:]  # neighbours are drawn a little less often together
        assert pairs.mean() == pytest.approx(1 - share, rel=0.05)
        if len(blocks) > 1:
            first = times[:, : stats.BLOCK].sum(axis=1)
            p = stats.BLOCK / clusters
            assert first.mean() == pytest.approx(clusters * p, rel=0.02) and first.var() == pytest.approx(clusters * p * (1 - p), rel=0.35)


def test_split_bootstrap_equals_its_own_draws_and_makes_no_row_per_draw(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(rnd.randrange(900), rnd.choice("ab"), rnd.random()) for _ in range(5000)]
    df = spark.createDataFrame(rows, "c int, g string, v double")
    order = sorted({str(c) for c, _, _ in rows})
    place = {c: i for i, c in enumerate(order)}
    times = np.concatenate([t for _, t in stats.multiplicities(len(order), 0, 300, 42)])
    sums, counts, by_group = np.zeros(len(order)), np.zeros(len(order)), {g: np.zeros(len(order)) for g in "ab"}
    for c, g, v in rows:
        sums[place[str(c)]] += v
        counts[place[str(c)]] += 1
        by_group[g][place[str(c)]] += v
    low, high = stats.interval_positions(300, 0.95)
    monkeypatch.setattr(stats, "_draws", None)
    got = stats.cluster_bootstrap(df, "c", ["v"], n_boot=300, draws="split").first()
    means = np.sort(times @ sums / (times @ counts))
    assert (got.low, got.high) == (pytest.approx(means[low]), pytest.approx(means[high])) and got.n_clusters == len(order)

    def largest(sums):
        return sums.groupBy("replicate").agg(F.max("v").alias("estimate"))

    got = stats.cluster_bootstrap_statistic(df, "c", ["g"], ["v"], largest, n_boot=300, draws="split").first()
    tops = np.sort(np.maximum(times @ by_group["a"], times @ by_group["b"]))
    assert (got.low, got.high) == (pytest.approx(tops[low]), pytest.approx(tops[high]))
    nothing = stats.cluster_bootstrap(df.limit(0), "c", ["v"], n_boot=10, draws="split").first()
    assert (nothing.estimate, nothing.n_clusters) == (None, 0)
    with pytest.raises(ValueError):
        stats.cluster_bootstrap(df, "c", ["v"], draws="other")
