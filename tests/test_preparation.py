import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from proofgrid.operators import audit, dedupe, gates, pairing, ranking, split


@pytest.fixture(scope="module")
def annotations(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(30)}"
        rows.append(
            (
                source, f"q{rng.randrange(12)}", f"a{rng.randrange(2)}", "train" if rng.random() < 0.7 else "test",
                rng.choice(["1", "2"]) if rng.random() < 0.1 else "1", i,
            )
        )
    return rows


@pytest.fixture(scope="module")
def frame(spark, annotations):
    rows = spark.createDataFrame(
        annotations, "source string, question_key string, answer_key string, origin string, complexity string, line int"
    )
    none = F.lit(None)
    return rows.withColumn(
        "digest", dedupe.metadata_digest(F.col("complexity"), none.cast("array<string>"), none.cast("string"))
    )


def collapsed(frame):
    rank = F.when(F.col("origin") == "train", 0).otherwise(1)
    return dedupe.collapse(frame, "origin", rank, "digest", [F.col("line")], ["line", "complexity"])


def test_dedupe_conflicts_and_report_agree_with_a_plain_model(frame, annotations):
    groups = defaultdict(list)
    for row in sorted(annotations, key=lambda r: (r[3] != "train", r[5])):
        groups[row[:3]].append(row)
    answers = Counter(k[:2] for k in groups)
    flagged = dedupe.flag_conflicts(collapsed(frame))
    got = {tuple(r[k] for k in dedupe.KEY): r for r in flagged.collect()}
    assert set(got) == set(groups)
    for key, rows in groups.items():
        row = got[key]
        origins = list(dict.fromkeys(r[3] for r in rows))
        differs = any(r[4] != rows[0][4] for r in rows)
        assert (row["rows"], row["line"], row["official_origins"]) == (len(rows), rows[0][5], origins)
        assert row["metadata_conflict"] == differs and row["answer_conflict"] == (answers[key[:2]] > 1)
    report = dedupe.merge_report(collapsed(frame)).first()
    clean = [k for k in groups if answers[k[:2]] == 1 and not got[k]["metadata_conflict"]]
    assert report["input_rows"] == len(annotations)
    assert report["input_rows"] - report["exact_duplicates_removed"] - report["conflicting_rows_removed"] == len(clean)
    assert report["primary_rows_after_exclusions"] == len(clean)
    assert report["primary_source_images_after_exclusions"] == len({k[0] for k in clean})
    assert report["conflicting_image_question_groups_removed"] == sum(n > 1 for n in answers.values())


def test_the_counts_of_a_merge_sort_no_rows(frame):
    plan = dedupe.merge_report(collapsed(frame))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_audits_agree_with_plain_sets(frame, annotations):
    triples = lambda s: {r[:3] for r in annotations if r[3] == s}
    got = audit.overlap_audit(frame, F.col("origin") == "train", F.col("origin") == "test").first()
    both = triples("train") & triples("test")
    assert got["overlapping_image_question_answer_triples"] == len(both)
    cut = lambda n, s: {t[:n] for t in triples(s)}
    assert got["overlapping_image_question_pairs"] == len(cut(2, "train") & cut(2, "test"))
    assert got["test_image_overlap_fraction"] == pytest.approx(len(cut(1, "train") & cut(1, "test")) / len(cut(1, "test")))
    rows = frame.withColumn("answer", F.lit("two words")).withColumn("image", F.col("source"))
    images = rows.sparkSession.createDataFrame([("hot",)], "path string")
    report = audit.dataset_audit(rows, images).first()
    assert report["total"] == 600 and report["mean_answer_words"] == 2.0
    assert report["repeated_exact_qa_pairs"] == 600 - len({r[:3] for r in annotations})
    assert report["missing_images"] == sum(r[0] != "hot" for r in annotations)


def test_empty_tables_give_empty_audits(frame):
    none = frame.filter("1 = 0")
    got = audit.overlap_audit(none, F.col("origin") == "train", F.col("origin") == "test").first()
    assert got["train_rows"] == 0 and got["test_image_overlap_fraction"] is None
    report = audit.dataset_audit(none.withColumn("answer", F.lit("")).withColumn("image", F.lit(""))).first()
    assert report["total"] == 0 and report["mean_answer_words"] == 0


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    numbers = [(rng.random(), rng.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(numbers, "x double, n int")
    got = {r["x"]: r["position"] for r in ranking.with_position(df, "x").collect()}
    assert [got[x] for x in sorted(got)] == list(range(3000))
    sums = {r["x"]: r["n_before"] for r in ranking.with_running_sums(df, [F.desc("x")], ["n"]).collect()}
    total = 0
    for x, n in sorted(numbers, reverse=True):
        assert sums[x] == total
        total += n


def test_order_statistic_of_hex_keys(spark):
    df = spark.range(9000).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    ordered = sorted(r["d"] for r in df.collect())
    for rank in (0, 17, 4500, 8999):
        assert ranking.order_statistic(df, "d", rank, small=50) == ordered[rank]


@pytest.mark.parametrize("groups", [1, 2, 5, 25, 97])
def test_grouped_split_is_whole_disjoint_and_sized(spark, groups):
    df = spark.range(groups * 3).select((F.col("id") % groups).cast("string").alias("g"))
    got = split.grouped_split(df, "g", 42, 0.1, 0.1)
    assert gates.shared_ids(got, "g", "partition").count() == 0 and got.count() == groups * 3
    sizes = Counter(r["partition"] for r in split.split_manifest(got, "g").collect())
    n = max(1, round(groups * 0.1))
    assert sizes["test"] == min(n, groups)
    assert sizes["development"] == min(n, groups - sizes["test"])


@pytest.mark.parametrize("dev, test", [(0.0, 0.1), (0.1, 1.0), (0.5, 0.5)])
def test_bad_fractions_fail(spark, dev, test):
    with pytest.raises(ValueError):
        split.grouped_split(spark.range(3).withColumn("g", F.col("id").cast("string")), "g", 1, dev, test)


def test_balanced_subset_with_one_round_per_group_is_the_sequential_choice(spark):
    import hashlib

    rng = random.Random(5)
    rows = []
    for i in range(60):
        classes = [] if rng.random() < 0.2 else [rng.choice("xyz") for _ in range(rng.randrange(1, 3))]
        rows.append((f"g{i % 9}", f"item{i}", rng.choice(["1", "2", None]), classes))
    digest = lambda v: hashlib.sha256(f"42|{v}".encode()).hexdigest()
    complexity, labels, wanted = Counter(), Counter(), []
    for group in sorted({r[0] for r in rows}, key=digest):
        def load(r):
            own = r[3] or ["unlabelled"]
            return complexity[str(r[2])] + sum(labels[c] for c in own) / len(own), digest(r[1])
        best = min((r for r in rows if r[0] == group), key=load)
        wanted.append(best[1])
        complexity[str(best[2])] += 1
        labels.update(best[3] or ["unlabelled"])
    df = spark.createDataFrame(rows, "source string, item_id string, complexity string, classes array<string>")
    got = split.balanced_subset(df, "source", "item_id", "complexity", "classes", 42, rounds=9)
    assert {r["item_id"] for r in got.collect()} == set(wanted)


@pytest.mark.parametrize("rounds", [1, 2])
def test_balanced_subset_takes_one_row_per_group_where_items_are_equal(spark, rounds):
    rows = [(g, "same", c, [c]) for g in "abcd" for c in "123"]
    df = spark.createDataFrame(rows, "source string, item_id string, complexity string, classes array<string>")
    take = lambda d: sorted(map(tuple, split.balanced_subset(d, "source", "item_id", "complexity", "classes", 42, rounds=rounds).drop("classes").collect()))
    assert [r[0] for r in take(df)] == list("abcd") and take(df) == take(df.orderBy(F.desc("complexity")))


def test_gates_fail_with_examples(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.5)], "k int, p double")
    with pytest.raises(gates.GateError, match="twice"):
        gates.enforce(gates.repeated_keys(df, "k"), "twice")
    assert gates.outside_unit_interval(df, "p").count() == 1
    gates.enforce(gates.repeated_keys(df, "k", "p"), "no violation")
    with pytest.raises(SparkRuntimeException):
        df.select(gates.require(F.col("p") < 1, F.col("p"), "too big")).collect()


def test_provenance_and_sides_treat_null_as_a_value(spark):
    now = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, rev string")
    then = spark.createDataFrame([(1, None), (2, None), (3, "b")], "k int, rev string")
    assert {r["k"] for r in gates.changed_provenance(now, then, ["k"], ["rev"]).collect()} == {2, 3}
    other = spark.createDataFrame([(2,), (9,)], "k int")
    assert {r["k"] for r in gates.one_sided_keys(now, other, "k").collect()} == {1, 3, 9}


def test_shifted_sources_wrap_around_and_need_two(spark):
    rows = spark.createDataFrame([("b", "pb"), ("a", "pa"), ("c", "pc"), ("a", "pz")], "source string, image string")
    got = {r[0]: r[1] for r in pairing.shifted_sources(rows, "source", "image", [F.col("image")]).collect()}
    assert got == {"a": "pb", "b": "pc", "c": "pa"}
    with pytest.raises(ValueError):
        pairing.shifted_sources(rows.filter("source = 'a'"), "source", "image", [F.col("image")])


def test_paired_differences_need_both_conditions(spark):
    rows = spark.createDataFrame(
        [("i", "s", "a", 1.0), ("i", "s", "b", 0.25), ("j", "s", "a", 1.0)], "item_id string, source string, c string, m double"
    )
    whole = pairing.paired_differences(rows.filter("item_id = 'i'"), "c", "a", "b", ["m"]).first()
    assert whole["m_difference"] == 0.75
    with pytest.raises(SparkRuntimeException):
        pairing.paired_differences(rows, "c", "a", "b", ["m"]).collect()


def test_predictions_are_gated_before_the_join(spark):
    subset = spark.createDataFrame([("i",), ("j",)], "item_id string")
    saved = spark.createDataFrame([("i", "x"), ("j", "y")], "item_id string, prediction string")
    assert pairing.with_predictions(subset, saved).count() == 2
    with pytest.raises(gates.GateError):
        pairing.with_predictions(subset, saved.filter("item_id = 'i'"))
    with pytest.raises(gates.GateError):
        pairing.with_predictions(subset, saved.union(saved))


def sequence_in_python(rows, seed):
    """The choice group after group, as the reference makes it."""
    digest = lambda v: hashlib.sha256(f"{seed}|{v}".encode()).hexdigest()
    groups = {}
    for source, item, cx, classes in rows:
        groups.setdefault(source, []).append((item, "None" if cx is None else str(cx), classes or ["unlabelled"]))
    by_cx, by_class, chosen = Counter(), Counter(), {}
    for source in sorted(groups, key=digest):
        load = lambda r: by_cx[r[1]] + sum(by_class[c] for c in r[2]) / len(r[2])
        item, cx, classes = min(groups[source], key=lambda r: (load(r), digest(r[0])))
        by_cx[cx] += 1
        by_class.update(classes)
        chosen[source] = item
    return chosen


@pytest.mark.parametrize("blocks, least", [(1, 4096), (12, 50)])
def test_balanced_sequence_is_the_sequential_choice(spark, blocks, least):
    rnd = random.Random(blocks)
    rows = []
    for g in range(2000):
        for i in range(rnd.randrange(1, 6)):
            classes = rnd.sample("abcdefg", rnd.randrange(0, 4)) or None
            rows.append((f"s{g}", f"s{g}-{i}", rnd.choice([None, 1, 2, 3]), classes))
    df = spark.createDataFrame(rows, "source string, item string, cx int, classes array<string>")
    found = split.balanced_sequence(df, "source", "item", "cx", "classes", 42, blocks=blocks, least_groups=least).collect()
    assert {r.source: r.item for r in found} == sequence_in_python(rows, 42) and len(found) == 2000
    assert {r.blocks for r in found} == {blocks} and all(r.passes <= blocks + 1 for r in found)


def test_long_blocks_that_forget_their_start_settle_at_once(spark):
    rows = [(f"s{g}", f"s{g}-{i}", i, ["a"]) for g in range(3000) for i in range(3)]
    df = spark.createDataFrame(rows, "source string, item string, cx int, classes array<string>")
    found = split.balanced_sequence(df, "source", "item", "cx", "classes", 42, blocks=8, least_groups=1).collect()
    assert {r.source: r.item for r in found} == sequence_in_python(rows, 42)
    assert {r.blocks for r in found} == {8} and all(r.passes <= 4 for r in found)


def test_balanced_sequence_of_odd_rows(spark):
    schema = "source string, item string, cx int, classes array<string>"
    assert split.balanced_sequence(spark.createDataFrame([], schema), "source", "item", "cx", "classes", 42).count() == 0
    rows = [(None, None, None, None), (None, None, None, None), ("a", "x", 1, []), ("a", "x", 1, [None])]
    found = split.balanced_sequence(spark.createDataFrame(rows, schema), "source", "item", "cx", "classes", 42).collect()
    assert sorted(str(r.source) for r in found) == ["None", "a"]


def test_split_audit_counts_every_kind(spark):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id long")
    sides = {"train": ids(1, 1, 2, 3, 9), "development": ids(4, 2), "test": ids(5, 3)}
    report = gates.split_audit(sides, ids(1, 2, 3, 4, 5, 6, 7, 7), "id")
    assert report.first().asDict() == {
        "train_ids": 4, "development_ids": 2, "test_ids": 2, "shared_train_development": 1, "shared_train_test": 1,
        "shared_development_test": 0, "unknown_ids": 1, "lost_ids": 2,
    }
    with pytest.raises(gates.GateError):
        gates.enforce_split(report)
    clean = gates.split_audit({"train": ids(1, 1), "test": ids(2)}, ids(1, 2, 3), "id")
    assert gates.enforce_split(clean)["lost_ids"] == 1
    nothing = gates.split_audit({"train": ids(), "test": ids()}, ids(), "id").first()
    assert set(nothing.asDict().values()) == {0}


def test_sketches_grow_by_new_files_and_stay_near(spark, tmp_path):
    rnd, read_files = random.Random(8), []
    rows = [(f"s{rnd.randrange(20_000)}", f"q{rnd.randrange(3)}", "a", f"f{i % 5}", "two words") for i in range(60_000)]
    df = spark.createDataFrame(rows, "source string, question_key string, answer_key string, file string, answer string").persist()

    def read(paths):
        read_files.append(list(paths))
        return df.filter(F.col("file").isin(paths))

    store = str(tmp_path / "sketches")
    audit.sketch_new_files(spark, read, ["f0", "f1", "f2"], "file", store)
    sketches = audit.sketch_new_files(spark, read, [f"f{i}" for i in range(5)], "file", store)
    assert read_files == [["f0", "f1", "f2"], ["f3", "f4"]] and sketches.count() == 5
    rough, exact = audit.sketched_audit(sketches).first(), audit.dataset_audit(df).first()
    assert (rough.total, rough.mean_answer_words) == (exact.total, exact.mean_answer_words)
    assert rough.unique_source_images == pytest.approx(exact.unique_source_images, rel=audit.SKETCH_ERROR)
    assert abs(rough.repeated_exact_qa_pairs - exact.repeated_exact_qa_pairs) <= audit.SKETCH_ERROR * exact.total
    train, test = F.col("file") < "f3", F.col("file") >= "f3"
    shared, true = audit.sketched_overlap(sketches, train, test).first(), audit.overlap_audit(df, train, test).first()
    assert (shared.train_rows, shared.test_rows) == (true.train_rows, true.test_rows)
    for c in ("overlapping_source_images", "overlapping_image_question_pairs", "overlapping_image_question_answer_triples"):
        assert abs(shared[c] - true[c]) <= audit.SKETCH_ERROR * 60_000
    small = audit.file_sketches(df.limit(500), "file")
    assert audit.sketched_audit(small).first().unique_source_images == df.limit(500).select("source").distinct().count()
    empty = audit.file_sketches(df.limit(0), "file")
    assert audit.sketched_audit(empty).first().total == 0 and audit.sketched_overlap(empty, train, test).first().overlapping_source_images == 0
