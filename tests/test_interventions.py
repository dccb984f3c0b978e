import glob
import math
import os

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from proofgrid import session
from proofgrid.functions import keys
from proofgrid.operators import gates, intervene, saliency
from proofgrid.plans import perturbation
from proofgrid.sources import files, shapes
from proofgrid.streaming import ingest

DESIGN = intervene.Design(methods=("m1", "m2"), random_repeats=2)
SCORER = intervene.linear_scorer(lambda i: (i + 1) / 4.0)


def items(spark, n=6, side=4):
    rng = np.random.default_rng(0)
    rows = [
        (f"i{k}", f"s{k % 2}", "t", "r1", None, [float(v) for v in rng.integers(0, 255, side * side)],
         {m: [float(v) for v in rng.random(side * side)] for m in DESIGN.methods})
        for k in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "item_id string, source_img_id string, target_text string, model_revision string, adapter_revision string, "
        "values array<double>, maps map<string, array<float>>",
    )


def test_maps_are_validated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 5.0], 2, 2), (2, [1.0] * 4, 2, 2), (3, [1.0, nan, 2.0, 3.0], 2, 2), (4, [1.0, inf, 2.0, 3.0], 2, 2),
            (5, [1.0, 2.0], 1, 2), (6, [1.0, 2.0, 3.0], 2, 2)]
    maps = spark.createDataFrame(rows, "i int, raw array<float>, height int, width int")
    valid, excluded = saliency.validate(maps)
    assert [(r["i"], r["normalised"]) for r in valid.collect()] == [(1, [0.0, 0.25, 0.5, 1.0])]
    assert {r["i"]: r["reason"] for r in excluded.collect()} == {
        2: "constant", 3: "non-finite", 4: "non-finite", 5: "shape", 6: "shape"
    }


@pytest.mark.parametrize(
    "mode, fraction, expected",
    [("targeted", 0.25, [2, 4]), ("least_salient", 0.25, [0, 1]), ("targeted", 0.01, [4]), ("targeted", 0.5, [2, 4, 5, 6])],
)
def test_masks_break_ties_by_patch_number_and_round_half_even(spark, mode, fraction, expected):
    # ten patches: a quarter is 2.5 and rounds to 2
    values = [0.0, 0.0, 0.9, 0.0, 0.9, 0.5, 0.5, 0.0, 0.0, 0.0] if fraction != 0.5 else [0.0, 0.0, 0.9, 0.0, 0.9, 0.5, 0.5, 0.0]
    v = F.array(*[F.lit(x) for x in values])
    size = saliency.mask_size(v, F.lit(fraction))
    mask = saliency.patch_mask(saliency.ranked_patches(v), F.lit(None).cast("array<int>"), F.lit(mode), F.size(v), size)
    assert spark.range(1).select(mask).first()[0] == expected


@pytest.mark.parametrize("patches, sizes", [(64, [3, 6, 13, 19]), (256, [13, 26, 51, 77])])
def test_mask_sizes(spark, patches, sizes):
    v = F.array_repeat(F.lit(0.0), patches)
    got = spark.range(1).select(*[saliency.mask_size(v, F.lit(f)) for f in (0.05, 0.1, 0.2, 0.3)]).first()
    assert list(got) == sizes


def test_grid_has_208_interventions_per_item_by_default(spark):
    grid = intervene.grid(spark.createDataFrame([("a",), ("b",)], "item_id string"))
    assert grid.count() == 416 and grid.select("intervention_id").distinct().count() == 416
    assert grid.filter("method = 'random_map' and intervention = 'insertion'").count() == 0


def test_one_random_mask_serves_all_treatments(spark):
    masks = intervene.mask_table(items(spark), DESIGN).filter("mode = 'random'")
    assert masks.groupBy("item_id", "method", "fraction", "repeat").count().filter("count > 1").count() == 0
    uses = {tuple(u) for r in masks.select("uses").distinct().collect() for u in r["uses"]}
    assert uses == {("deletion", "gray"), ("deletion", "blur"), ("insertion", "blur_baseline")}


def test_smoothing_is_a_weighted_mean_of_neighbours(spark):
    grid = np.arange(16.0).reshape(4, 4) ** 2
    got = spark.range(1).select(intervene.smoothed(F.array(*[F.lit(float(v)) for v in grid.ravel()]), 4)).first()[0]
    for r in range(4):
        for c in range(4):
            near = [(grid[y, x], math.exp(-((y - r) ** 2 + (x - c) ** 2) / 2)) for y in range(max(r - 1, 0), min(r + 2, 4))
                    for x in range(max(c - 1, 0), min(c + 2, 4))]
            assert got[r * 4 + c] == pytest.approx(sum(v * w for v, w in near) / sum(w for _, w in near))


def test_wide_smoothing_equals_the_direct_sum(spark):
    rng, size, radius, sigma = np.random.default_rng(7), 32, 12, 6.0
    grid = rng.random((size, size)) * 255
    df = spark.createDataFrame([([float(v) for v in grid.ravel()],), (None,), ([],)], "v array<double>")
    got, none, empty = (r[0] for r in df.select(intervene.smoothed(F.col("v"), size, sigma, radius)).collect())
    assert none is None and empty == []
    for i in [*range(0, size * size, 37), size * size - 1]:
        r, c = divmod(i, size)
        y, x = np.mgrid[max(r - radius, 0) : min(r + radius + 1, size), max(c - radius, 0) : min(c + radius + 1, size)]
        w = np.exp(-((y - r) ** 2 + (x - c) ** 2) / (2 * sigma**2))
        assert got[i] == pytest.approx(float((grid[y, x] * w).sum() / w.sum()), rel=1e-12)


def test_the_smoothing_plan_does_not_grow_with_the_radius(spark):
    df = spark.createDataFrame([([1.0] * 64,)], "v array<double>")
    plans = [df.select(intervene.smoothed(F.col("v"), 8, 2.0, r))._jdf.queryExecution().analyzed().toString() for r in (1, 12)]
    assert plans[0].count("get(") == plans[1].count("get(") and plans[0].count("lambda") == plans[1].count("lambda")


def test_deletion_and_insertion_are_complements(spark):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    values, base, mask = lit([1.0, 2.0, 3.0]), lit([9.0, 8.0, 7.0]), lit([1])
    got = spark.range(1).select(
        intervene.deleted(values, lambda i: F.get(base, i), mask), intervene.inserted(values, base, mask),
        intervene.deleted(values, lambda i: F.lit(127.0), mask),
    ).first()
    assert list(got) == [[1.0, 8.0, 3.0], [9.0, 2.0, 7.0], [1.0, 127.0, 3.0]]


def test_effects_are_random_minus_targeted_and_ignore_row_order(spark):
    rows = intervene.run(items(spark), SCORER, 4, DESIGN)
    plain = {}
    for r in rows.collect():
        if r["intervention"] == "deletion" and r["method"] != "random_map":
            plain.setdefault((r["item_id"], r["method"], r["treatment"], r["fraction"]), []).append(r)
    levels = intervene.level_effects(rows.orderBy(F.rand(1)))
    got = {(r["item_id"], r["method"], r["treatment"], r["fraction"]): r["targeted_deletion_effect"] for r in levels.collect()}
    assert set(got) == set(plain)
    for key, group in plain.items():
        score = lambda mode: [r["fixed_answer_mean_logprob"] for r in group if r["mode"] == mode]
        assert got[key] == pytest.approx(np.mean(score("random")) - score("targeted")[0])
    one = intervene.item_effects(levels, nested=True).filter("item_id = 'i0' and method = 'm1' and treatment = 'blur'").first()
    assert [x["fraction"] for x in one["per_level"]] == [0.05, 0.1, 0.2, 0.3]
    assert one["mean_targeted_deletion_effect"] == pytest.approx(np.mean([x["targeted_deletion_effect"] for x in one["per_level"]]))


def test_effects_need_one_targeted_and_some_random_scores(spark):
    rows = intervene.run(items(spark, 1), SCORER, 4, DESIGN)
    for broken in (rows.filter("mode != 'targeted'"), rows.filter("mode != 'random'"), rows.union(rows)):
        with pytest.raises(SparkRuntimeException):
            intervene.level_effects(broken).collect()


def test_resumed_runs_add_only_what_is_missing_and_guard_provenance(spark, tmp_path):
    store = str(tmp_path / "store")
    few = intervene.run_and_append(items(spark, 2), SCORER, 4, store, DESIGN)
    n = few.count()
    assert intervene.run_and_append(items(spark, 2), SCORER, 4, store, DESIGN).count() == n
    more = intervene.run_and_append(items(spark, 3), SCORER, 4, store, DESIGN)
    assert more.count() == n // 2 * 3 and more.select("intervention_id").distinct().count() == more.count()
    fresh = intervene.run(items(spark, 3), SCORER, 4, DESIGN)
    cols = ["intervention_id", "fixed_answer_mean_logprob"]
    assert more.select(*cols).exceptAll(fresh.select(*cols)).count() == 0
    with pytest.raises(gates.GateError):
        intervene.run_and_append(items(spark, 3).withColumn("model_revision", F.lit("r2")), SCORER, 4, store, DESIGN)


def test_stream_stores_each_result_once_and_equals_the_batch(spark, tmp_path):
    rows = intervene.run(items(spark, 3), SCORER, 4, DESIGN).withColumn("attribution_sha256", F.lit(None).cast("string"))
    rows = rows.select(*shapes.INTERVENTION.fieldNames())
    arriving, store, mark = (str(tmp_path / d) for d in ("arriving", "store", "mark"))
    files.write_json_lines(rows, arriving)
    take_in = lambda: ingest.ingest(ingest.result_stream(spark, arriving, shapes.INTERVENTION), store, mark).awaitTermination()
    take_in()
    files.write_json_lines(rows.filter("mode = 'targeted'"), arriving, mode="append")
    take_in()
    stored = ingest.stored_results(spark, store)
    assert stored.count() == rows.count()
    batch, stream = intervene.level_effects(rows), intervene.level_effects(stored)
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in stream.collect()}


def arriving_rows(spark):
    rows = intervene.run(items(spark, 3), SCORER, 4, DESIGN).withColumn("attribution_sha256", F.lit(None).cast("string"))
    return rows.select(*shapes.INTERVENTION.fieldNames()).persist()


def put(rows, folder, hours):
    """One file in the folder, written so many hours after the first."""
    before = set(glob.glob(f"{folder}/*.json"))
    files.write_json_lines(rows.coalesce(1), folder, mode="append")
    for path in set(glob.glob(f"{folder}/*.json")) - before:
        os.utime(path, (1_700_000_000 + 3600 * hours,) * 2)


def take_effects(spark, folder, store, mark, wait="2 hours"):
    stream = ingest.effect_stream(ingest.arrivals(spark, folder, shapes.INTERVENTION, 1), DESIGN.random_repeats, wait)
    query = ingest.ingest(stream, store, mark)
    query.awaitTermination()
    return query


def test_effects_are_handed_on_while_results_arrive(spark, tmp_path):
    rows = arriving_rows(spark)
    folder, store, mark = (str(tmp_path / d) for d in ("arriving", "store", "mark"))
    early = F.col("fraction") <= 0.1
    put(rows.filter(early & (F.col("mode") != "targeted")), folder, 0)
    take_effects(spark, folder, store, mark)
    assert ingest.stored_results(spark, store).count() == 0
    put(rows.filter(early), folder, 1)  # the random ones again, and the targeted ones
    take_effects(spark, folder, store, mark)
    want = {tuple(r) for r in intervene.level_effects(rows).collect()}
    done = lambda: {tuple(r) for r in ingest.stored_results(spark, store).filter("state = 'complete'").drop("state").select(*intervene.level_effects(rows).columns).collect()}
    assert done() == {r for r in want if r[4] <= 0.1}
    put(rows, folder, 2)
    take_effects(spark, folder, store, mark)
    assert done() == want and ingest.stored_results(spark, store).count() == len(want)


def test_state_of_effects_is_bounded_and_late_repeats_expire(spark, tmp_path):
    rows = arriving_rows(spark)
    folder, store, mark = (str(tmp_path / d) for d in ("arriving", "store", "mark"))
    ids = sorted(r[0] for r in rows.select("item_id").distinct().collect())
    for day, one in enumerate(ids):  # an item a day: the state holds one item, not all
        put(rows.filter(F.col("item_id") == one), folder, 24 * day)
    put(rows.filter((F.col("item_id") == ids[0]) & (F.col("mode") == "targeted")), folder, 24 * 5)  # long after its levels were finished
    query = take_effects(spark, folder, store, mark)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 2
    put(rows.filter(F.col("item_id") == ids[-1]), folder, 24 * 9)
    take_effects(spark, folder, store, mark)
    stored = ingest.stored_results(spark, store)
    levels = rows.filter((F.col("item_id") == ids[0]) & (F.col("mode") == "targeted") & (F.col("intervention") == "deletion") & (F.col("method") != intervene.RANDOM_MAP))
    assert stored.filter("state = 'expired'").count() == levels.count() > 0
    assert stored.filter((F.col("state") == "complete") & (F.col("item_id") == ids[0])).count() == levels.count()


def test_repeats_within_the_wait_are_dropped_and_ids_leave_the_state(spark, tmp_path):
    rows = arriving_rows(spark)
    folder, store, mark = (str(tmp_path / d) for d in ("arriving", "store", "mark"))
    ids = sorted(r[0] for r in rows.select("item_id").distinct().collect())
    for day, one in enumerate(ids):
        put(rows.filter(F.col("item_id") == one), folder, 24 * day)
        put(rows.filter((F.col("item_id") == one) & (F.col("mode") == "targeted")), folder, 24 * day + 1)
    query = ingest.ingest(ingest.result_stream(spark, folder, shapes.INTERVENTION, 1, wait="2 hours"), store, mark)
    query.awaitTermination()
    assert ingest.stored_results(spark, store).count() == rows.count()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 2 * rows.count() / len(ids) < rows.count()


def test_ids_of_an_item_are_one_state_and_its_rows_lie_together(spark, tmp_path):
    rows = arriving_rows(spark)
    folder, store, mark = (str(tmp_path / d) for d in ("arriving", "store", "mark"))
    part = F.conv(F.substring("intervention_id", 1, 4), 16, 10).cast("int") % 3
    put(rows.filter(part == 0).repartition(3), folder, 0)
    put(rows.filter(part <= 1).union(rows.filter("mode = 'targeted'")), folder, 1)
    put(rows.union(rows), folder, 2)
    query = ingest.ingest(ingest.result_stream(spark, folder, shapes.INTERVENTION, 1), store, mark)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 3 and max(held) == 3
    stored = ingest.stored_results(spark, store)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, rows.collect()))
    files_of_an_item = stored.select("item_id", F.input_file_name().alias("file")).filter("file like '%batch=2%'").groupBy("item_id")
    assert {r["n"] for r in files_of_an_item.agg(F.count_distinct("file").alias("n")).collect()} == {1}


def test_ids_that_do_not_follow_from_their_rows_are_taken_once_whatever_the_item(spark, tmp_path):
    own = arriving_rows(spark).filter("item_id = 'i0'").limit(1).collect()[0].asDict()
    given = {**own, "item_id": "a", "intervention_id": "x1", "target_text": "line\nz\u00e4\U0001f600", "attribution_sha256": None}
    bar = keys.intervention_id(*[F.lit(v) for v in ("a|m", "n", "d", "g", 0.1, "targeted", 0)])
    bar = spark.range(1).select(bar).first()[0]  # the id of an item "a" with the method "m|n" too
    barred = {"intervention_id": bar, "intervention": "d", "treatment": "g", "fraction": 0.1, "mode": "targeted", "repeat": 0}
    first = [own, given, {**given, "intervention_id": None}, {**given, **barred, "item_id": "a|m", "method": "n"}, {**own, "target_text": ""}]
    later = [{**given, "item_id": "b"}, {**given, "intervention_id": None, "item_id": None}, {**given, **barred, "item_id": "a", "method": "m|n"},
             {**given, "intervention_id": "x2", "target_text": "", "fraction": float("nan")}, own]
    folder, store, mark = (str(tmp_path / d) for d in ("arriving", "store", "mark"))
    rows = lambda given: spark.createDataFrame(given, shapes.INTERVENTION).coalesce(1)
    for hours, given_rows in enumerate((first, later, [])):
        put(rows(given_rows), folder, hours)
    ingest.ingest(ingest.result_stream(spark, folder, shapes.INTERVENTION, 1), store, mark).awaitTermination()
    want = rows([*first[:4], later[3]])
    assert sorted(map(repr, ingest.stored_results(spark, store).collect())) == sorted(map(repr, want.collect()))


def test_the_streamed_query_keeps_less_than_twenty_kilobytes_a_vector(spark, tmp_path, monkeypatch):
    rng, n = np.random.default_rng(5), 200
    vectors = spark.createDataFrame([(k, [float(v) for v in rng.normal(0, 1, 64)], k % 7) for k in range(n)], "vec_id bigint, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "sf/embeddings.parquet"))
    for module in (session, perturbation):
        monkeypatch.setattr(module, "shared_folder", lambda spark, name: str(tmp_path / "kept" / name))
    got = perturbation.streamed_level_effects(spark, str(tmp_path / "sf"))
    want = perturbation.level_effects(spark, str(tmp_path / "sf"))
    cols = ["item_id", "source_img_id", "method", "treatment", "fraction", "targeted_fixed_answer_mean_logprob"]
    assert got.count() == 16 * n and got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    kept = sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "kept/**/*"), recursive=True) if os.path.isfile(f))
    assert kept < 20_000 * n


def test_insertion_area(spark):
    rows = spark.createDataFrame(
        [("i", "m", "targeted", 0.1, 1.0), ("i", "m", "targeted", 0.3, 2.0), ("i", "m", "random", 0.1, 1.0), ("i", "m", "random", 0.1, 3.0)],
        "item_id string, method string, mode string, fraction double, fixed_answer_mean_logprob double",
    ).withColumn("intervention", F.lit("insertion"))
    got = {r["mode"]: r["auc"] for r in intervene.insertion_auc(rows).collect()}
    assert got == {"targeted": pytest.approx(0.3), "random": 0.0}


def test_correlation_of_constant_maps_is_null(spark):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    got = spark.range(1).select(
        saliency.correlation(lit([1.0, 2.0, 3.0]), lit([2.0, 4.0, 6.5])), saliency.correlation(lit([1.0, 1.0]), lit([1.0, 2.0]))
    ).first()
    assert got[0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) and got[1] is None


def test_map_manifest_states(spark):
    now = spark.createDataFrame([("a", "m", "p", "h", "t"), ("b", "m", "p", "h", "t"), ("c", "m", "p", "h", "t")],
                                "item_id string, method string, path string, sha256 string, target_text string")
    then = now.filter("item_id != 'a'").withColumn("sha256", F.when(F.col("item_id") == "c", "x").otherwise(F.col("sha256")))
    got = {r["item_id"]: r["state"] for r in intervene.reconcile_maps(now, then, ["target_text"]).collect()}
    assert got == {"a": "new", "b": "kept", "c": "changed"}


def test_seed_leaves_out_mode_and_treatment(spark):
    row = spark.createDataFrame([("i", "m", 0.05, 1)], "item_id string, method string, fraction double, repeat int")
    got = row.select(intervene.mask_seed(DESIGN), keys.stable_seed(F.lit(42), F.lit("i"), F.lit("m"), F.lit("0.05"), F.lit(1))).first()
    assert got[0] == got[1]


def test_random_masks_are_the_first_of_the_shuffled_patches_also_at_ties(spark, monkeypatch):
    rows = spark.createDataFrame([([0.0] * n, seed, k) for seed in range(8) for n, k in ((1, 1), (12, 3), (64, 19))] + [(None, 1, 1)],
                                 "v array<double>, seed bigint, k int")
    want = F.sort_array(F.slice(saliency.shuffled_patches(F.col("v"), F.col("seed")), 1, F.col("k")))
    pairs = lambda: rows.select(want.alias("want"), saliency.random_mask(F.col("v"), F.col("seed"), F.col("k")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in pairs())
    digits = saliency._hex
    monkeypatch.setattr(saliency, "_hex", lambda text: F.substring(digits(text), 1, 1))  # sixteen hashes for 64 patches
    want = F.sort_array(F.slice(saliency.shuffled_patches(F.col("v"), F.col("seed")), 1, F.col("k")))
    tied = pairs()
    assert all(r["got"] == r["want"] for r in tied) and len(tied) == 25


def test_masks_of_a_grid_of_ten_round_half_even(spark):
    got = spark.range(1).select(*[saliency.mask_size(F.array_repeat(F.lit(0.0), n), F.lit(f)) for n, f in ((10, 0.25), (10, 0.35), (6, 0.25), (3, 0.05))])
    assert list(got.first()) == [2, 4, 2, 1]


def test_replaced_patches_with_nulls_and_grids_of_all_sizes(spark):
    rows = [([1.0, None, 3.0], [7.0, 8.0, 9.0], [1, 2]), ([1.0, 2.0], [None, 5.0], [0]), (None, [1.0], [0]), ([], [], []), ([4.0], [5.0], None),
            ([1.0, 2.0, 3.0], [6.0], [0, 2, 9, None]), ([5.0], None, [0]), ([1.0] * 40, [2.0] * 40, list(range(0, 40, 2)))]
    df = spark.createDataFrame(rows, "v array<double>, r array<double>, m array<int>").coalesce(1)
    at = F.transform("v", lambda v, i: F.when(F.array_contains("m", i), F.get("r", i)).otherwise(v))
    for r in df.select(intervene.deleted(F.col("v"), F.col("r"), F.col("m")).alias("got"), at.alias("want")).collect():
        assert r["got"] == r["want"]
    assert df.filter("get(v, 0) = 5").select(intervene.inserted(F.col("v"), F.array(F.lit(2.0)), F.array(F.lit(0)))).first()[0] == [5.0]


def test_a_table_of_weights_scores_like_a_weight_function(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in rng.normal(0, 1e3, 16)],) for _ in range(50)] + [(None,), ([1.0] * 15 + [None],), ([float("nan")] * 16,)]
    df = spark.createDataFrame(rows, "v array<double>")
    table = intervene.linear_scorer([(i + 1) / 4.0 for i in range(16)])
    for r in df.select(SCORER(F.col("v")).alias("want"), table(F.col("v")).alias("got")).collect():
        assert r["got"] == r["want"] or (math.isnan(r["got"]) and math.isnan(r["want"]))
    with pytest.raises(Exception, match="16 patches"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(table(F.col("v"))).collect()


def test_scoring_works_on_whole_batches_after_items_are_dealt_out(spark):
    table = intervene.linear_scorer([(i + 1) / 4.0 for i in range(16)])
    got = intervene.run(items(spark), table, 4, DESIGN)
    cols = ["intervention_id", "original_fixed_answer_mean_logprob", "fixed_answer_mean_logprob"]
    want = {tuple(r) for r in intervene.run(items(spark), SCORER, 4, DESIGN).select(*cols).collect()}
    assert {tuple(r) for r in got.select(*cols).collect()} == want
    plan = got.select("item_id", "fixed_answer_mean_logprob")._jdf.queryExecution().executedPlan().toString()
    steps = plan.split("\n")  # the last step first
    grown = next(k for k, line in enumerate(steps) if "inline(uses" in line)
    assert "ArrowEvalPython" in plan and not any("lambda" in line for line in steps[:grown])  # nothing patch by patch per intervention
    dealt = next(k for k, line in enumerate(steps) if "Exchange" in line)
    assert any("aggregate(" in line for line in steps[:dealt]) and not any("aggregate(" in line for line in steps[dealt:])  # smoothing comes after
