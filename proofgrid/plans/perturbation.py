"""Catalogue: maps, masks, the intervention grid, effects, result ingest."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from proofgrid.functions.keys import hash60, joined
from proofgrid.operators import intervene, saliency
from proofgrid.plans import inputs
from proofgrid.plans.inputs import GRID_SIDE, METHODS, table
from proofgrid.plans.registry import query
from proofgrid.plans.sqltext import h60, seed32
from proofgrid.session import shared_folder, stored
from proofgrid.sources import files, shapes
from proofgrid.streaming import ingest

DESIGN = intervene.Design(methods=METHODS)
CELLS = GRID_SIDE * GRID_SIDE
SCORER = intervene.linear_scorer([inputs.patch_weight(i) for i in range(CELLS)])

# ---- SQL building blocks -----------------------------------------------------------

_ITEMS = f"""
items AS MATERIALIZED (
  SELECT 'v' || vec_id AS item_id, 's' || (vec_id % 97) AS source_img_id, label, embedding,
    list_transform(embedding, lambda v: 127.0::DOUBLE + 100.0::DOUBLE * v::DOUBLE) AS vals FROM embeddings)"""

_rank = lambda x: f"list_transform(list_sort(list_transform({x}, lambda v, i: {{'v': v, 'i': i - 1}})), lambda s: s.i)"
_drawn = lambda seed: f"list_transform(range(0, {CELLS}), lambda i: {h60(f'{seed} || chr(124) || i')})"

_MASK_CELLS = ", ".join(f"('{m}', {f}::DOUBLE, '{mode}', {r})" for m, f, mode, r in DESIGN.masks())

_MASKS = f"""{_ITEMS},
ranked AS MATERIALIZED (
  SELECT item_id, '{METHODS[0]}' AS method, -1 AS repeat, {_rank('embedding')} AS ord FROM items UNION ALL
  SELECT item_id, '{METHODS[1]}', -1, {_rank('list_reverse(embedding)')} FROM items UNION ALL
  SELECT item_id, 'random_map', r, {_rank(f"list_transform({_drawn('seed')}, lambda h: h / 1152921504606846976.0::DOUBLE)")}
  FROM (SELECT item_id, r, {seed32("'42|' || item_id || '|random_map|' || r")} AS seed FROM items, range(0, 5) t(r))),
cells(method, fraction, mode, repeat) AS (VALUES {_MASK_CELLS}),
placed AS (
  SELECT i.*, c.*, greatest(1, CAST(round_even({CELLS} * fraction, 0) AS INT)) AS k,
    {seed32("'42|' || item_id || '|' || c.method || '|' || CAST(c.fraction AS VARCHAR) || '|' || c.repeat")} AS seed
  FROM items i, cells c),
masks AS MATERIALIZED (
  SELECT p.item_id, p.source_img_id, p.label, p.vals, p.method, p.fraction, p.mode, p.repeat, p.k,
    list_sort(CASE p.mode WHEN 'targeted' THEN r.ord[{CELLS} - p.k + 1:{CELLS}] WHEN 'least_salient' THEN r.ord[1:p.k]
      ELSE {_rank(_drawn('p.seed'))}[1:p.k] END) AS mask
  FROM placed p JOIN ranked r ON r.item_id = p.item_id AND r.method = p.method
    AND r.repeat = CASE WHEN p.method = 'random_map' THEN p.repeat ELSE -1 END)"""


def _smooth_sql(values: str, along_rows: bool) -> str:
    """One pass of the smoothing over the patches of a row, or of a column."""
    place, step = ("i % 8", 1) if along_rows else ("i // 8", 8)
    weight = {d: f"{math.exp(-d * d / 2)!r}::DOUBLE" for d in (-1, 0, 1)}
    term = lambda d, what: f"CASE WHEN ({place} + {d}) BETWEEN 0 AND 7 THEN {weight[d]}{what} ELSE 0 END"
    weighted = " + ".join(term(d, f" * {values}[CAST(i + {d * step} + 1 AS INT)]") for d in (-1, 0, 1))
    return f"list_transform(range(0, {CELLS}), lambda i: ({weighted}) / ({' + '.join(term(d, '') for d in (-1, 0, 1))}))"


_score_sql = lambda x: f"list_sum(list_transform({x}, lambda v, i: v * ((i - 1) % 5 - 2) / 8.0::DOUBLE))"

_GRID = f"""{_MASKS},
rowwise AS MATERIALIZED (SELECT item_id, {_smooth_sql("vals", True)} AS rv FROM items),
smooth AS MATERIALIZED (SELECT item_id, {_smooth_sql("rv", False)} AS sm FROM rowwise),
uses AS (
  SELECT m.*, u.intervention, u.treatment FROM masks m,
    (VALUES ('deletion', 'gray'), ('deletion', 'blur'), ('insertion', 'blur_baseline')) u(intervention, treatment)
  WHERE u.intervention = 'deletion' OR m.method <> 'random_map'),
grid AS (
  SELECT uses.item_id, source_img_id, label, method, intervention, treatment, fraction, mode, repeat,
    substr(sha256(uses.item_id || '|' || method || '|' || intervention || '|' || treatment || '|' || printf('%.6f', fraction)
      || '|' || mode || '|' || repeat), 1, 24) AS intervention_id,
    {_score_sql('vals')} AS original_fixed_answer_mean_logprob,
    {_score_sql('''list_transform(vals, lambda v, i: CASE
        WHEN intervention = 'insertion' THEN CASE WHEN list_contains(mask, i - 1) THEN v ELSE sm[i] END
        WHEN NOT list_contains(mask, i - 1) THEN v WHEN treatment = 'gray' THEN 127.0::DOUBLE ELSE sm[i] END)''')}
      AS fixed_answer_mean_logprob
  FROM uses JOIN smooth ON smooth.item_id = uses.item_id)"""

_LEVELS = """
lev AS (
  SELECT item_id, source_img_id, method, treatment, fraction,
    max(fixed_answer_mean_logprob) FILTER (mode = 'targeted') AS targeted_fixed_answer_mean_logprob,
    avg(fixed_answer_mean_logprob) FILTER (mode = 'random') AS random_fixed_answer_mean_logprob
  FROM grid WHERE intervention = 'deletion' AND method <> 'random_map' GROUP BY ALL)"""

_EFFECT = "random_fixed_answer_mean_logprob - targeted_fixed_answer_mean_logprob"

_ITEM_EFFECTS = f"""{_GRID}, {_LEVELS},
eff AS (
  SELECT item_id, source_img_id, method, treatment, avg({_EFFECT}) AS mean_targeted_deletion_effect FROM lev GROUP BY ALL)"""

# ---- maps --------------------------------------------------------------------------


def _raw_maps(spark, sf):
    """Vectors as maps, some of them spoilt: constant, not finite, or of a wrong shape."""
    h = hash60(joined(F.lit("raw"), F.col("vec_id")))
    values = (
        F.when(h % 20 == 0, F.transform("embedding", lambda v: F.lit(0.5).cast("float")))
        .when(h % 20 == 1, F.transform("embedding", lambda v, i: F.when(i == 7, F.lit(float("inf")).cast("float")).otherwise(v)))
        .when(h % 20 == 2, F.slice("embedding", 1, 60))
        .otherwise(F.col("embedding"))
    )
    return table(spark, sf, "embeddings").select("vec_id", values.alias("raw"), F.lit(8).alias("height"), F.lit(8).alias("width"))


_RAW = f"""raw AS (SELECT vec_id, {h60("'raw|' || vec_id")} % 20 AS h, embedding FROM embeddings)"""


@query(
    "j4_valid_maps",
    f"""WITH {_RAW}, ok AS (SELECT vec_id, embedding, list_min(embedding) AS lo, list_max(embedding) AS hi FROM raw WHERE h > 2)
    SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda v: CAST(((v - lo)::FLOAT / (hi - lo)::FLOAT)::FLOAT AS DOUBLE))) AS DOUBLE) AS total,
      list_position(embedding, hi) - 1 AS top_patch FROM ok""",
    doubles=("total",),
)
def valid_maps(spark, sf):
    """Maps that pass validation, scaled to [0, 1]."""
    valid, _ = saliency.validate(_raw_maps(spark, sf))
    return valid.select(
        "vec_id", F.aggregate("normalised", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"),
        (F.array_position("normalised", F.lit(1.0).cast("float")) - 1).cast("bigint").alias("top_patch"),
    )


@query(
    "j4_excluded_maps",
    f"""WITH {_RAW} SELECT vec_id, CASE h WHEN 0 THEN 'constant' WHEN 1 THEN 'non-finite' ELSE 'shape' END AS reason
    FROM raw WHERE h <= 2""",
)
def excluded_maps(spark, sf):
    """Maps that are excluded, and why."""
    _, excluded = saliency.validate(_raw_maps(spark, sf))
    return excluded.select("vec_id", "reason")


@query(
    "j5_k4_patch_masks",
    f"""WITH {_MASKS} SELECT item_id, method, fraction, mode, CAST(repeat AS BIGINT) AS repeat,
      array_to_string(mask, ',') AS mask FROM masks""",
    doubles=("fraction",),
)
def patch_masks(spark, sf):
    """Every mask of every item; treatments of one level and repeat share theirs."""
    masks = intervene.mask_table(inputs.map_items(spark, sf), DESIGN)
    return masks.select(
        "item_id", "method", "fraction", "mode", F.col("repeat").cast("bigint").alias("repeat"),
        F.array_join("mask", ",").alias("mask"),
    )


@query(
    "j6_random_maps",
    f"""WITH {_ITEMS}, s AS (
      SELECT item_id, r AS repeat, {seed32("'42|' || item_id || '|random_map|' || r")} AS seed FROM items, range(0, 5) t(r))
    SELECT item_id, repeat, list_sum(list_transform({_drawn('seed')}, lambda h: h / 1152921504606846976.0::DOUBLE)) AS total,
      list_max(list_transform({_drawn('seed')}, lambda h: h / 1152921504606846976.0::DOUBLE)) AS highest FROM s""",
    doubles=("total", "highest"),
)
def random_maps(spark, sf):
    """Seeded uniform maps, five per item."""
    from proofgrid.functions.keys import stable_seed

    repeats = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat")
    rows = inputs.map_items(spark, sf).select("item_id", "values", repeats)
    seed = stable_seed(F.lit(42), F.col("item_id"), F.lit("random_map"), F.col("repeat"))
    maps = rows.select("item_id", F.col("repeat").cast("bigint").alias("repeat"), saliency.random_map(F.col("values"), seed).alias("m"))
    return maps.select(
        "item_id", "repeat", F.aggregate("m", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("m").alias("highest")
    )


# ---- the grid ----------------------------------------------------------------------


def interventions(spark, sf):
    return intervene.run(inputs.map_items(spark, sf), SCORER, GRID_SIDE, DESIGN)


@query(
    "d8_intervention_grid",
    f"""WITH {_ITEMS}, cells(method, fraction, mode, repeat) AS (VALUES {_MASK_CELLS}),
    uses(intervention, treatment) AS (VALUES ('deletion', 'gray'), ('deletion', 'blur'), ('insertion', 'blur_baseline'))
    SELECT item_id, method, intervention, treatment, fraction, mode, CAST(repeat AS BIGINT) AS repeat,
      substr(sha256(item_id || '|' || method || '|' || intervention || '|' || treatment || '|' || printf('%.6f', fraction)
        || '|' || mode || '|' || repeat), 1, 24) AS intervention_id
    FROM items, cells, uses WHERE intervention = 'deletion' OR method <> 'random_map'""",
    doubles=("fraction",),
)
def intervention_grid(spark, sf):
    """The 208 interventions of every item."""
    grid = intervene.grid(inputs.map_items(spark, sf).select("item_id"), DESIGN)
    return grid.withColumn("repeat", F.col("repeat").cast("bigint"))


_SCORED_COLUMNS = "intervention_id, item_id, method, intervention, treatment, fraction, mode, CAST(repeat AS BIGINT) AS repeat, original_fixed_answer_mean_logprob, fixed_answer_mean_logprob"
_SCORED_DOUBLES = ("fraction", "original_fixed_answer_mean_logprob", "fixed_answer_mean_logprob")


def _scored(rows):
    return rows.select(
        "intervention_id", "item_id", "method", "intervention", "treatment", "fraction", "mode",
        F.col("repeat").cast("bigint").alias("repeat"), "original_fixed_answer_mean_logprob", "fixed_answer_mean_logprob",
    )


@query("k1_k2_k3_scored_interventions", f"WITH {_GRID} SELECT {_SCORED_COLUMNS} FROM grid", doubles=_SCORED_DOUBLES)
def scored_interventions(spark, sf):
    """Deletion and insertion on the patch grid, scored with a linear scorer."""
    return _scored(interventions(spark, sf))


_WIDE, _WIDE_RADIUS, _WIDE_SIGMA, _PROBES = 32, 12, 6.0, (0, 31, 300, 528, 700, 992, 1023)


@query(
    "k1_wide_smoothing",
    f"""WITH {_ITEMS}, probe(cell) AS (VALUES {", ".join(f"({c})" for c in _PROBES)}),
    step(d, w) AS (SELECT d, exp(-d * d / {2 * _WIDE_SIGMA * _WIDE_SIGMA}::DOUBLE) FROM range(-{_WIDE_RADIUS}, {_WIDE_RADIUS + 1}) t(d)),
    near AS (
      SELECT cell, (cell // {_WIDE} + a.d) AS r, (cell % {_WIDE} + b.d) AS c, a.w * b.w AS w FROM probe, step a, step b
      WHERE cell // {_WIDE} + a.d BETWEEN 0 AND {_WIDE - 1} AND cell % {_WIDE} + b.d BETWEEN 0 AND {_WIDE - 1})
    SELECT item_id, CAST(cell AS INT) AS cell, sum(w * (vals[CAST((r // 4) * 8 + c // 4 + 1 AS INT)] + r - c)) / sum(w) AS smooth
    FROM items, near GROUP BY ALL""",
    doubles=("smooth",),
)
def wide_smoothing(spark, sf):
    """Smoothing over twelve patches in each direction on grids of 32 x 32, at some of their patches."""
    items = inputs.map_items(spark, sf)
    row, column = lambda i: F.floor(i / _WIDE).cast("int"), lambda i: i % _WIDE
    value = lambda i: F.get("values", F.floor(row(i) / 4).cast("int") * 8 + F.floor(column(i) / 4).cast("int")).cast("double") + row(i) - column(i)
    grids = items.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(_WIDE * _WIDE - 1)), value).alias("grid"))
    smooth = grids.select("item_id", intervene.smoothed(F.col("grid"), _WIDE, _WIDE_SIGMA, _WIDE_RADIUS).alias("smooth"))
    cells = F.transform(F.array(*[F.lit(c) for c in _PROBES]), lambda c: F.struct(c.alias("cell"), F.get("smooth", c).alias("smooth")))
    return smooth.select("item_id", F.inline(cells))


@query(
    "d9_pending_interventions",
    f"""WITH {_GRID} SELECT intervention_id FROM grid WHERE repeat >= 2""",
)
def pending_interventions(spark, sf):
    """What is left to do after a run with two random repeats."""
    items = inputs.map_items(spark, sf).select("item_id")
    done = intervene.grid(items, intervene.Design(methods=METHODS, random_repeats=2))
    return intervene.pending(intervene.grid(items, DESIGN), done).select("intervention_id")


@query("k5_resumed_run", f"WITH {_GRID} SELECT {_SCORED_COLUMNS} FROM grid", doubles=_SCORED_DOUBLES)
def resumed_run(spark, sf):
    """A short run, then the full design on top of its stored rows."""
    items = inputs.map_items(spark, sf)
    store = shared_folder(spark, "interventions")
    intervene.run_and_append(items, SCORER, GRID_SIDE, store, intervene.Design(methods=METHODS, random_repeats=2))
    return _scored(intervene.run_and_append(items, SCORER, GRID_SIDE, store, DESIGN))


@query(
    "k6_reconciled_maps",
    f"""WITH {_ITEMS}, m AS (
      SELECT item_id, unnest(['{METHODS[0]}', '{METHODS[1]}']) AS method, {h60("'map|' || item_id")} % 10 AS h FROM items)
    SELECT item_id, method, item_id || '__' || method || '.npz' AS path,
      CASE WHEN h = 0 THEN 'new' WHEN h = 1 THEN 'changed' ELSE 'kept' END AS state FROM m""",
)
def reconciled_maps(spark, sf):
    """Which maps are new, kept or changed against a stored manifest."""
    items = inputs.map_items(spark, sf)
    maps = items.select("item_id", "target_text", "model_revision", F.explode("maps").alias("method", "values"))
    path = F.concat(F.col("item_id"), F.lit("__"), F.col("method"), F.lit(".npz"))
    text = F.array_join(F.transform("values", lambda v: v.cast("string")), ",")
    current = maps.select("item_id", "method", path.alias("path"), F.sha2(text, 256).alias("sha256"), "target_text", "model_revision")
    h = hash60(joined(F.lit("map"), F.col("item_id"))) % 10
    stored = current.filter(h != 0).withColumn("target_text", F.when(h == 1, "another").otherwise(F.col("target_text")))
    return intervene.reconcile_maps(current, stored, ["target_text", "model_revision"]).drop("sha256")


# ---- effects -----------------------------------------------------------------------

_LEVEL_SQL = f"""WITH {_GRID}, {_LEVELS} SELECT *, {_EFFECT} AS targeted_deletion_effect FROM lev"""
_LEVEL_DOUBLES = (
    "fraction", "targeted_fixed_answer_mean_logprob", "random_fixed_answer_mean_logprob", "targeted_deletion_effect",
)


@query("e10_level_effects", _LEVEL_SQL, doubles=_LEVEL_DOUBLES)
def level_effects(spark, sf):
    """Random minus targeted score per item, method, treatment and level."""
    return intervene.level_effects(interventions(spark, sf))


@query("e11_item_effects", f"WITH {_ITEM_EFFECTS} SELECT * FROM eff", doubles=("mean_targeted_deletion_effect",))
def item_effects(spark, sf):
    """Mean effect over the levels."""
    return intervene.item_effects(intervene.level_effects(interventions(spark, sf)))


@query("k7_streamed_level_effects", _LEVEL_SQL, doubles=_LEVEL_DOUBLES)
def streamed_level_effects(spark, sf):
    """Results that arrive as files, some of them twice, through a stream; reduced from the stored table."""
    rows = interventions(spark, sf)
    arriving, store = shared_folder(spark, "arriving"), shared_folder(spark, "stored")
    sent = [c for c in shapes.INTERVENTION.fieldNames() if c in rows.columns]
    files.write_json_lines(rows.select(*sent), arriving, compression="gzip")
    again = files.read_json_lines(spark, arriving, shapes.INTERVENTION).filter("mode = 'targeted'")
    files.write_json_lines(again.select(*sent), arriving, mode="append", compression="gzip")
    ingest.ingest(ingest.result_stream(spark, arriving, shapes.INTERVENTION), store, shared_folder(spark, "stream")).awaitTermination()
    return intervene.level_effects(ingest.stored_results(spark, store))


@query("k7_incremental_effects", _LEVEL_SQL, doubles=_LEVEL_DOUBLES)
def incremental_effects(spark, sf):
    """Effects handed on level by level while results arrive as files, some of them twice."""
    rows = interventions(spark, sf)
    arriving, store = shared_folder(spark, "arriving"), shared_folder(spark, "effects")
    rows = stored(rows.select(*[c for c in shapes.INTERVENTION.fieldNames() if c in rows.columns]), "results")
    parts = F.conv(F.substring("intervention_id", 1, 4), 16, 10).cast("int") % 3
    files.write_json_lines(rows.filter((parts <= 1) & (F.col("mode") == "random") | (parts == 0)), arriving, compression="gzip")
    files.write_json_lines(rows.filter("mode = 'targeted'"), arriving, mode="append", compression="gzip")
    files.write_json_lines(rows.filter(parts >= 1), arriving, mode="append", compression="gzip")
    effects = ingest.effect_stream(ingest.arrivals(spark, arriving, shapes.INTERVENTION), DESIGN.random_repeats, "1 day")
    ingest.ingest(effects, store, shared_folder(spark, "stream")).awaitTermination()
    return ingest.stored_results(spark, store).filter("state = 'complete'").drop("state")


@query(
    "n5_insertion_auc",
    f"""WITH {_GRID}, pt AS (
      SELECT item_id, method, mode, fraction, avg(fixed_answer_mean_logprob) AS s FROM grid WHERE intervention = 'insertion' GROUP BY ALL),
    st AS (SELECT *, (fraction - lag(fraction) OVER w) * (s + lag(s) OVER w) / 2 AS step FROM pt
      WINDOW w AS (PARTITION BY item_id, method, mode ORDER BY fraction))
    SELECT item_id, method, mode, coalesce(sum(step), 0) AS auc FROM st GROUP BY ALL""",
    doubles=("auc",),
)
def insertion_auc(spark, sf):
    """Area under the insertion curve."""
    return intervene.insertion_auc(interventions(spark, sf))


@query(
    "n7_control_effects",
    f"""WITH {_GRID} SELECT method, treatment, mode, fraction, count(*) AS rows,
      avg(original_fixed_answer_mean_logprob - fixed_answer_mean_logprob) AS mean_drop
    FROM grid WHERE intervention = 'deletion' GROUP BY ALL""",
    doubles=("fraction", "mean_drop"),
)
def control_effects(spark, sf):
    """Targeted, least salient, random and random-map deletions side by side."""
    return intervene.control_effects(interventions(spark, sf))


_HIGH, _SURE, _SAME = 2.0, 0.7, 0.05

_ANSWERS_SQL = f"""
ans AS (
  SELECT item_id, label % 2 AS correct, {h60("'prob|' || item_id")} / 1152921504606846976.0::DOUBLE AS probability,
    abs(embedding[1]::DOUBLE) AS condition_spread FROM items)"""


def _answers(spark, sf):
    vectors = table(spark, sf, "embeddings")
    item = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return vectors.select(
        item.alias("item_id"), (F.col("label") % 2).alias("correct"),
        (hash60(joined(F.lit("prob"), item)) / F.lit(float(2**60))).alias("probability"),
        F.abs(F.col("embedding")[0].cast("double")).alias("condition_spread"),
    )


_CATEGORIES = f"""{_ITEM_EFFECTS}, {_ANSWERS_SQL},
pm AS (
  SELECT item_id, method, avg(mean_targeted_deletion_effect) AS effect,
    bool_or(mean_targeted_deletion_effect >= {_HIGH}) AND bool_or(mean_targeted_deletion_effect < {_HIGH}) AS split
  FROM eff GROUP BY ALL),
pi AS (
  SELECT item_id, avg(effect) AS effect, bool_or(effect >= {_HIGH}) AND bool_or(effect < {_HIGH}) AS method_disagreement,
    bool_or(split) AS treatment_disagreement FROM pm GROUP BY ALL),
cat AS (
  SELECT item_id, effect,
    (CASE WHEN correct = 1 THEN 'correct' ELSE 'incorrect' END) ||
      (CASE WHEN effect >= {_HIGH} THEN ', high sensitivity' ELSE ', low sensitivity' END) AS category,
    correct = 0 AND probability >= {_SURE} AS high_confidence_incorrect, condition_spread <= {_SAME} AS image_invariant,
    method_disagreement, treatment_disagreement
  FROM pi JOIN ans USING (item_id))"""


def categories(spark, sf):
    effects = intervene.item_effects(intervene.level_effects(interventions(spark, sf)))
    return intervene.failure_categories(effects, _answers(spark, sf), _HIGH, _SURE, _SAME)


@query("n8_failure_categories", f"WITH {_CATEGORIES} SELECT * FROM cat", doubles=("effect",))
def failure_categories(spark, sf):
    """Correctness by sensitivity, with the special cases flagged."""
    return categories(spark, sf)


@query(
    "n9_stratified_examples",
    f"""WITH {_CATEGORIES} SELECT item_id, category, CAST(row_number() OVER (
        PARTITION BY category ORDER BY {h60("'42|' || item_id")}, item_id) AS BIGINT) AS pick
    FROM cat QUALIFY pick <= 5""",
)
def stratified_examples(spark, sf):
    """Five examples of each category in hash order."""
    from proofgrid.operators import ratings

    picked = ratings.stratified_examples(categories(spark, sf), "category", "item_id", 5, 42)
    return picked.select("item_id", "category", F.col("pick").cast("bigint").alias("pick"))


# ---- map agreement -----------------------------------------------------------------

_REGION = "list_filter(range(0, 64), lambda i: i // 8 BETWEEN label % 6 AND label % 6 + 2 AND i % 8 BETWEEN label % 5 AND label % 5 + 2)"


@query(
    "n13_localisation",
    f"""WITH {_MASKS}, t AS (
      SELECT item_id, method, fraction, mask, {_REGION} AS region FROM masks WHERE mode = 'targeted' AND method <> 'random_map'),
    top AS (SELECT item_id, method, ord[64] AS best FROM ranked WHERE repeat = -1)
    SELECT item_id, method, fraction, len(list_intersect(mask, region)) / len(list_distinct(list_concat(mask, region))) AS iou,
      CAST(list_contains(region, best) AS DOUBLE) AS pointing_hit FROM t JOIN top USING (item_id, method)""",
    doubles=("fraction", "iou", "pointing_hit"),
)
def localisation(spark, sf):
    """Overlap of masks with a region, and whether the peak lies in it."""
    items = inputs.map_items(spark, sf)
    label = F.col("label")
    inside = lambda i: (
        F.floor(i / 8).between(label % 6, label % 6 + 2) & (i % 8).between(label % 5, label % 5 + 2)
    )
    region = F.filter(F.sequence(F.lit(0), F.lit(63)), inside)
    masks = intervene.mask_table(items.withColumn("region", region).withColumn("kept", F.col("maps")), DESIGN)
    masks = masks.filter("mode = 'targeted' and method <> 'random_map'")
    ranked = saliency.ranked_patches(F.try_element_at("kept", F.col("method")))
    return masks.select(
        "item_id", "method", "fraction", saliency.overlap(F.col("mask"), F.col("region")).alias("iou"),
        saliency.pointing_hit(ranked, F.col("region")).alias("pointing_hit"),
    )


_NOISE = "list_transform(embedding, lambda v, i: v::DOUBLE + r * (({h} / 1152921504606846976.0::DOUBLE) - 0.5::DOUBLE) * 0.1::DOUBLE)".format(
    h=h60("vec_id || '|' || r || '|' || (i - 1)")
)


@query(
    "n14_map_stability",
    f"""WITH m AS (SELECT vec_id, r, {_NOISE} AS v FROM embeddings, range(0, 4) t(r)),
    x AS (SELECT vec_id, r, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM m)
    SELECT a.vec_id, a.r AS repeat, corr(a.v, b.v) AS correlation FROM x a JOIN x b
      ON a.vec_id = b.vec_id AND a.i = b.i AND b.r = 0 WHERE a.r > 0 GROUP BY ALL""",
    doubles=("correlation",),
)
def map_stability(spark, sf):
    """Correlation of repeated maps with the first."""
    repeats = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("repeat")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", repeats)
    noise = lambda i: hash60(joined(F.col("vec_id"), F.col("repeat"), i)) / F.lit(float(2**60)) - 0.5
    noisy = F.transform("embedding", lambda v, i: v.cast("double") + F.col("repeat") * noise(i) * 0.1)
    return saliency.map_stability(rows.select("vec_id", "repeat", noisy.alias("values")), ["vec_id"], "repeat", "values")
