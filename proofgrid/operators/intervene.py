"""The intervention grid: masks, perturbed patch grids, scores, resume and reduction to effects."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from proofgrid.functions import keys
from proofgrid.operators import gates, saliency
from proofgrid.session import together
from proofgrid.sources.files import stored_table

RANDOM_MAP = "random_map"
GREY = 127.0  # fixed value of the grey replacement


@dataclass(frozen=True)
class Design:
    """What is done to every item. The defaults are the fixed values of the study design."""

    methods: tuple[str, ...] = ("decoder_answer_to_image_attention", "answer_conditioned_grad_cam")
    levels: tuple[float, ...] = (0.05, 0.10, 0.20, 0.30)
    treatments: tuple[str, ...] = ("gray", "blur")
    random_repeats: int = 5
    insertion: bool = True
    seed: int = 42
    blur_sigma: float = 1.0  # in patches
    blur_radius: int = 1

    def __post_init__(self) -> None:
        if not all(0 < f <= 1 for f in self.levels):
            raise ValueError("a level is a share of the patches, above 0 and at most 1")

    def masks(self) -> list[tuple[str, float, str, int]]:
        """(method, fraction, mode, repeat) of every mask of an item."""
        repeats = {"targeted": 1, "least_salient": 1, "random": self.random_repeats}
        own = [(m, f, mode, r) for m in self.methods for f in self.levels for mode, n in repeats.items() for r in range(n)]
        control = [(RANDOM_MAP, f, "targeted", r) for r in range(self.random_repeats) for f in self.levels]
        return own + control

    def uses(self, method: str) -> list[tuple[str, str]]:
        """(intervention, treatment) of every use of a mask."""
        deletions = [("deletion", t) for t in self.treatments]
        return deletions + ([("insertion", "blur_baseline")] if self.insertion and method != RANDOM_MAP else [])


CELL = "array<struct<method string, fraction double, mode string, repeat int, uses array<struct<intervention string, treatment string>>>>"


def _cells(design: Design) -> Column:
    """The fixed grid as an array literal, so that it is exploded inside a row and never joined."""
    cells = [
        {"method": m, "fraction": f, "mode": mode, "repeat": r,
         "uses": [{"intervention": i, "treatment": t} for i, t in design.uses(m)]}
        for m, f, mode, r in design.masks()
    ]
    return F.from_json(F.lit(json.dumps(cells)), CELL)


def mask_seed(design: Design) -> Column:
    """One seed per item, method, level and repeat: all treatments and modes share it."""
    return keys.stable_seed(F.lit(design.seed), F.col("item_id"), F.col("method"), F.col("fraction"), F.col("repeat"))


def _with_ids(cells: DataFrame) -> DataFrame:
    c = F.col
    ident = keys.intervention_id(
        c("item_id"), c("method"), c("intervention"), c("treatment"), c("fraction"), c("mode"), c("repeat")
    )
    return cells.withColumn("intervention_id", ident)


def grid(items: DataFrame, design: Design = Design()) -> DataFrame:
    """Every intervention of every item, by id and parameters only."""
    masks = items.select("item_id", F.inline(_cells(design)))
    return _with_ids(masks.select("item_id", "method", "fraction", "mode", "repeat", F.inline("uses")))


def pending(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Interventions that are not stored yet."""
    return wanted.join(stored.select("intervention_id"), "intervention_id", "left_anti")


def smoothed(values: Column, width: int, sigma: float = 1.0, radius: int = 1) -> Column:
    """Gaussian mean over the patches up to ``radius`` away in both directions; weights outside the grid are left out.

    The kernel is a product, and so is the part of it inside the grid: one pass along the rows, then one along the
    columns of what that gave. Both read their weights from one short table, so the expression is
    the same for every radius, and a patch costs 2 (2 radius + 1) products.
    """
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(radius + 1)]
    weights = F.array(*[F.lit(w) for w in kernel])
    inside = F.array(*[F.lit(sum(kernel[abs(d)] for d in range(-radius, radius + 1) if 0 <= c + d < width)) for c in range(width)])
    offsets = lambda place, size: F.sequence(F.greatest(F.lit(-radius), -place), F.least(F.lit(radius), size - 1 - place))
    weight = lambda d: F.get(weights, F.abs(d))
    total = lambda place, size, what: F.aggregate(offsets(place, size), F.lit(0.0), lambda sum_, d: sum_ + weight(d) * what(d))
    cells = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
    height = lambda v: (F.size(v) / width).cast("int")

    def along(v: Column) -> Column:
        at = lambda i: total(i % width, F.lit(width), lambda d: F.get(v, i + d).cast("double")) / F.get(inside, i % width)
        return F.transform(cells(v), at)

    def down(v: Column) -> Column:
        row = lambda i: F.floor(i / width).cast("int")
        rows = F.transform(F.sequence(F.lit(0), F.greatest(height(v), F.lit(1)) - 1), lambda r: total(r, height(v), lambda d: F.lit(1.0)))
        at = lambda norm: lambda i: total(row(i), height(v), lambda d: F.get(v, i + d * width)) / F.get(norm, row(i))
        return saliency.bound(rows, lambda norm: F.transform(cells(v), at(norm)))

    return F.when(values.isNotNull(), saliency.bound(values, lambda v: saliency.bound(along(v), down)))


def _null_rows(lists: pa.ListArray) -> np.ndarray:
    return lists.is_null().to_numpy(zero_copy_only=False)


@F.arrow_udf(ArrayType(DoubleType()))
def _replaced(values: pa.Array, replacement: pa.Array, mask: pa.Array) -> pa.Array:
    starts, ends = values.offsets.to_numpy(), replacement.offsets.to_numpy()[1:]
    places = mask.flatten()
    rows = np.repeat(np.arange(len(mask)), mask.value_lengths().fill_null(0).to_numpy())
    rows, places = rows[places.is_valid().to_numpy(zero_copy_only=False)], places.drop_null().to_numpy()
    inside = (places >= 0) & (places < np.diff(starts)[rows]) & ~_null_rows(values)[rows]
    rows, places = rows[inside], places[inside]
    source = np.full(len(values.values), -2)  # stays as it is; -1 has no replacement
    new = replacement.offsets.to_numpy()[rows] + places
    source[starts[rows] + places] = np.where(new < ends[rows], new, -1)
    source, masked = source[source > -2], source > -2
    taken = replacement.values.take(pa.array(source, mask=source < 0))
    cells = pc.replace_with_mask(values.values, pa.array(masked), taken)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), cells, mask=pa.array(_null_rows(values)))


def deleted(values: Column, replacement: Column | Callable[[Column], Column], mask: Column) -> Column:
    """Masked patches replaced by those of another grid, or by ``replacement(patch number)``; the others as they were.

    Grids are handed to Arrow in batches: a lambda would look through the mask again for every patch.
    """
    if not isinstance(replacement, Column):
        made = replacement
        replacement = F.transform(values, lambda v, i: made(i))
    return _replaced(values.cast("array<double>"), replacement.cast("array<double>"), mask.cast("array<int>"))


def inserted(values: Column, baseline: Column, mask: Column) -> Column:
    """The baseline with the masked patches restored."""
    return deleted(baseline, values, mask)


def linear_scorer(weight: Callable[[Column], Column] | Sequence[float]) -> Callable[[Column], Column]:
    """A scorer that sums weighted patches; for tests and dry runs.

    ``weight`` of a patch number, or the weights of all patches. With the latter, grids are scored in Arrow batches, in
    the same pass as they are perturbed, and a grid of another size fails the job.
    """
    if not callable(weight):
        return _table_scorer(np.array(weight, float))

    def score(values: Column) -> Column:
        parts = F.transform(values, lambda v, i: v * weight(i))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    return score


def _table_scorer(weights: np.ndarray) -> Callable[[Column], Column]:
    def weighted_sum(values: pa.Array) -> pa.Array:
        known, cells = values.drop_null(), values.flatten()
        if (known.value_lengths().to_numpy() != len(weights)).any():
            raise ValueError(f"grids must have {len(weights)} patches")
        missing = cells.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(weights)).any(axis=1)
        parts = cells.to_numpy(zero_copy_only=False).reshape(-1, len(weights)) * weights
        total = np.zeros(len(known))
        for part in parts.T:  # patch after patch, like a sum over the grid
            total += part
        out, nulls = np.zeros(len(values)), _null_rows(values)
        out[~nulls], nulls[~nulls] = total, missing
        return pa.array(out, mask=nulls)

    return F.arrow_udf(weighted_sum, DoubleType())


def _random_order(design: Design, repeat: Column) -> Column:
    """Patches of the item ranked by the random map of one repeat."""
    seed = keys.stable_seed(F.lit(design.seed), F.col("item_id"), F.lit(RANDOM_MAP), repeat)
    return saliency.ranked_patches(saliency.random_map(F.col("values"), seed))


def mask_table(items: DataFrame, design: Design = Design()) -> DataFrame:
    """One row per mask with its patch numbers and its uses.

    ``items``: ``item_id, values, maps`` and whatever else is to be kept, where ``maps``
    is ``map<method, array>``. Items are shuffled once, before they grow, so what follows
    stays partitioned by item. Patches are ranked once per map, random maps
    included, not once per level. A map with a value that is no number, or with one value
    throughout, fails the job: leave such maps out with ``saliency.validate`` first.
    """
    return _masks(together(items, "item_id"), design)


def _masks(items: DataFrame, design: Design) -> DataFrame:
    usable = lambda v: ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (F.array_max(v) > F.array_min(v))
    ranked = F.transform_values("maps", lambda m, v: gates.require(usable(v), saliency.ranked_patches(v), "a map is not valid"))
    control = F.transform(F.sequence(F.lit(0), F.lit(design.random_repeats - 1)), lambda r: _random_order(design, r))
    ranks = items.withColumn("_ranked", ranked).withColumn("_control", control)
    cells = ranks.select("*", F.inline(_cells(design)))
    order = F.when(F.col("method") == RANDOM_MAP, F.get("_control", F.col("repeat"))).otherwise(
        F.try_element_at("_ranked", F.col("method"))
    )
    cells = cells.withColumn("_size", saliency.mask_size(F.col("values"), F.col("fraction")))
    drawn = saliency.random_mask(F.col("values"), mask_seed(design), F.col("_size"))
    unused = F.lit(None).cast("array<int>")
    ordered = saliency.patch_mask(order, unused, F.col("mode"), F.size("values"), F.col("_size"))
    mask = F.when(F.col("mode") == "random", drawn).otherwise(ordered)
    return cells.withColumn("mask", mask).drop("_ranked", "_control", "maps", "_size")


def run(
    items: DataFrame, scorer: Callable[[Column], Column], width: int, design: Design = Design(),
    stored: DataFrame | None = None,
) -> DataFrame:
    """Score every intervention that is not stored yet.

    ``items``: one row per item with ``item_id, source_img_id, target_text,
    model_revision, adapter_revision, values, maps``. The grid is exploded inside each
    item's row, where stored ids (at most one grid per item) are left out. The result is
    partitioned by item, so the reduction to effects shuffles nothing.
    """
    values = F.transform("values", lambda v: v.cast("double"))
    # dealt out before anything is worked out: a scan of few files has few tasks
    ready = with_map_hash(together(items, "item_id")).withColumn("values", values)
    if stored is not None:
        done = stored.groupBy("item_id").agg(F.collect_list("intervention_id").alias("_done"))
        ready = ready.join(done, "item_id", "left")
    ready = ready.withColumn("_smooth", smoothed(F.col("values"), width, design.blur_sigma, design.blur_radius)).withColumn(
        "original_fixed_answer_mean_logprob", scorer(F.col("values"))
    )
    cells = _with_ids(_masks(ready, design).select("*", F.inline("uses")).drop("uses"))
    if stored is not None:
        known = F.coalesce(F.array_contains("_done", F.col("intervention_id")), F.lit(False))
        cells = cells.filter(~known).drop("_done")
    smooth = F.col("_smooth")
    grey = F.array_repeat(F.lit(GREY), F.size("values"))
    insertion = F.col("intervention") == "insertion"  # restores values in the baseline, a deletion of the baseline's patches
    before = F.when(insertion, smooth).otherwise(F.col("values"))
    after = F.when(insertion, F.col("values")).when(F.col("treatment") == "gray", grey).otherwise(smooth)
    perturbed = deleted(before, after, F.col("mask"))
    scored = cells.withColumn("_perturbed", perturbed).withColumn("fixed_answer_mean_logprob", scorer(F.col("_perturbed")))
    return scored.drop("_perturbed", "_smooth", "values", "mask")


PROVENANCE = ["target_text", "model_revision", "adapter_revision", "attribution_sha256"]


def with_map_hash(items: DataFrame) -> DataFrame:
    """Items with the hash of all their maps, which each of their scores carries."""
    return items.withColumn("attribution_sha256", F.sha2(F.to_json(F.sort_array(F.map_entries("maps"))), 256))


def run_and_append(
    items: DataFrame, scorer: Callable[[Column], Column], width: int, store: str, design: Design = Design()
) -> DataFrame:
    """Append what is missing in the parquet folder ``store``; return all of it."""
    stored = stored_table(items.sparkSession, store)
    if stored is not None:
        gates.enforce(gates.repeated_keys(stored, "intervention_id"), "the store holds an intervention twice")
        now = with_map_hash(items).select("item_id", *PROVENANCE)
        changed = gates.changed_provenance(now, stored, ["item_id"], PROVENANCE)
        gates.enforce(changed.select("item_id"), "stored scores belong to another answer, model or map")
    run(items, scorer, width, design, stored).write.mode("append").parquet(store)
    return items.sparkSession.read.parquet(store)


def reconcile_maps(current: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """The manifest of maps (``item_id, method, path, sha256`` and ``fields``) with a state per row.

    ``new`` rows are to be computed, ``kept`` rows are as stored, ``changed`` rows must
    stop the run.
    """
    key = ["item_id", "method"]
    old = stored.select(*key, *[F.col(f).alias(f"_{f}") for f in ["sha256", *fields]], F.lit(True).alias("_stored"))
    same = F.lit(True)
    for f in ["sha256", *fields]:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    state = F.when(F.col("_stored").isNull(), "new").when(same, "kept").otherwise("changed")
    return current.join(old, key, "left").select(*key, "path", "sha256", state.alias("state"))


def level_effects(rows: DataFrame) -> DataFrame:
    """Per item, method, treatment and level: mean random score minus targeted score.

    Only deletions count, and not those of the random map. A level without exactly one
    targeted and at least one random score fails the job.
    """
    score = F.col("fixed_answer_mean_logprob")
    is_ = lambda mode: F.col("mode") == mode
    kept = rows.filter((F.col("intervention") == "deletion") & (F.col("method") != RANDOM_MAP))
    # The source follows from the item; as a key it keeps the aggregate a hash aggregate.
    grouped = kept.groupBy("item_id", "source_img_id", "method", "treatment", "fraction").agg(
        F.count_if(is_("targeted")).alias("_targeted"),
        F.count_if(is_("random")).alias("_random"),
        F.max(F.when(is_("targeted"), score)).alias("targeted_fixed_answer_mean_logprob"),
        F.avg(F.when(is_("random"), score)).alias("random_fixed_answer_mean_logprob"),
    )
    complete = (F.col("_targeted") == 1) & (F.col("_random") >= 1)
    effect = F.col("random_fixed_answer_mean_logprob") - F.col("targeted_fixed_answer_mean_logprob")
    message = "an effect needs exactly one targeted and at least one random score"
    return grouped.withColumn("targeted_deletion_effect", gates.require(complete, effect, message)).drop(
        "_targeted", "_random"
    )


def item_effects(levels: DataFrame, nested: bool = False) -> DataFrame:
    """Mean effect over the levels of each item, method and treatment; optionally with the levels nested."""
    cells = [F.avg("targeted_deletion_effect").alias("mean_targeted_deletion_effect")]
    if nested:  # as many entries as the design has levels
        level = F.struct(
            "fraction", "targeted_fixed_answer_mean_logprob", "random_fixed_answer_mean_logprob",
            "targeted_deletion_effect",
        )
        cells.append(F.sort_array(F.collect_list(level)).alias("per_level"))
    return levels.groupBy("item_id", "source_img_id", "method", "treatment").agg(*cells)


def insertion_auc(rows: DataFrame) -> DataFrame:
    """Trapezoid area under score over fraction, per item, method and mode; repeats are averaged first."""
    score = F.avg("fixed_answer_mean_logprob").alias("score")
    points = rows.filter("intervention = 'insertion'").groupBy("item_id", "method", "mode", "fraction").agg(score)
    along = Window.partitionBy("item_id", "method", "mode").orderBy("fraction")
    step = (F.col("fraction") - F.lag("fraction").over(along)) * (F.col("score") + F.lag("score").over(along)) / 2
    return points.withColumn("_step", step).groupBy("item_id", "method", "mode").agg(
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("auc")
    )


def control_effects(rows: DataFrame) -> DataFrame:
    """Per method, treatment and level: mean drop of the score for each mode, random map included."""
    drop = F.col("original_fixed_answer_mean_logprob") - F.col("fixed_answer_mean_logprob")
    deletions = rows.filter("intervention = 'deletion'")
    return deletions.groupBy("method", "treatment", "mode", "fraction").agg(
        F.count("*").alias("rows"), F.avg(drop).alias("mean_drop")
    )


def failure_categories(
    effects: DataFrame, answers: DataFrame, high_effect: float, high_confidence: float, same_score: float = 0.0
) -> DataFrame:
    """Operational categories per item.

    ``effects``: item effects for all methods and treatments; ``answers``: ``item_id,
    correct, probability, condition_spread`` where the spread is the largest difference
    of the item's score between image conditions.
    """
    effect = F.col("mean_targeted_deletion_effect")
    high = F.when(effect >= high_effect, 1).otherwise(0)
    per_method = effects.groupBy("item_id", "method").agg(
        F.avg(effect).alias("effect"), F.min(high).alias("low"), F.max(high).alias("high")
    )
    method_high = F.when(F.col("effect") >= high_effect, 1).otherwise(0)
    per_item = per_method.groupBy("item_id").agg(
        F.avg("effect").alias("effect"),
        (F.min(method_high) != F.max(method_high)).alias("method_disagreement"),
        F.max((F.col("low") != F.col("high")).cast("int")).cast("boolean").alias("treatment_disagreement"),
    )
    joined = per_item.join(answers, "item_id")
    sensitive = F.col("effect") >= high_effect
    name = F.concat(
        F.when(F.col("correct") == 1, "correct").otherwise("incorrect"),
        F.when(sensitive, ", high sensitivity").otherwise(", low sensitivity"),
    )
    return joined.select(
        "item_id", "effect", name.alias("category"),
        ((F.col("correct") == 0) & (F.col("probability") >= high_confidence)).alias("high_confidence_incorrect"),
        (F.col("condition_spread") <= same_score).alias("image_invariant"),
        "method_disagreement", "treatment_disagreement",
    )
