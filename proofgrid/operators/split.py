"""Leakage-safe grouped split, samples and the balanced one-row-per-group subset."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import keys
from proofgrid.operators.ranking import first_per_group, order_statistic, with_position
from proofgrid.session import durable, stored


def seeded_digest(seed: int, value: Column) -> Column:
    return F.sha2(keys.joined(F.lit(seed), value), 256)


def grouped_split(records: DataFrame, group: str, seed: int, dev_fraction: float, test_fraction: float) -> DataFrame:
    """Add ``partition``: whole groups go to test, development or train in hash order.

    The sizes are fixed shares of the group count, so two cut values of the hash decide
    everything. Finding them touches only distinct groups; the records are then labelled
    by an expression, without join or shuffle, however large a group is.
    """
    if not (0 < dev_fraction < 1 and 0 < test_fraction < 1):
        raise ValueError("each share must be above 0 and below 1")
    if dev_fraction + test_fraction >= 1:
        raise ValueError("test and development leave nothing for training")
    groups = durable(records.select(group).distinct().select(seeded_digest(seed, F.col(group)).alias("digest")))
    total = groups.count()
    if total == 0:
        return records.withColumn("partition", F.lit(None).cast("string"))
    # Python's round is half-even, as the sizes need.
    test_groups = max(1, round(total * test_fraction))
    dev_groups = max(1, round(total * dev_fraction))
    cut = lambda n: order_statistic(groups, "digest", min(n, total) - 1)
    digest = seeded_digest(seed, F.col(group))
    partition = F.when(digest <= cut(test_groups), "test").when(digest <= cut(test_groups + dev_groups), "development")
    return records.withColumn("partition", partition.otherwise("train"))


def assign_partitions(records: DataFrame, assignment: DataFrame, group: str) -> DataFrame:
    """Join records with a stored assignment; the small side is broadcast only if its size at run time allows."""
    return records.join(assignment, group)


def split_manifest(assigned: DataFrame, group: str) -> DataFrame:
    return assigned.select("partition", group).distinct()


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order: each task keeps its own best ``n``."""
    return df.orderBy(keys.hash60(keys.joined(F.lit(seed), F.col(key))), key).limit(n)


def head(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _pool(records: DataFrame, item: str, complexity: str, classes: str, seed: int) -> DataFrame:
    """Records with ``_tie``, which no two different ones share, and ``_strata``: complexity first, then classes."""
    stratum = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("stratum"))
    strata = F.concat(
        F.array(stratum("complexity", keys.stratum_text(F.col(complexity)))),
        F.transform(keys.labels_or_default(F.col(classes)), lambda c: stratum("class", c)),
    )
    content = F.sha2(F.to_json(F.struct(*records.columns)), 256)
    return records.withColumn("_tie", F.concat(seeded_digest(seed, F.col(item)), content)).withColumn("_strata", strata)


def balanced_subset(
    records: DataFrame, group: str, item: str, complexity: str, classes: str, seed: int, rounds: int = 1
) -> DataFrame:
    """One row per group, chosen so that complexities and classes stay balanced.

    A group takes its row with the lowest load: the count so far of the row's complexity
    plus the mean count so far of its classes; the seeded hash breaks ties. Groups are
    dealt to ``rounds`` of equal size in hash order, and a round sees the counts of the
    earlier ones. One round is a plain hash choice; as many rounds as groups is choosing
    group after group. The result says how many rounds there were.

    The pool is written by round, so a round reads its own rows only, and counts are carried on as one
    row per stratum. Rows of a group with equal items are told apart by their content.
    """
    pool = _pool(records, item, complexity, classes, seed)
    by_tie = [F.col("_tie")]
    if rounds == 1:
        return first_per_group(pool, [group], by_tie).drop("_tie", "_strata").withColumn("rounds", F.lit(1))
    groups = records.select(group).distinct().withColumn("_order", seeded_digest(seed, F.col(group)))
    dealt = with_position(groups, "_order", out="_place")
    total = dealt.count()
    turns = dealt.select(group, F.floor(F.col("_place") * rounds / total).cast("int").alias("_turn"))
    pool = stored(pool.join(turns, group), "pool", "_turn")
    chosen, counts = [], None
    for turn in range(rounds):
        here = pool.filter(F.col("_turn") == turn)
        if counts is not None:
            parts = here.select(group, "_tie", F.inline("_strata")).join(counts, ["kind", "stratum"], "left")
            mean_of = lambda kind: F.avg(F.when(F.col("kind") == kind, F.coalesce("n", F.lit(0))))
            loads = parts.groupBy(group, "_tie").agg((mean_of("complexity") + mean_of("class")).alias("load"))
            best = loads.groupBy(group).agg(F.min(F.struct("load", "_tie")).alias("best"))
            here = here.join(best.select(group, "best._tie"), [group, "_tie"], "left_semi")
        chosen.append(durable(first_per_group(here, [group], by_tie)))
        seen = chosen[-1].select(F.inline("_strata")).withColumn("n", F.lit(1).cast("long"))
        seen = seen if counts is None else seen.unionByName(counts)
        counts = stored(seen.groupBy("kind", "stratum").agg(F.sum("n").alias("n")), "strata")
    return reduce(DataFrame.unionByName, chosen).drop("_tie", "_strata", "_turn").withColumn("rounds", F.lit(rounds))


BLOCKS = 64  # blocks of groups at most, and so passes at most
LEAST_GROUPS = 4096  # groups of a block at least


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Choose group after group inside sorted blocks.

    Rows are ``block, position, tie, strata, n``. A block begins with its start counts (position -1, the
    stratum as tie); then come the rows of its groups. Out go the chosen rows (``n`` 0) and the
    block's own counts (position -1). Only the counts and the best row so far are held.
    """
    counts, own = Counter(), Counter()
    block = best = None
    out: list[tuple] = []

    def settle() -> None:
        nonlocal best
        if best is not None:
            _, position, tie, strata = best
            out.append((block, position, tie, 0))
            counts.update(strata)
            own.update(strata)
            best = None

    def close() -> None:
        settle()
        out.extend((block, -1, stratum, n) for stratum, n in own.items())
        counts.clear()
        own.clear()

    def handed() -> pa.RecordBatch:
        cells = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["block", "position", "tie", "n"])

    for batch in batches:
        for b, position, tie, strata, n in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if b != block:
                close()
                block = b
            if position < 0:
                counts[tie] = n
                continue
            if best is not None and position != best[1]:
                settle()
            load = counts[strata[0]] + sum(counts[s] for s in strata[1:]) / (len(strata) - 1)
            if best is None or (load, tie) < (best[0], best[2]):
                best = (load, position, tie, strata)
        yield handed()
    close()
    yield handed()


def balanced_sequence(
    records: DataFrame, group: str, item: str, complexity: str, classes: str, seed: int,
    blocks: int = BLOCKS, least_groups: int = LEAST_GROUPS,
) -> DataFrame:
    """The choice of ``balanced_subset`` made group after group in hash order, exactly; adds ``blocks`` and ``passes``.

    A choice depends on all earlier ones, but only through the counts per stratum. Groups in hash order
    are cut into blocks, and every pass lets all blocks choose at the same time, each from guessed start
    counts. What the blocks chose gives the next guess: the sums of all earlier blocks, or the counts at which
    the block before ended, in turn. A block whose start proves to be the sum of the blocks before it keeps
    its choice. When that holds for all, every choice is the sequential one: the first
    block starts right, and so does each after a right one. So each pass settles one more block at least, and
    many at once where blocks are long enough to forget how they started.

    Rows of a group with the same strata shrink to the one with the lowest hash first. A task reads a block's
    rows in order and holds the counts only; a block has ``least_groups`` groups, or a share of ``1 / blocks``
    of all if that is more. Counts per block and stratum stay in Spark; the driver gets block numbers.
    """
    pool = _pool(records, item, complexity, classes, seed)
    named = F.transform("_strata", lambda s: F.concat(F.substring(s["kind"], 1, 2), F.lit("|"), s["stratum"]))
    options = pool.select(group, "_tie", named.alias("strata")).groupBy(group, "strata").agg(F.min("_tie").alias("tie"))
    dealt = with_position(records.select(group).distinct().withColumn("_order", seeded_digest(seed, F.col(group))), "_order")
    total = dealt.count()
    size = max(least_groups, -(-total // blocks))
    last = -(-total // size) - 1
    placed = dealt.select(F.col(group).alias("_group"), "position", F.expr(f"position div {size}").alias("block"))
    rows = options.join(placed, F.col(group).eqNullSafe(F.col("_group")))
    rows = stored(rows.select("block", "position", "tie", "strata", F.lit(0).cast("long").alias("n")), "options", "block")
    rows = rows.select("block", "position", "tie", "strata", "n")  # the folder's column stands last
    # per block and stratum: the start count of its last pass, and what it chose then
    state = rows.limit(0).select("block", F.col("tie").alias("stratum"), F.col("n").alias("start"), F.col("n").alias("chosen"))
    starts = state.select("block", "stratum", F.col("start").alias("n"))
    active, passes, made, results = list(range(last + 1)), 0, {}, []
    while active:
        at = F.col("block").isin(active)
        here = starts.filter(at)
        heads = here.select("block", F.lit(-1).cast("long").alias("position"), F.col("stratum").alias("tie"), F.array().cast("array<string>").alias("strata"), "n")
        order = rows.filter(at).unionByName(heads).repartition(len(active), "block").sortWithinPartitions("block", "position", "tie")
        results.append(stored(order.mapInArrow(_chosen, "block long, position long, tie string, n long"), "choice"))
        made |= dict.fromkeys(active, passes)
        passes += 1
        begun = here.select("block", "stratum", F.col("n").alias("start"), F.lit(0).cast("long").alias("chosen"))
        own = results[-1].filter("position = -1").select("block", F.col("tie").alias("stratum"), F.lit(0).cast("long").alias("start"), F.col("n").alias("chosen"))
        state = stored(state.filter(~at).unionByName(begun).unionByName(own), "state")
        later = state.filter(F.col("block") < last)
        added = lambda df: df.groupBy("block", "stratum").agg(F.sum("n").alias("n"))
        sums = later.select(F.explode(F.sequence(F.col("block") + 1, F.lit(last))).alias("block"), "stratum", F.col("chosen").alias("n"))
        ends = later.select((F.col("block") + 1).alias("block"), "stratum", (F.col("start") + F.col("chosen")).alias("n"))
        differ = added(sums.unionByName(state.select("block", "stratum", (-F.col("start")).alias("n")))).filter("n <> 0")
        active = sorted(r["block"] for r in differ.select("block").distinct().collect())
        # the first block that is not settled takes its sums, which are right; the others the sums or the ends
        first = F.col("block") == (active[0] if active else 0)
        starts = added(sums if passes % 2 else ends.filter(~first).unionByName(sums.filter(first)))
    picked = [result.filter((F.col("position") >= 0) & F.col("block").isin([b for b, k in made.items() if k == i])).select("tie") for i, result in enumerate(results)]
    picked = [p for i, p in enumerate(picked) if i in made.values()]
    ties = stored(reduce(DataFrame.unionByName, picked), "picked") if picked else rows.select("tie").limit(0)
    kept = pool.join(ties, pool["_tie"] == ties["tie"], "left_semi")
    once = first_per_group(kept, [group], [F.col("_tie")]).drop("_tie", "_strata")  # repeated rows share a tie
    return once.withColumn("blocks", F.lit(last + 1)).withColumn("passes", F.lit(passes))
