"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import n_words, partitions, row_key, stored
from proofgrid.operators.ranking import with_position, with_running_sums
from proofgrid.session import durable

WEIGHTS = (5, 2, 1)  # by code-point order of the sources, repeating
MOST = 3  # times a source, and so each of its documents, is taken at most
SEED = "mix-1"
PORTION = 1024  # copies of a repeated row that are written out at once


def targets(sized: DataFrame) -> DataFrame:
    """Per source: words, documents, documents of earlier sources, and the target.

    Targets share the words of all sources by weight; one that would pass ``MOST`` times its source
    stops there and its excess goes to the others by weight, until none is above. That is one level
    ``x`` with ``target = least(x * weight, MOST * words)``, found by repeated sums over the sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.lit(1).alias("one"))
    per = durable(with_running_sums(per, [F.col("source").asc_nulls_last()], ["n", "one"]))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("one_before") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else MOST * F.col("source_size") < F.lit(level) * F.col("weight")
        row = per.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, MOST * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"), F.sum(over.cast("long")).alias("stopped"),
        ).first()
        if not row["all"] or row["stopped"] == stopped:
            break
        level, stopped = (row["all"] - row["fixed"]) / row["open"], row["stopped"]
    target = F.least(F.lit(float(level or 0)) * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", F.col("n_before").alias("before"), target.alias("target"))


def copies(documents: DataFrame) -> DataFrame:
    """Per document: ``source``, ``size``, ``source_size``, ``target`` and how many ``copies`` the mix takes.

    Inside a source every document is expected ``target / source_size`` times. Documents stand in
    order of size, then id and text; the prefix sum of their expected copies is their place times
    that rate. With one random offset per source, a document is emitted once for each whole number
    that its interval crosses. In order of size, the words taken differ from the target by about one
    document at most. Places come from a range partitioning with offsets per range, so a source of
    any size is spread over all tasks.

    Null text has size 0; null is a source of its own, the last. A source without words has target 0
    and gives no copies. Repeated rows stand one after the other. An empty table gives no rows.
    """
    sized = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), *row_key(*documents.columns))
    sized = durable(sized)
    per = targets(sized)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("_k1"), F.col("_k2")]
    placed = with_position(sized, *order).withColumnRenamed("source", "_source")
    joined = placed.join(per, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce("source", F.lit("\u0001")))), 1, 5), 16, 10).cast("double") / (1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    k = F.col("position") - F.col("before")
    crossed = F.floor((k + 1) * rate + offset) - F.floor(k * rate + offset)
    return joined.select("doc_id", "_k1", "_k2", "source", "size", "source_size", "target", F.least(crossed, F.lit(MOST)).cast("long").alias("copies"))


def mix(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it, with their own columns.

    Rows equal in all columns share the sum of their copies; the result has that many of them. They
    shrink to one row before they are written out again in portions, so that any number of them is
    spread over all tasks.
    """
    key = ["_k1", "_k2"]
    dealt = copies(documents).groupBy(*key).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows")).filter("_sum > 0")
    dealt = stored(dealt, "mix-copies")
    keyed = documents.select(F.struct(*documents.columns).alias("_row"), *row_key(*documents.columns))
    written = lambda rows: rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_sum").cast("int")))).select("_row.*")
    single = keyed.join(dealt.filter("_rows = 1"), key)
    repeated = stored(dealt.filter("_rows > 1"), "mix-repeated")  # a row per group, so that its size is measured
    once = keyed.join(repeated, key).groupBy(*key).agg(F.first("_row").alias("_row"), F.first("_sum").alias("_sum"))
    portions = once.select("_row", "_sum", F.explode(F.expr(f"sequence(0L, _sum - 1, {PORTION}L)")).alias("_from"))
    portions = portions.withColumn("_sum", F.least(F.col("_sum") - F.col("_from"), F.lit(PORTION))).repartition(partitions(documents))
    return written(single).unionByName(written(portions))


def query(documents: DataFrame) -> DataFrame:
    found = copies(documents)
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s, count(*) AS n FROM d GROUP BY source),
s AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s0),
r AS (SELECT *, sum(s) OVER () AS t, sum(w) OVER () AS all_w, coalesce(sum({MOST} * s) OVER b, 0) AS cs, coalesce(sum(w) OVER b, 0) AS cw, {MOST} * s / w AS ratio
  FROM s WINDOW b AS (ORDER BY {MOST} * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by((t - cs)::DOUBLE / (all_w - cw)::DOUBLE, ratio) AS x FROM r WHERE ratio >= (t - cs) / (all_w - cw)),
p AS (SELECT source, s AS source_size, least(x * w, ({MOST} * s)::DOUBLE) AS target FROM s, level),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k FROM d),
c AS (SELECT doc_id, k.source, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    ('0x' || substr(md5('{SEED}' || coalesce(k.source, chr(1))), 1, 5))::INT::DOUBLE / 1048576 AS u
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, source, least(floor((k + 1) * e + u) - floor(k * e + u), {MOST})::BIGINT AS copies,
  (least(floor((k + 1) * e + u) - floor(k * e + u), {MOST}) * size)::BIGINT AS taken
FROM c
"""
