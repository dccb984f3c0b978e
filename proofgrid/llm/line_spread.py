"""Line deduplication by spread: lines that occur on many distinct sites are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import WORD, n_words, row_key, stored

MIN_SITES = 10  # for a short line, which sites may also come to have in common by themselves
LONG_LINE = 20  # words; texts of this length do not agree by chance
LONG_MIN_SITES = 4  # for a long line: copies of one document lie on two or three sites
SKETCH_BITS = 12  # 4096 registers: a standard error of 1.6 per cent
MARGIN = 0.1  # estimates this near the threshold, six standard errors, are counted exactly
_BLANK = " \t\r\f\u000b"


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _exploded(documents: DataFrame, key: list[str]) -> DataFrame:
    """A row per line with a word: document key, site, place, and 128 bits that stand for the line."""
    # keys come first: beside the explosion they would be made of the whole text again for each line
    whole = documents.select(*row_key(*key), "doc_id", F.coalesce("source", F.lit("\u0001")).alias("site"), "text")
    kept = whole.select("_k1", "_k2", "doc_id", "site", F.posexplode(_lines()).alias("at", "raw"))
    line = F.trim(F.col("raw"), F.lit(_BLANK))
    hashed = kept.withColumn("line", line).filter("line <> ''")
    return hashed.select("_k1", "_k2", "doc_id", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), n_words(F.col("line")).alias("size"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, long_min_sites: int = LONG_MIN_SITES, long_line: int = LONG_LINE) -> DataFrame:
    """Lines (``h1, h2``) on enough sites, with the place of their first occurrence.

    A line of ``long_line`` words or more needs ``long_min_sites``, any other ``min_sites``.

    A sketch of sites per line is built inside each task and merged by the aggregation, so a line
    that is everywhere moves as one sketch per task. Lines whose estimate is within ``MARGIN`` of the
    threshold are counted again, exactly, as distinct (line, site) pairs.
    """
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2", "at")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.min(place).alias("first"), F.max("size").alias("size")
    )
    needed = F.when(F.col("size") >= long_line, long_min_sites).otherwise(min_sites)
    wide = stored(spread.filter(F.col("sites") >= F.floor(needed * (1 - MARGIN))), "line-spread")
    near = wide.filter(F.col("sites") <= F.ceil(needed * (1 + MARGIN))).select("h1", "h2")
    pairs = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi")
    exact = pairs.distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    judged = wide.join(exact, ["h1", "h2"], "left")
    return stored(judged.filter(F.coalesce("exact", "sites") >= needed).select("h1", "h2", "first"), "boilerplate")


def without_boilerplate(
    documents: DataFrame, min_sites: int = MIN_SITES, long_min_sites: int = LONG_MIN_SITES, long_line: int = LONG_LINE
) -> DataFrame:
    """``documents`` with ``clean_text``, ``n_lines`` (lines with a word) and ``n_removed``.

    A site is a source; null is a site of its own. A line is boilerplate from ``min_sites`` sites on, and from
    ``long_min_sites`` if it has ``long_line`` words or more. Lines are compared without white space at their
    ends. Each boilerplate line stays once, where it comes first by document id (null last), and place;
    all its other occurrences go. Blank lines are no lines here and stay.

    Only hashes of lines are grouped and joined. Marked places come back to their document by 128 bits
    over its id, source and text, and the text is cut in its row. No join carries a hint: the lines found
    are written to the shared folder, so Spark takes them to the documents' lines if the files are
    small, and else splits hot lines.

    Null text gives null, 0 and 0. Rows equal in id, source and text are treated alike, so a first
    occurrence stays in each of them. An empty table gives no rows; columns named like new ones are replaced.
    """
    key = ["doc_id", "source", "text"]
    lines = _exploded(documents, key)
    found = boilerplate(lines, min_sites, long_min_sites, long_line)
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2", "at")
    marked = lines.join(found, ["h1", "h2"]).filter(~first.eqNullSafe(F.col("first")))
    gone = marked.groupBy("_k1", "_k2").agg(F.collect_set("at").alias("_gone"))
    gone = gone.select(F.col("_k1").alias("_g1"), F.col("_k2").alias("_g2"), "_gone")
    own = documents.drop("clean_text", "n_lines", "n_removed")
    key1, key2 = row_key(*key, names=("_d1", "_d2"))
    joined = own.withColumns({"_d1": key1, "_d2": key2}).join(gone, (F.col("_d1") == F.col("_g1")) & (F.col("_d2") == F.col("_g2")), "left")
    # the text is split once, and places are taken out as a set: the work grows with the lines
    stays = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    cut = F.transform(F.array(_lines()), lambda lines: F.array_join(F.transform(stays(lines), lambda i: F.get(lines, i)), "\n"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.get(cut, 0))
    n_lines = F.size(F.filter(_lines(), lambda line: F.trim(line, F.lit(_BLANK)) != ""))
    return joined.select(
        *own.columns,
        F.when(F.col("text").isNotNull(), kept).alias("clean_text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )


def query(documents: DataFrame) -> DataFrame:
    cleaned = without_boilerplate(documents.select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "clean_text")


SQL = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l0 AS (SELECT doc_id, coalesce(source, chr(1)) AS site, lines, unnest(generate_series(1, len(lines))) AS pos FROM d),
l AS (SELECT doc_id, site, pos, trim(lines[pos], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l0),
n AS (SELECT doc_id, pos, line FROM l WHERE line <> ''),
b AS (SELECT line, min(struct_pack(d := doc_id, a := pos)) AS first FROM l WHERE line <> '' GROUP BY line 
  HAVING count(DISTINCT site) >= CASE WHEN len(regexp_extract_all(line, '{WORD}')) >= {LONG_LINE} THEN {LONG_MIN_SITES} ELSE {MIN_SITES} END),
gone AS (SELECT doc_id, list(pos) AS pos FROM n JOIN b USING (line) WHERE struct_pack(d := doc_id, a := pos) <> first GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(len(gone.pos), 0)::BIGINT AS n_removed,
  CASE WHEN text IS NULL THEN NULL WHEN gone.pos IS NULL THEN text
    ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone.pos, i)), chr(10)) END AS clean_text
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN c USING (doc_id)
"""
