"""URL filter: pattern rules indexed by their rarest literal token; only fetched rules run regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm.common import ascii_lower

#: Words that stand for advertised junk when they are a whole part of a host name.
SPAM_WORDS = ("bets", "betting", "casino", "lottery", "pills", "poker", "porn", "slots", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    """A regular expression over ``host + path`` with its verdict.

    ``tokens`` are lower-case runs of letters and digits that every matching address holds as
    whole runs; without any, the rule is tried on every address. A listed rule beats an
    unlisted one, then the longer name wins, then the later name.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...] = field(default=())
    listed: bool = True


def prefix_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, with paths that start so."""
    host, slash, path = name.partition("/")
    literal = host + slash + path
    # a run at the end of the path may go on in the address, so it is no whole token
    runs = re.finditer(r"[a-z0-9]+", literal)
    tokens = tuple(dict.fromkeys(m[0] for m in runs if m.end() < len(literal)))
    return Rule(name, r"^(?:[^/]*\.)?" + re.sub(r"([^\w/])", r"\\\1", literal), verdict, tokens)


def host_word_rule(word: str, verdict: str = "block") -> Rule:
    """A word that stands alone between the separators of a host name."""
    return Rule(word, rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)", verdict, (word,), listed=False)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    text = lambda s: F.lit(s)
    rows = [
        F.struct(
            text(r.name).alias("name"), text(r.pattern).alias("pattern"), text(r.verdict).alias("verdict"),
            F.array(*[text(t) for t in r.tokens] or [text("")]).alias("tokens"), F.lit(r.listed).alias("listed"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cell = lambda i: F.coalesce(F.regexp_extract(url, parts, i), F.lit(""))
    return ascii_lower(cell(1)), cell(2)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``pattern_rule`` and ``verdict``.

    Work is done once per distinct address. Its tokens fetch the rules that are indexed under
    them; a rule is indexed under the one of its tokens that the fewest addresses hold (ties: the
    first by name), counted over all of them. Only fetched rules run their expression. Joins carry
    no hint: Spark broadcasts the index if it measures it as small and splits hot tokens or
    addresses otherwise.

    Null URLs and URLs without ``://`` have an empty address, which only rules for the empty
    address can match. Repeated rows each get their verdict; an empty table gives no rows.
    Columns named like the new ones are replaced.
    """
    host, path = host_and_path(F.col(url))
    made = {"host": host, "path": path}
    kept = pages.drop("rule", "pattern_rule", "verdict", "host", "path") if url not in made else pages
    placed = kept.withColumns(made)
    address = F.concat("host", "path")
    runs = F.array_distinct(F.array_append(F.regexp_extract_all(ascii_lower(F.col("address")), F.lit("[a-z0-9]+"), F.lit(0)), F.lit("")))
    addresses = placed.select(address.alias("address"), "host", "path").distinct()
    tokens = addresses.select("address", "host", "path", F.explode(runs).alias("token"))

    wanted = rules.select("name", "listed", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(seen, "token", "left")
        .groupBy("name", "listed")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    )
    index = rarest.join(rules.drop("tokens"), ["name", "listed"])
    hits = tokens.join(index, "token").filter(F.expr("regexp_like(address, pattern)"))
    best = F.max_by(F.struct("name", "listed", "verdict"), F.struct(F.col("listed"), F.length("name"), F.col("name")))
    judged = hits.groupBy("host", "path").agg(best.alias("_hit"))
    listed = F.col("_hit.listed")
    return placed.join(judged, ["host", "path"], "left").select(
        *placed.columns,
        F.when(listed, F.col("_hit.name")).alias("rule"),
        F.when(~listed, F.col("_hit.name")).alias("pattern_rule"),
        F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the query, most of them listed, the others by host words.
LISTED = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
RULES = [*[prefix_rule(n, v) for n, v in LISTED], *[host_word_rule(w) for w in SPAM_WORDS]]


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    judged = judge(pages.select("page_id", "url"), rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(name, verdict) AS (VALUES {", ".join(f"('{n}', '{v}')" for n, v in LISTED)}),
rules AS (SELECT name, verdict, split_part(name, '/', 1) AS h, substr(name, length(split_part(name, '/', 1)) + 1) AS q FROM r),
words(w) AS (VALUES {", ".join(f"('{w}')" for w in SPAM_WORDS)}),
a AS (SELECT DISTINCT host, path FROM p),
fits AS (
  SELECT host, path, max_by(struct_pack(n := name, v := verdict), struct_pack(l := length(name), n := name)) AS hit
  FROM a JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path),
spam AS (
  SELECT host, path, max_by(w, struct_pack(l := length(w), w := w)) AS w
  FROM a JOIN words ON regexp_matches(host, '(^|[^a-z0-9])' || w || '($|[^a-z0-9])') GROUP BY host, path)
SELECT page_id, p.host, p.path, hit.n AS rule,
  CASE WHEN hit.v IS NOT NULL THEN hit.v WHEN w IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN hit.v IS NULL THEN w END AS pattern_rule
FROM p LEFT JOIN fits USING (host, path) LEFT JOIN spam USING (host, path)
"""
