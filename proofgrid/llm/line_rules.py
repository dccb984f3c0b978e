"""Quality rules, line first: lines that fail a rule go, then documents that lost too much go."""

from __future__ import annotations

import re
import sys
from collections.abc import Mapping

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"


def _endings() -> str:
    """What a sentence can end with, as the inside of a character class.

    Sentence ends of all scripts as Unicode lists them, quotation marks of either side (they close in one language or
    another), closing brackets beyond ASCII, and the letters of Thai and Lao, which end sentences without a mark.
    """
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    marks = regex.findall(r"(?V1)[\p{Sentence_Terminal}\p{Pi}\p{Pf}[\p{Pe}--[\x00-\x7f]]]", every)
    return "".join(rf"\U{ord(c):08x}" for c in [*"\"')…", *marks]) + r"\U00000e01-\U00000edf"


_ENDINGS = _endings()
_ENDED = re.compile(f"[{_ENDINGS}]")
_MARKED = re.compile(r"[!-/:-@\[-`{-~]{2}(?=[ \t-\r]|\Z)")  # a word that ends with two marks
_SEPARATOR = re.compile(r"(?:(?<=[ \t-\r])|\A)[|>»›·](?=[ \t-\r]|\Z)")
#: Boilerplate phrases per language, as regular expressions without look-around, anchors or apostrophes.
PHRASES = {
    "en": (
        "all rights reserved", "terms of (?:use|service)", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
        "subscribe to our newsletter", "lorem ipsum", r"\(c\) copyright", "under the [a-z0-9.]+ license",
    ),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren"),
    "fr": ("tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies"),
    "es": ("todos los derechos reservados", "política de privacidad", "aviso legal", "aceptar (?:las )?cookies"),
}
_SYMBOLS = "#*$%&|<>"

MARKED_SHARE = 30  # per cent of a line's words
SEPARATOR_SHARE = 20
LOST_SHARE = 30  # per cent of a document's words
MIN_WORDS = 50
REPEAT_SHARE = 50

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_lines long, n_punctuation_lines long, n_navigation_lines long,"
    " n_boilerplate_lines long, lost_words long, clean_text string"
)


def searches(phrases: Mapping[str, tuple[str, ...]] = PHRASES) -> list[regex.Pattern]:
    """A search per phrase: alone, each is found by the letters it must hold, where one pattern for all would be tried at every place."""
    return [regex.compile("(?i)" + p) for some in phrases.values() for p in some]


_BOILERPLATE = searches()


def failing(line: str, words: int, phrases: list[regex.Pattern] = _BOILERPLATE) -> int:
    """0 for a line that stays, else 1 punctuation, 2 navigation, 3 boilerplate (the first that holds)."""
    last = line.rstrip(_SPACE)[-1]
    if not _ENDED.match(last) or 100 * len(_MARKED.findall(line)) >= MARKED_SHARE * words:
        return 1
    if 100 * len(_SEPARATOR.findall(line)) >= SEPARATOR_SHARE * words:
        return 2
    return 3 if any(p.search(line) for p in phrases) else 0


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]  # dense, so that triples fit 64 bits
    triple = pair[:-1] * np.int64(len(ids)) + code[2:]
    _, where, count = np.unique(triple, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str | None, phrases: list[regex.Pattern] = _BOILERPLATE) -> tuple:
    """All figures of one text, its verdict and what stays of it."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    repeats = repeated_words(words)
    phrases = [p for p in phrases if p.search(text)]  # most texts hold none, so their lines are not searched
    seen: set[str] = set()
    dup = lines = lost = 0
    failed = [0, 0, 0, 0]
    stays = []
    for line in text.split("\n"):
        size = len(line.encode("utf-8", "surrogatepass").split())
        if not size:
            stays.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        rule = failing(line, size, phrases)
        failed[rule] += 1
        if rule:
            lost += size
        else:
            stays.append(line)
    base_failed = n < MIN_WORDS or 100 * repeats > REPEAT_SHARE * n
    kept = not base_failed and 100 * lost <= LOST_SHARE * n
    return n, word_chars, symbols, dup, repeats, base_failed, kept, lines, *failed[1:], lost, "\n".join(stays)


def clean(documents: DataFrame, phrases: Mapping[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """One row per document: figures, ``base_failed``, ``kept`` and ``clean_text`` (its lines that pass).

    Lines are split at ``\\n``; those without a word are neither judged nor counted and stay.
    A line fails by its marks (no closing punctuation at its end, or many words that end in two
    marks), as navigation (many lone separators) or as boilerplate (``phrases`` per language). A sentence may end as in any script
    (``_endings``). A document that
    loses more than 30 % of its words is not kept, nor is one that fails the base rules.
    Texts are worked on where they are read, whole, without a shuffle: any group of copies or hot
    source is spread as the input is.

    Null text counts as empty: no words, base failed. Null ids stay null, repeated rows give
    repeated results, an empty table gives none; other columns are not read.
    """

    names = [c.split()[0] for c in SCHEMA.split(",")]
    patterns = searches(phrases)

    @F.pandas_udf(SCHEMA)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, patterns) for t in texts], columns=names)

    # nondeterministic, so that a filter on the result does not make Spark run it twice
    return documents.select("doc_id", measured.asNondeterministic()("text").alias("_m")).select("doc_id", "_m.*")


def query(documents: DataFrame) -> DataFrame:
    return clean(documents).drop("clean_text")


_SQL_ENDINGS = re.sub(r"\\U([0-9a-f]{8})", r"\\x{\1}", _ENDINGS)
_SQL_PHRASES = "(?i)" + "|".join(p for some in PHRASES.values() for p in some)
_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS words FROM d),
t AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + s) AS n FROM again, (VALUES (0), (1), (2)) v(s) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, line, regexp_extract_all(line, '{_W}') AS words FROM l0 WHERE regexp_matches(line, '{_W}')),
judged AS (
  SELECT r, line, len(words) AS size,
    CASE WHEN NOT regexp_matches(words[-1], '[{_SQL_ENDINGS}]$')
           OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '[!-/:-@\[-`{{-~][!-/:-@\[-`{{-~]$'))) >= {MARKED_SHARE} * len(words) THEN 1
         WHEN 100 * len(list_filter(words, lambda x: regexp_matches(x, '^[|>\x{{00BB}}\x{{203A}}\x{{00B7}}]$'))) >= {SEPARATOR_SHARE} * len(words) THEN 2
         WHEN regexp_matches(line, '{_SQL_PHRASES}') THEN 3 ELSE 0 END AS rule
  FROM l),
by_doc AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (rule = 1) AS p, count(*) FILTER (rule = 2) AS n,
    count(*) FILTER (rule = 3) AS b, sum(size) FILTER (rule > 0) AS lost FROM judged GROUP BY r),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(p, 0)::BIGINT AS n_punctuation_lines,
    coalesce(by_doc.n, 0)::BIGINT AS n_navigation_lines, coalesce(b, 0)::BIGINT AS n_boilerplate_lines, coalesce(lost, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN by_doc USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words) AND 100 * lost_words <= {LOST_SHARE} * n_words AS kept
FROM f
"""
