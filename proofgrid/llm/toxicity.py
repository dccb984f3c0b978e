"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import stored

MOST_LABELLED = 5_000  # distinct labelled texts of either kind that the lexicon is learned from, about
MOST_TERMS = 20_000  # terms of a lexicon, those found in most texts
STEMS = (5, 6, 7)  # letters of the word beginnings that are terms besides whole words
LEAST = 5  # toxic texts that a term must be in
MIN_EXCEPTION, EXCEPTION_RATIO = 3, 9  # clean texts with an exception phrase, and how many times its rate in toxic ones
SMOOTH = 10  # words added to a text's length before its weight is divided by it
PENALTY = 1.0
TOXIC_FROM = 0.7
FOLDS = 3

# Letters that look like Latin ones, and signs that stand for letters. "l", "1" and "i" are one sign.
LOOKALIKES = {
    "аА": "a", "вВ": "b", "еЕ": "e", "кК": "k", "мМ": "m", "нН": "h", "оО": "o", "рР": "p", "сС": "c", "тТ": "t", "уУ": "y", "хХ": "x",
    "іІӏӀ": "i", "јЈ": "j", "ѕЅ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һҺ": "h",
    "αΑ": "a", "Β": "b", "εΕ": "e", "Ζ": "z", "Η": "h", "ιΙ": "i", "κΚ": "k", "Μ": "m", "Ν": "n", "ν": "v", "οΟ": "o", "ρΡ": "p",
    "τΤ": "t", "υ": "u", "Υ": "y", "χΧ": "x", "օՕ": "o", "ո": "n", "ս": "u", "հ": "h",
    "ɑ": "a", "ɡ": "g", "ıɩ": "i", "øØ": "o", "đĐ": "d", "łŁlL": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
_UNSEEN = [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]  # marks on letters, signs without width
_FOLD = {ord(c): to for group, to in LOOKALIKES.items() for c in group} | dict.fromkeys(_UNSEEN)
_SIGNS = str.maketrans(DIGITS)
_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[$@]?[^\W_](?:.*[^\W_])?")


@lru_cache(maxsize=1 << 16)
def _pieces(token: str) -> tuple[str, ...]:
    """The words of a token that has more than letters: marks at its ends go, digits and signs inside stand for letters."""
    if not _LETTERS.search(token):
        return ()
    return tuple(_LETTERS.findall(_INNER.search(token)[0].translate(_SIGNS)))


def folded(text: str | None) -> list[str]:
    """The words of a text in small letters, without accents, look-alikes and digits for letters."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    words: list[str] = []
    for token in text.translate(_FOLD).casefold().split():
        if token.isalpha():
            words.append(token)
        else:
            words.extend(_pieces(token))
    return words


def line(words: Iterable[str]) -> str:
    """Words between blanks; terms and phrases are patterns over this: `` word ``, `` beginning``, `` two words ``."""
    return f" {' '.join(words)} "


@dataclass
class Lexicon:
    """Weights of terms, exception phrases, and the logistic map to scores."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    logistic: tuple[float, float, float] | None = None  # base, weight, weight per length
    share: float = 0.0  # the score of all texts where nothing could be learned

    def key(self) -> int:
        return zlib.crc32(repr((sorted(self.weights.items()), sorted(self.exceptions))).encode())


@lru_cache(maxsize=8)
def _automaton(key: int, weights: tuple, exceptions: tuple) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term, weight in weights:
        automaton.add_word(term, (len(term), weight))
    for phrase in exceptions:
        automaton.add_word(phrase, (len(phrase), None))
    automaton.make_automaton()
    return automaton


class Matcher:
    """A lexicon's patterns in one automaton, built once in a Python worker."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton = None
        if lexicon.weights:
            self.automaton = _automaton(lexicon.key(), tuple(lexicon.weights.items()), tuple(lexicon.exceptions))

    def hits(self, text: str) -> tuple[dict[int, tuple[int, float]], int]:
        """Places of words (of their blank) with length and weight of the longest term there, and how many an exception took away."""
        if self.automaton is None:
            return {}, 0
        found: dict[int, tuple[int, float]] = {}
        spans = []
        for end, (length, weight) in self.automaton.iter(text):
            start = end - length + 1
            if weight is None:
                spans.append((start, end))
            elif length > found.get(start, (0, 0.0))[0]:
                found[start] = (length, weight)
        if not spans:
            return found, 0
        left = {s: hit for s, hit in found.items() if not any(a <= s < b for a, b in spans)}
        return left, len(found) - len(left)

    def measure(self, words: list[str]) -> tuple[int, int, int, float]:
        found, excepted = self.hits(line(words))
        return len(words), len(found), excepted, sum(w for _, w in found.values())


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / (words + SMOOTH))])


def logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Newton steps for a weighted logistic map; all but its base are held small (``PENALTY``)."""
    held = PENALTY * np.array([1e-3, *[1.0] * (x.shape[1] - 1)])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (rows * (y - p)) - held * b
        curve = (x * (rows * p * (1 - p))[:, None]).T @ x + np.diag(held)
        step = np.linalg.solve(curve, slope)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def _weighed(counts: DataFrame, p: Column, n: Column, toxic: int, clean: int) -> list:
    """Terms that are surely toxic, with the lower end of their log odds as weight.

    Sure is a likelihood ratio that no one of as many terms would reach by chance: twice the logarithm of their number.
    """
    if not toxic or not clean:
        return []
    share = toxic / (toxic + clean)
    odds = F.log((p + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (clean + 1))
    lower = odds - F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(p, (p + n) * share) + part(n, (p + n) * (1 - share)))
    tested = counts.select("term", lower.alias("weight"), ratio.alias("ratio"), p.alias("p")).filter(p + n >= LEAST)
    least = 2 * math.log(max(2, tested.count()))
    return tested.filter((F.col("p") >= LEAST) & (F.col("ratio") >= least) & (F.col("weight") > 0)).orderBy(F.desc("p"), "term").limit(MOST_TERMS).collect()


def _sample(documents: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, dict[int, int]]:
    """About ``MOST_LABELLED`` distinct texts of either label (``text, label``), and how many texts there are."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("label"))
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]
    keyed = documents.filter(learn & F.col("text").isNotNull()).select("doc_id", *hashes).join(known, "doc_id")
    texts = stored(keyed.groupBy("h1", "h2").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "toxic-labels")
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, MOST_LABELLED / max(1, sizes.get(1, 0))).otherwise(MOST_LABELLED / max(1, sizes.get(0, 0)))
    chosen = texts.filter(F.pmod("h2", F.lit(1 << 30)) < share * (1 << 30))  # bounded above
    found = documents.filter("text is not null").select("text", *hashes).join(F.broadcast(chosen), ["h1", "h2"])
    return found.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.first("label").alias("label")), sizes


def _readied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folded texts with a signature that near copies mostly share: the smallest hash of their five-word shingles."""
    for batch in batches:
        words = [folded(t) for t in batch["text"]]
        shingles = lambda ws: (" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))
        signature = [min(zlib.crc32(s.encode()) for s in shingles(ws)) for ws in words]
        yield pd.DataFrame({"signature": signature, "label": batch["label"], "line": [line(ws) for ws in words]})


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each term of a text once, with a hash of the words around its first place."""
    for batch in batches:
        rows = []
        for label, half, text in zip(batch["label"], batch["half"], batch["line"]):
            words, seen = text.split(), {}
            for i, w in enumerate(words):
                if w not in seen:
                    around = zlib.crc32(" ".join(words[max(i - 1, 0) : i] + ["|"] + words[i + 1 : i + 2]).encode())
                    seen[w] = around
            terms: dict[str, int] = {}
            for w, around in seen.items():
                if 3 <= len(w) <= 40:
                    terms[f" {w} "] = around
                    for n in STEMS:
                        if len(w) > n:
                            terms.setdefault(f" {w[:n]}", around)
            rows.extend((t, label, half, a) for t, a in terms.items())
        yield pd.DataFrame(rows, columns=["term", "label", "half", "around"])


def _phrases(lexicon: Lexicon):
    """Two-word phrases around each hit, with a hash of the words beside them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for batch in batches:
            rows = set()
            for label, text in zip(batch["label"], batch["line"]):
                found, _ = matcher.hits(text)
                for start in found:
                    left, right = text[max(0, start - 80) : start].split()[-2:], text[start : start + 120].split()[:4]
                    beside = zlib.crc32(" ".join([*left, "|", *right[1:3]]).encode())
                    if left:
                        rows.add((line([left[-1], right[0]]), label, beside))
                    if len(right) > 1:
                        rows.add((line(right[:2]), label, beside))
            yield pd.DataFrame(list(rows), columns=["phrase", "label", "beside"])

    return work


def fit(documents: DataFrame, labels: DataFrame, learn: Column) -> Lexicon:
    """A lexicon with weights, exceptions and score map from the labelled rows that ``learn`` admits.

    Terms are whole words and word beginnings. A term's evidence is the number of toxic and clean texts
    that have it, where texts with the same words around it, and texts that share their smallest shingle
    hash, count once: a group of copies of any size says no more than one text. A term must be surely
    toxic for the number of terms tried; its weight is the lower end (one standard error) of its log odds. Phrases of a term and a neighbour that are common in
    clean texts and not in toxic ones become exceptions. The score map is fitted out of fold: each half
    of the texts is measured with the lexicon of the other half.

    Learned from about 5,000 distinct texts of either label, chosen by hash, weighted as the
    classes stand to each other. Several labels of a document or text count as their mean, 0.5 as toxic. Null
    ids, labels and texts teach nothing. Without both labels there is no lexicon and all texts get the share of toxic ones.
    """
    sample, sizes = _sample(documents, labels, learn)
    ready = sample.mapInPandas(_readied, "signature long, label int, line string")
    ready = ready.groupBy("signature").agg(F.min_by(F.struct("label", "line"), F.struct("label", "line")).alias("t"))
    ready = stored(ready.select(F.col("t.label").alias("label"), (F.col("signature") % 2).cast("int").alias("half"), "t.line"), "toxic-texts")
    total = {(r["half"], r["label"]): r["count"] for r in ready.groupBy("half", "label").count().collect()}
    toxic, clean = ([total.get((h, label), 0) for h in (0, 1)] for label in (1, 0))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not sum(toxic) or not sum(clean):
        return Lexicon(share=share)
    counted = ready.mapInPandas(_terms, "term string, label int, half int, around long").distinct().groupBy("term")
    cell = lambda half, label: F.count_if((F.col("half") == half) & (F.col("label") == label)).alias(f"c{half}{label}")
    counts = stored(counted.agg(*[cell(h, label) for h in (0, 1) for label in (0, 1)]), "toxic-terms")
    lexicons = []
    for p, n, t, c in (("c11", "c10", toxic[1], clean[1]), ("c01", "c00", toxic[0], clean[0]), ("c01 + c11", "c00 + c10", sum(toxic), sum(clean))):
        lexicons.append(Lexicon({r["term"]: r["weight"] for r in _weighed(counts, F.expr(p), F.expr(n), t, c)}))
    whole = lexicons[2]
    met = ready.mapInPandas(_phrases(whole), "phrase string, label int, beside long").distinct().groupBy("phrase")
    met = met.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    rate = lambda c, of: F.col(c) / of
    often = met.filter((F.col("n") >= MIN_EXCEPTION) & (rate("n", sum(clean)) >= EXCEPTION_RATIO * rate("p", sum(toxic))))
    phrases = frozenset(r["phrase"] for r in often.orderBy(F.desc("n"), "phrase").limit(MOST_TERMS).collect())
    lexicons = [Lexicon(x.weights, phrases) for x in lexicons]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [Matcher(x) for x in lexicons[:2]]
        for batch in batches:
            cells = [matchers[h].measure(t.split()) for h, t in zip(batch["half"], batch["line"])]
            yield pd.DataFrame({"label": batch["label"], "words": [float(c[0]) for c in cells], "weight": [c[3] for c in cells]})

    seen = ready.mapInPandas(measured, "label int, words double, weight double").toPandas().sort_values(["label", "words", "weight"])  # bounded above
    y = seen["label"].to_numpy(float)
    rows = np.where(y == 1, sizes.get(1, 0) / sum(toxic), sizes.get(0, 0) / sum(clean))
    b = logistic(features(seen["weight"].to_numpy(), seen["words"].to_numpy()), y, rows * len(y) / rows.sum())
    return Lexicon(whole.weights, phrases, tuple(b.tolist()), share)


def scored(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hits``, ``n_excepted``, ``weight``, ``score`` and ``toxic`` (score from 0.7).

    Every text is folded and matched whole, where it is read, without a shuffle. The score is a logistic map
    of the weight of all hits and of that weight per length. Of several terms at one word the longest
    counts; a hit inside an exception phrase does not.

    Null and empty texts have no words and no weight, and the score of a text without hits. Repeated rows
    give repeated results, an empty table none; columns named like the new ones are replaced.
    """
    made = ["n_words", "n_hits", "n_excepted", "weight"]

    @F.pandas_udf("n_words long, n_hits long, n_excepted long, weight double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        matcher = Matcher(lexicon)
        return pd.DataFrame([matcher.measure(folded(t)) for t in texts], columns=made)

    own = [c for c in documents.columns if c not in (*made, "score", "toxic")]
    # nondeterministic, so that Spark does not run it once per field
    rows = documents.select(*own, measured.asNondeterministic()("text").alias("_found")).select(*own, "_found.*")
    if lexicon.logistic is None:
        score = F.lit(float(lexicon.share))
    else:
        base, by_weight, by_length = lexicon.logistic
        log_odds = F.lit(base) + by_weight * F.log1p("weight") + by_length * F.log1p(1000 * F.col("weight") / (F.col("n_words") + SMOOTH))
        score = 1 / (1 + F.exp(-log_odds))
    rows = rows.withColumn("score", score)
    return rows.withColumn("toxic", F.col("score") >= TOXIC_FROM)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id leaves remainder 1 are held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    lexicon = fit(documents, labels, fold != 1)
    rows = documents.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return scored(rows, lexicon).select("doc_id", "held_out", "score", F.col("toxic").cast("int").alias("predicted"), "n_hits", "weight")
