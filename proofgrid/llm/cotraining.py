"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import stored

MOST_LABELLED = 20_000  # labelled documents, chosen by hash of the id, that the views are fitted on
ROUNDS = 4
CONFIDENT = 0.95  # a view offers a document if it is this sure
SHARE = 0.1  # of all documents without a label that a view offers in a round, split by the shares of the classes
BIN = 0.01  # of log-odds; a view offers whole bins, so documents that are alike go together
PSEUDO_WEIGHT = 0.5
FOLDS = 5
RIDGE = 1.0
KEEP_FROM = 0.5
MOST_SUMS = 32  # rows of sums that a pass sends to the driver
SOURCES, LANGUAGES = 32, 8  # slots that names are hashed into

_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
_MARKED = re.compile(r"[!-/:-@\[-`{-~]{2}(?=\s|\Z)")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_ENDINGS = tuple(".!?…\"'”’»)")
TEXT_VIEW = 14
METADATA_VIEW = SOURCES + LANGUAGES + 6


def text_view(text: str | None) -> list[float]:
    """What the words and characters of a whole text say; null is an empty text."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    letters = max(1, len(_LETTER.findall(text)))
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    distinct = len(set(words))
    return [
        float(np.log1p(len(words))),
        len(_SYMBOLS.findall(text)) / chars,
        len(_UPPER.findall(text)) / letters,
        letters / chars,
        sum(map(text.count, "0123456789")) / chars,
        len(_MARKED.findall(text)) / n,
        text.count("|") / n,
        text.count("!") / n,
        distinct / n,
        distinct / np.sqrt(n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(40.0, sum(map(len, words)) / n),
        sum(line.endswith(_ENDINGS) for line in lines) / max(1, len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
    ]


def metadata_view(text: str | None, source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """Where a document comes from, its stated language and length, and the layout of its lines."""
    out = [0.0] * METADATA_VIEW
    for name, at, slots in ((source, 0, SOURCES), (lang, SOURCES, LANGUAGES)):
        if isinstance(name, str):
            out[at + zlib.crc32(name.encode("utf-8", "surrogatepass")) % slots] = 1.0
    at = SOURCES + LANGUAGES
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    length = float(np.log1p(n_chars)) if known else 0.0
    lines = 1 + (text or "").count("\n")
    per_line = float(np.log1p(len(text or "") / lines))
    out[at:] = [float(known), length, length * length / 10, float(np.log(lines)), per_line, per_line * per_line / 10]
    return out


@dataclass
class View:
    """A ridge logistic model of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps; the constant is not penalised."""
    b = np.zeros(z.shape[1])
    for _ in range(30):
        step = _step(b, _slopes(z, y, w, b), ridge)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _slopes(z: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gradient and curvature of rows, in one column after the other; they add up over rows."""
    p = _sigmoid(z @ b)
    return np.column_stack([z.T @ (w * (p - y)), (z * (w * p * (1 - p))[:, None]).T @ z])


def _step(b: np.ndarray, slopes: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(b), ridge)
    penalty[0] = 1e-6
    return np.clip(np.linalg.solve(slopes[:, 1:] + np.diag(penalty + 1e-9), slopes[:, 0] + penalty * b), -5, 5)


@dataclass
class CoTrained:
    """Both views and how their log-odds combine; without a fit every document gets ``prior``."""

    views: tuple[View, View] | None
    mix: tuple[np.ndarray, np.ndarray, np.ndarray] | None  # calibration of each view, then of both
    prior: float
    offered: tuple[int, int]

    def scores(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            flat = np.full(len(x[0]), self.prior)
            return flat, flat, flat
        own = [c[0] + c[1] * v.logit(z) for v, z, c in zip(self.views, x, self.mix)]
        both = self.mix[2]
        return _sigmoid(own[0]), _sigmoid(own[1]), _sigmoid(both[0] + both[1] * own[0] + both[2] * own[1])


Rows = tuple[np.ndarray, np.ndarray]  # both views of some documents
Sums = Callable[[Callable[[Rows], np.ndarray]], np.ndarray]  # adds up what a function gives for all parts of the rows
_LEAST = float(np.log(CONFIDENT / (1 - CONFIDENT)))
_BINS = int((40 - _LEAST) / BIN) + 2


def _bins(logit: np.ndarray) -> np.ndarray:
    """The bin of log-odds from ``CONFIDENT`` on; negative below."""
    return np.floor((np.minimum(logit, 40) - _LEAST) / BIN).astype(np.int64)


@dataclass
class Round:
    """Two views and the bins from which each offered its rows, as good and as bad ones."""

    views: tuple[View, View]
    cuts: list[list[int]]


def _told(rounds: list[Round], x: Rows) -> list[np.ndarray]:
    """What each view has been told of the rows, by the rounds so far; -1 for nothing."""
    given = [np.full(len(x[0]), -1.0) for _ in range(2)]
    for turn in rounds:
        for view in (0, 1):
            logit = turn.views[view].logit(x[view])
            for label, sign, cut in ((1.0, 1, turn.cuts[view][0]), (0.0, -1, turn.cuts[view][1])):
                given[1 - view][(given[1 - view] < 0) & (_bins(sign * logit) >= cut)] = label
    return given


def _fitted(jobs: list[tuple[int, np.ndarray]], x: Rows, y: np.ndarray, rounds: list[Round], sums: Sums) -> list[View]:
    """A view for each ``(view, labelled rows)``, by Newton steps whose gradient and curvature cover all told rows."""
    shift = [v.mean(axis=0) for v in x]

    def moments(part: Rows) -> np.ndarray:
        out = []
        for given, v, m in zip(_told(rounds, part), part, shift):
            d = v[given >= 0] - m
            out += [[len(d)], d.sum(axis=0), (d * d).sum(axis=0)]
        return np.concatenate(out)

    all_ = sums(moments) if rounds else np.zeros(2 + 2 * sum(v.shape[1] for v in x))
    views, at = [], 0
    ends = []
    for v in x:
        size = v.shape[1]
        ends.append((all_[at], all_[at + 1 : at + 1 + size], all_[at + 1 + size : at + 1 + 2 * size]))
        at += 1 + 2 * size
    for view, rows in jobs:
        d = x[view][rows] - shift[view]
        n, one, two = len(d) + ends[view][0], d.sum(axis=0) + ends[view][1], (d * d).sum(axis=0) + ends[view][2]
        scale = np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))
        new = View(shift[view] + one / n, np.where(scale > 1e-9, scale, 1.0), np.zeros(0))
        new.weights = _logistic(new.columns(x[view][rows]), y[rows], np.ones(len(rows)), RIDGE)
        views.append(new)
    offered = ends[0][0] + ends[1][0]
    for _ in range(30 if offered else 0):

        def slopes(part: Rows) -> np.ndarray:
            given = _told(rounds, part)
            some = [(v[g >= 0], g[g >= 0]) for v, g in zip(part, given)]
            out = []
            for (view, _), model in zip(jobs, views):
                v, target = some[view]
                out.append(_slopes(model.columns(v), target, np.full(len(v), PSEUDO_WEIGHT), model.weights).ravel())
            return np.concatenate(out)

        total, at, most = sums(slopes), 0, 0.0
        for (view, rows), model in zip(jobs, views):
            k = len(model.weights)
            own = _slopes(model.columns(x[view][rows]), y[rows], np.ones(len(rows)), model.weights)
            step = _step(model.weights, own + total[at : at + k * (k + 1)].reshape(k, k + 1), RIDGE)
            model.weights, at, most = model.weights - step, at + k * (k + 1), max(most, float(np.abs(step).max()))
        if most < 1e-6:
            break
    return views


def co_train(x: Rows, y: np.ndarray, pool: Rows | Sums) -> CoTrained:
    """Fit two views on labelled rows ``x, y``, with rounds over all rows without a label.

    ``pool`` holds those rows, or adds up a function over all parts of them (Spark does so). In each round
    each view offers the rows that it is surest of, a share of all by class shares, as pseudo-labels to
    the other one; a row keeps the first label that it was given. Rows are not marked: what a view was
    told follows from the rounds, so a pass needs the rows' views only. Calibration uses out-of-fold
    log-odds of labelled rows only.
    """
    prior = float(y.mean()) if len(y) else 0.5
    if min(int(y.sum()), int(len(y) - y.sum())) < FOLDS:
        return CoTrained(None, None, prior if len(y) else 1.0, (0, 0))
    sums = pool if callable(pool) else lambda f: f(pool)
    rounds: list[Round] = []
    everything = np.arange(len(y))
    n_pool = int(sums(lambda part: np.array([float(len(part[0]))]))[0])
    for _ in range(ROUNDS if n_pool else 0):
        pair = tuple(_fitted([(0, everything), (1, everything)], x, y, rounds, sums))

        def sure(part: Rows) -> np.ndarray:
            given, out = _told(rounds, part), []
            for view in (0, 1):
                logit = pair[view].logit(part[view])[given[1 - view] < 0]
                for sign in (1, -1):
                    bins = _bins(sign * logit)
                    out.append(np.bincount(bins[bins >= 0], minlength=_BINS))
            return np.concatenate(out).astype(float)

        counts, cuts = sums(sure).reshape(2, 2, _BINS), []
        for view in (0, 1):
            cuts.append([])
            for label in (0, 1):
                most = max(1.0, SHARE * n_pool * (1 - prior if label else prior))
                above = np.cumsum(counts[view, label][::-1])[::-1]  # rows from a bin on
                reached = np.flatnonzero(above >= most)
                cuts[view].append(int(reached[-1]) if len(reached) else 0)
        rounds.append(Round(pair, cuts))
    offered = sums(lambda part: np.array([float((g >= 0).sum()) for g in _told(rounds, part)])) if rounds else np.zeros(2)
    fold = np.arange(len(y)) % FOLDS
    out = np.zeros((len(y), 2))
    jobs = [(f, view) for f in range(FOLDS) for view in (0, 1)]
    folds = [(view, np.flatnonzero(fold != f)) for f, view in jobs]
    first, second, *others = _fitted([(0, everything), (1, everything), *folds], x, y, rounds, sums)
    for (f, view), model in zip(jobs, others):
        out[fold == f, view] = model.logit(x[view][fold == f])
    even = np.ones(len(y))
    smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    own = [_logistic(np.column_stack([even, out[:, v]]), smooth, even, 1e-3) for v in (0, 1)]
    both = np.column_stack([even, *[c[0] + c[1] * out[:, v] for v, c in enumerate(own)]])
    used = [0, 1, 2]
    while True:  # a view that would count against itself is left out
        weights = np.zeros(3)
        weights[used] = _logistic(both[:, used], smooth, even, 1e-3)
        if (weights[1:] >= 0).all():
            break
        used.remove(1 + int(weights[1:].argmin()))
    return CoTrained((first, second), (*own, weights), prior, tuple(int(n) for n in offered))


def _views(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    cell = lambda v: v if isinstance(v, str) else None
    a = [text_view(cell(t)) for t in rows["text"]]
    b = [metadata_view(cell(t), cell(s), cell(lang), n) for t, s, lang, n in zip(rows["text"], rows["source"], rows["lang"], rows["n_chars"])]
    return np.array(a, float).reshape(-1, TEXT_VIEW), np.array(b, float).reshape(-1, METADATA_VIEW)


def _share(id_: str, rows: int, most: int):
    """Whether an id falls in the hashed share that keeps about ``most`` of ``rows`` rows; all if they are fewer."""
    parts = 1 << 30
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_)), F.lit(parts)) < int(min(1.0, most / max(1, rows)) * parts)


def added(rows: DataFrame, zero: np.ndarray, function: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of ``function`` over all parts of ``rows``.

    A task sends one row of sums. More tasks than ``MOST_SUMS`` are added up on executors first, in ``MOST_SUMS`` groups
    and in the order of the tasks, so the driver gets that many rows at most, whatever the number of tasks.
    """

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            part = function(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sum": [total.tobytes()]})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("task")
        total = np.frombuffer(ordered["sum"].iloc[0]).copy()
        for one in ordered["sum"].iloc[1:]:
            total += np.frombuffer(one)
        return pd.DataFrame({"task": [ordered["task"].iloc[0]], "sum": [total.tobytes()]})

    sums = rows.mapInPandas(own, "task long, sum binary")
    if rows.rdd.getNumPartitions() > MOST_SUMS:
        sums = sums.groupBy(F.col("task") % MOST_SUMS).applyInPandas(together, "task long, sum binary")
    total = zero
    for row in sorted(sums.collect(), key=lambda r: r["task"]):
        total = total + np.frombuffer(row["sum"])
    return total


def fit(documents: DataFrame, labels: DataFrame) -> CoTrained:
    """The classifier from ``labels`` (``doc_id, quality``) and the documents.

    Labelled rows are about ``MOST_LABELLED`` documents, chosen by a hash of the id; all documents without
    a label take part in the rounds. Views are made by Spark once and stored; each Newton step and each choice of
    confident documents is one pass over them, of which the driver gets sums. Several labels of
    a document count as their mean, and 0.5 as none. Null ids have no label; null labels are left out. Rows that repeat a
    labelled id count as one, with the least of their views (as bytes), whatever their number. Texts of any length are
    read whole, once.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q <> 0.5")
    known = stored(known.select("doc_id", (F.col("q") > 0.5).cast("double").alias("label")), "quality-labels")
    some = known.filter(_share("doc_id", known.count(), MOST_LABELLED))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = _views(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "a": [r.tobytes() for r in a], "b": [r.tobytes() for r in b]})

    rows = documents.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    views = stored(rows.mapInPandas(measure, "doc_id long, a binary, b binary"), "quality-views")
    stack = lambda part, c, n: np.frombuffer(b"".join(part[c])).reshape(-1, n)
    both = lambda part: (stack(part, "a", TEXT_VIEW), stack(part, "b", METADATA_VIEW))
    single = views.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("a", "b", "label")).alias("v"))
    found = single.select("doc_id", "v.*").toArrow().to_pandas().sort_values("doc_id")  # a row per id, bounded above
    pool: list[DataFrame] = []

    def sums(function: Callable[[Rows], np.ndarray]) -> np.ndarray:
        if not pool:
            pool.append(stored(views.join(known.select("doc_id"), "doc_id", "left_anti").select("a", "b"), "quality-pool"))

        zero = function((np.zeros((0, TEXT_VIEW)), np.zeros((0, METADATA_VIEW))))
        return added(pool[0], zero, lambda batch: function(both(batch)))

    return co_train(both(found), found["label"].to_numpy(float), sums)


def scored(documents: DataFrame, model: CoTrained) -> DataFrame:
    """``documents`` with ``p_text``, ``p_metadata``, ``score`` and ``kept`` (score from ``KEEP_FROM``).

    Every row is scored where it is read. Null cells count as missing metadata or an empty text; rows
    may repeat; an empty table gives no rows. Without labels of both classes all rows get the share
    of good labels (1 without any). Columns named like the new ones are replaced.
    """

    @F.pandas_udf("p_text double, p_metadata double, score double")
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars})
        return pd.DataFrame(dict(zip(("p_text", "p_metadata", "score"), model.scores(_views(rows)))))

    own = [c for c in documents.columns if c not in ("p_text", "p_metadata", "score", "kept")]
    cells = score.asNondeterministic()("text", "source", "lang", F.col("n_chars").cast("double"))  # else a later filter would run it again
    out = documents.select(*own, cells.alias("_scored")).select(*own, "_scored.*")
    return out.withColumn("kept", F.col("score") >= KEEP_FROM)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(documents, fit(documents, labels))
    return found.select("doc_id", "p_text", "p_metadata", "score", "kept")
