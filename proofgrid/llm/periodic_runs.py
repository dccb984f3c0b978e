"""Runs of repeated words, found online by catching squares over blocks of doubling size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import WORD

MIN_LENGTH = 24  # words of a run at least
MIN_PERIODS = 3  # and so many times its period
BASE = 8  # words of the smallest block; periods below it are caught there too
PORTION = 1 << 16  # words of a text that are appended at once
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shortest(period: int | np.ndarray) -> int | np.ndarray:
    """The least length of a run of this period."""
    return np.maximum(MIN_LENGTH, MIN_PERIODS * period)


def _hashed(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX1
    return h ^ (h >> np.uint64(31))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _MIX1 + (right ^ (right >> np.uint64(30))) * _MIX2
    return h ^ (h >> np.uint64(29))


class _Level:
    """Catchers of one block size: hashes of all windows of that size that a block may still meet."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.first = size, first  # periods from ``first`` up to twice the size are caught
        self.windows, self.start = np.zeros(0, np.uint64), 0  # the window at ``start`` stands first
        self.done = 0  # blocks whose catcher has met every suffix it waits for

    @property
    def end(self) -> int:
        return self.start + len(self.windows)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.windows[places - self.start]


class SquareCatcher:
    """The runs of a sequence of numbers that grows at its end.

    Level by level, the sequence is cut into aligned blocks of 8, 16, 32, ... numbers. A completed block of
    size B is a catcher: as numbers are appended, each suffix of length B that starts B to 2B - 1 behind
    the block's start (1 to 15 behind at the lowest level) is compared with it; suffixes are compared
    by 64-bit hashes that double with the levels, so an appended number costs one comparison a level. Equal
    ones are a square. Squares inside a run that is known with a divisor of their period are part
    of it; the others must go on for as long as a run would, and grow number by number, exactly,
    to the stretch they belong to, which merges all squares of that period in it. A stretch that is
    long enough is a run. One that reaches the last number grows on with the next ones.

    A run of period q from B to 2B - 1 has at least max(24, 3q) numbers, so an aligned block starts in its first B
    and the same block returns inside the run q later: no run is missed. Work is n log n,
    memory some forty bytes a number.
    """

    def __init__(self) -> None:
        self.ids, self.n = np.zeros(1024, np.int64), 0
        self.levels: list[_Level] = []
        self.stretches: list[list[int]] = []  # [start, end, period] of each run
        self.open: list[list[int]] = []  # those that reach the last number
        self.last: dict[int, list[int]] = {}  # the latest stretch of each period, run or not

    def append(self, ids: np.ndarray) -> None:
        self._grow(ids)
        self._advance(final=False)
        for level in self.levels:  # windows that no block waits for
            keep = min(level.done * level.size, max(self.n - 4 * level.size, 0))
            if keep > level.start:
                level.windows, level.start = level.windows[keep - level.start :], keep

    def runs(self) -> list[tuple[int, int, int]]:
        """All runs so far as (start, length, period), by start and period; ends the sequence."""
        self._advance(final=True)
        return sorted((s, e - s, q) for s, e, q in self.stretches)

    def _grow(self, ids: np.ndarray) -> None:
        if self.n + len(ids) > len(self.ids):
            held = np.zeros(max(2 * len(self.ids), self.n + len(ids)), np.int64)
            held[: self.n] = self.ids[: self.n]
            self.ids = held
        self.ids[self.n : self.n + len(ids)] = ids
        self.n += len(ids)
        for stretch in self.open:
            stretch[1] = self._forward(stretch[1] - stretch[2], stretch[2]) + stretch[2]
        self.open = [x for x in self.open if x[1] == self.n]

    def _advance(self, final: bool) -> None:
        size, k = BASE, 0
        while self.n >= max(MIN_LENGTH, MIN_PERIODS * size if k else 0):
            if k == len(self.levels):
                self.levels.append(_Level(size, size if k else 1))
            level = self.levels[k]
            self._windows(level, self.levels[k - 1] if k else None)
            blocks = (self.n // size if final else self.n // size - 5) - level.done
            if blocks > 0:
                self._catch(level, blocks)
                level.done += blocks
            size, k = 2 * size, k + 1

    def _windows(self, level: _Level, below: _Level | None) -> None:
        """Hashes of the windows that end in the numbers appended since."""
        if level.end > self.n - level.size:
            return
        if below is None:
            new = _hashed(self.ids[level.end : self.n])
            for half in (1, 2, 4):
                new = _paired(new[:-half], new[half:])
        else:
            old = below.windows[level.end - below.start :]
            new = _paired(old[: -below.size], old[below.size :])
        level.windows = np.concatenate([level.windows, new])

    def _catch(self, level: _Level, blocks: int) -> None:
        size, first, start = level.size, level.first, level.done * level.size
        periods = 2 * size - first
        held = level.windows[start - level.start :]
        missing = (blocks - 1) * size + 2 * size - len(held)  # suffixes behind the end; never taken below
        held = np.concatenate([held, np.zeros(missing, np.uint64)]) if missing > 0 else held
        suffixes = np.lib.stride_tricks.sliding_window_view(held[first:], periods)[::size][:blocks]
        block, lag = np.nonzero(suffixes == held[: blocks * size : size, None])
        at, q = start + block * size, first + lag
        fits = at + shortest(q) - (size - 1) <= self.n  # else no run that has its first block here ends in time
        at, q = at[fits], q[fits]
        groups = [q == p for p in np.unique(q)] if first == 1 else [slice(None)]
        for group in groups:
            self._merge(level, at[group], q[group])

    def _merge(self, level: _Level, at: np.ndarray, q: np.ndarray) -> None:
        if not len(at):
            return
        size = level.size
        own = int(q[0]) if level.first == 1 else None  # at the lowest level all have one period
        known = sorted((s, e) for s, e, p in self.stretches if (own is None and p < size) or (own is not None and p < own and own % p == 0))
        if known:
            starts, ends = np.array(known).T
            reach = np.concatenate([[-1], np.maximum.accumulate(ends)])
            new = reach[np.searchsorted(starts, at, "right")] < at + q + size
            at, q = at[new], q[new]
        # the square must go on: the first block of a run is followed by equal windows up to ``far``
        far = at + shortest(q) - q - 2 * size + 1
        goes_on = np.ones(len(at), bool)
        for place in (np.minimum(at + size, far), far):
            goes_on[goes_on] = level.at(place[goes_on]) == level.at((place + q)[goes_on])
        at, q = at[goes_on], q[goes_on]
        order = np.lexsort((at, q))
        for a, p in zip(at[order].tolist(), q[order].tolist()):
            last = self.last.get(p)
            if last is not None and last[0] <= a and a + p + size <= last[1]:
                continue
            stretch = [self._backward(a, p), self._forward(a, p) + p, p]
            self.last[p] = stretch
            if stretch[1] - stretch[0] >= shortest(p):
                self.stretches.append(stretch)
                if stretch[1] == self.n:
                    self.open.append(stretch)

    def _forward(self, x: int, q: int) -> int:
        """The first place from ``x`` on whose number differs from the one ``q`` later."""
        step = 64
        while (m := min(step, self.n - q - x)) > 0:
            differ = self.ids[x : x + m] != self.ids[x + q : x + q + m]
            i = int(differ.argmax())
            if differ[i]:
                return x + i
            x, step = x + m, min(2 * step, 1 << 16)
        return x

    def _backward(self, x: int, q: int) -> int:
        """The smallest place before ``x`` from which on all numbers equal the ones ``q`` later."""
        step = 64
        while (m := min(step, x)) > 0:
            differ = (self.ids[x - m : x] != self.ids[x + q - m : x + q])[::-1]
            i = int(differ.argmax())
            if differ[i]:
                return x - i
            x, step = x - m, min(2 * step, 1 << 16)
        return x


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a list of words as (start, length, period)."""
    if len(words) < MIN_LENGTH:
        return []
    numbers: dict[bytes, int] = {}
    catcher = SquareCatcher()
    for at in range(0, len(words), PORTION):
        part = words[at : at + PORTION]
        catcher.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in part), np.int64, len(part)))
    return catcher.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def with_runs(documents: DataFrame) -> DataFrame:
    """``documents`` with ``runs`` (start, length, period in words, by start and period) and ``collapsed_text``.

    A run is a stretch of words with smallest period q, at least ``max(24, 3 q)`` long, that no neighbouring
    word extends. The collapsed text has the words outside runs and each run's first period, joined by
    blanks. Every text is worked on whole where it is read, without a shuffle.

    Null and empty texts have no runs and an empty collapsed text. Runs of different periods may overlap.
    Repeated rows give repeated results, an empty table none; columns named like the new ones are replaced.
    """

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed_text string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            runs = runs_of(words)
            rows.append(([dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["runs", "collapsed_text"])

    own = [c for c in documents.columns if c not in ("runs", "collapsed_text")]
    # nondeterministic, so that Spark does not run it once per field
    return documents.select(*own, found.asNondeterministic()("text").alias("_found")).select(*own, "_found.*")


def cycled(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the words of one document in ten repeat from some word on, as its id's crc32 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = documents.select("doc_id", "text", words.alias("_words"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_a", F.when(F.size("_words") > 0, F.col("_g") % F.size("_words")))
    rows = rows.withColumn("_p", 1 + F.expr("(size(_words) - _a) div (3 + _g % 8)"))
    after = F.transform(F.sequence("_a", F.size("_words") - 1), lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), after), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def strongest(runs: str) -> Column:
    """The run with the greatest length / period, then smallest start and period. Quotients of texts below 2**26 words are told apart."""
    best = F.array_max(F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("run"))))
    return best["run"]


def query(documents: DataFrame) -> DataFrame:
    """Runs of the documents as ``cycled`` gives them, and digests of the runs and of what stays."""
    rows = with_runs(cycled(documents)).withColumn("best", strongest("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
