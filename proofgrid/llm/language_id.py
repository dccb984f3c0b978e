"""Language identification by interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import stored

ORDER = 4
MOST_CELLS = 32_000_000  # numbers (256 MB) of models that go to every task; larger ones are joined, with the same rows
HELD = 1 << 22  # n-grams of a language that a task holds before it hands them on
CALIBRATION_ROWS = 20_000  # documents, chosen by hash, that the calibration is fitted on
UNKNOWN = "und"
SLICE = 1 << 18  # characters scored at once
DIGITS = 10  # of a cross-entropy; sums in another order agree to more

_GAP, _OTHER = 0, 255
_BITS = 21  # of a code point
_HASH = np.uint64(0x9E37_79B9_7F4A_7C15), np.uint64(0xC2B2_AE3D_27D4_EB4F)


def _letters() -> np.ndarray:
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return table


_TABLES: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = _letters()
    return _TABLES["letters"]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol_table(alphabet: list[int] | None = None) -> np.ndarray:
    """The symbol of each code point: a letter stands for itself, or for a byte if a small alphabet is given."""
    if alphabet is None:
        return np.where(letter_table(), np.arange(0x110000), _GAP).astype(np.uint32)
    table = np.where(letter_table(), _OTHER, _GAP).astype(np.uint8)
    table[np.array(alphabet, np.int64)] = np.arange(1, len(alphabet) + 1)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text as symbols: letters in lower case, runs of anything else as one gap, gaps around."""
    codes = table[_points(text)]
    codes = codes[(codes != _GAP) | np.r_[False, codes[:-1] != _GAP]] if len(codes) else codes
    if len(codes) and codes[-1] == _GAP:
        codes = codes[:-1]
    return np.concatenate([np.zeros(ORDER - 1, codes.dtype), codes, np.zeros(1, codes.dtype)])


def grams(codes: np.ndarray) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ones before it: bytes packed into 32 bits, code points as ``(context, last)``.

    A context is three code points of 21 bits each.
    """
    n = max(len(codes) - ORDER + 1, 0)
    if codes.dtype == np.uint8:
        wide, out = codes.astype(np.uint32), np.zeros(n, np.uint32)
        for i in range(ORDER):
            out = (out << np.uint32(8)) | wide[i : i + n]
        return out
    wide, context = codes.astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(ORDER - 1):
        context = (context << np.uint64(_BITS)) | wide[i : i + n]
    return context, wide[ORDER - 1 : ORDER - 1 + n]


def _pairs(keys: np.ndarray | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of either kind as ``(context, last)``."""
    if isinstance(keys, tuple):
        return keys
    wide = keys.astype(np.uint64)
    context = np.zeros(len(wide), np.uint64)
    for i in range(ORDER - 1, 0, -1):
        context = (context << np.uint64(_BITS)) | ((wide >> np.uint64(8 * i)) & np.uint64(255))
    return context, wide & np.uint64(255)


def _suffix(symbols: int) -> int:
    """Mask of a context's last symbols."""
    return (1 << _BITS * symbols) - 1


def _hashed(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    return context * _HASH[0] + last * _HASH[1]


class Model:
    """Probabilities of one language, from its counts of n-grams of the highest order.

    Lower orders use the number of distinct symbols before an n-gram. At each order the discounted
    part is interpolated with the next lower order by the context's weight; below single symbols
    stands the uniform distribution. N-grams are kept as sorted arrays of 64-bit hashes.
    """

    def __init__(self, keys: np.ndarray | tuple, counts: np.ndarray, order: int = ORDER, symbols: int = 256):
        self.order, self.symbols = order, symbols
        self.levels = []
        context, last = _pairs(keys)
        for k in range(order, 0, -1):
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once else 0.5
            own, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, counts)
            weight = discount * np.bincount(where) / total
            part = np.maximum(counts - discount, 0) / total[where]
            hashes = _hashed(context, last)
            by = np.argsort(hashes)
            self.levels.append((hashes[by], part[by], own, weight))
            if k > 1:
                context = context & np.uint64(_suffix(k - 2))
                _, at, counts = np.unique(_hashed(context, last), return_index=True, return_counts=True)
                context, last = context[at], last[at]

    def __call__(self, keys: np.ndarray | tuple) -> np.ndarray:
        """Probability of the last symbol of each key after the others."""
        context, last = _pairs(keys)
        p = np.full(len(last), 1 / self.symbols)
        for k, (hashes, part, contexts, weight) in zip(range(1, self.order + 1), reversed(self.levels)):
            own = context & np.uint64(_suffix(k - 1))
            p = _found(hashes, part, _hashed(own, last), 0.0) + _found(contexts, weight, own, 1.0) * p
        return p


def _found(keys: np.ndarray, values: np.ndarray, want: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], missing)


class Languages:
    """The models of all languages with the table of log-probabilities for every known n-gram."""

    def __init__(self, counted: pd.DataFrame, column: str, symbols: int):
        counted = counted[counted[column] > 0]
        self.names = sorted(counted["lang"].unique())
        pairs = lambda rows: (rows["context"].to_numpy(np.int64).astype(np.uint64), rows["last"].to_numpy(np.int64).astype(np.uint64))
        self.models = [
            Model(pairs(rows), rows[column].to_numpy(np.float64), ORDER, symbols) for _, rows in sorted(counted.groupby("lang"), key=lambda x: x[0])
        ]
        context, last = pairs(counted)
        self.hashes, at = np.unique(_hashed(context, last), return_index=True)
        known = context[at], last[at]
        self.table = np.stack([np.log(m(known)) for m in self.models], axis=1) if self.models else None

    def log_probabilities(self, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        want = _hashed(*keys)
        at = np.minimum(np.searchsorted(self.hashes, want), len(self.hashes) - 1)
        out = self.table[at]
        new = np.flatnonzero(self.hashes[at] != want)
        if len(new):
            some = keys[0][new], keys[1][new]
            out[new] = np.stack([np.log(m(some)) for m in self.models], axis=1)
        return out

    def entropies(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text in each language, and the number of symbols (0: no letter)."""
        sums, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        owners, parts, held = [], [], 0

        def score() -> None:
            lengths = [len(last) for _, last in parts]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            keys = tuple(np.concatenate(side) for side in zip(*parts))
            np.add.at(sums, owners, np.add.reduceat(self.log_probabilities(keys), starts, axis=0))

        for i, text in enumerate(texts):
            codes = symbols(text, table) if text else None
            if codes is None or not codes.any():
                continue
            sizes[i] = len(codes) - ORDER + 1
            for a in range(0, int(sizes[i]), SLICE):
                keys = grams(codes[a : a + SLICE + ORDER - 1])
                owners.append(i), parts.append(keys)
                held += len(keys[1])
                if held >= SLICE:
                    score()
                    owners, parts, held = [], [], 0
        if parts:
            score()
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def _tally(context: np.ndarray, last: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams with the sum of ``n`` (1 each if not given)."""
    _, at, where = np.unique(_hashed(context, last), return_index=True, return_inverse=True)
    return context[at], last[at], np.bincount(where, n).astype(np.int64)


def _counts(train: DataFrame) -> DataFrame:
    """``(lang, context, last, n, rest)``: how often in all training texts, and in those not set aside to calibrate."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = symbol_table()
        held: dict[tuple, tuple] = {}
        waiting: dict[tuple, list[tuple]] = {}
        size: dict[tuple, int] = {}

        def settle(group: tuple) -> None:
            new = _tally(*(np.concatenate(side) for side in zip(*waiting.pop(group))))
            held[group] = _tally(*(np.concatenate(side) for side in zip(held[group], new))) if group in held else new
            size[group] = 0

        def rows(group: tuple) -> pd.DataFrame:
            context, last, n = held.pop(group)
            return pd.DataFrame({"lang": group[0], "context": context.astype(np.int64), "last": last.astype(np.int64), "n": n, "rest": 0 if group[1] else n})

        for batch in batches:
            for text, lang, aside in zip(batch["text"], batch["lang"], batch["aside"]):
                codes = symbols(text, table)
                if not codes.any():
                    continue
                group = (lang, bool(aside))
                for a in range(0, len(codes) - ORDER + 1, SLICE):
                    waiting.setdefault(group, []).append(grams(codes[a : a + SLICE + ORDER - 1]))
                    size[group] = size.get(group, 0) + len(waiting[group][-1][1])
                    if size[group] >= 4 * SLICE:
                        settle(group)
                        if len(held[group][1]) >= HELD:
                            yield rows(group)
        for group in list(waiting):
            settle(group)
        for group in list(held):
            yield rows(group)

    found = train.mapInPandas(count, "lang string, context long, last long, n long, rest long")
    return found.groupBy("lang", "context", "last").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))


def _probabilities(wanted: DataFrame, counted: DataFrame, column: str, names: list[str], symbols: int) -> DataFrame:
    """``context, last, p``: what ``Model`` gives for each wanted n-gram in each language, by joins."""
    languages = F.array(*[F.lit(x) for x in names])
    entries = lambda value: F.map_from_entries(F.collect_list(F.struct("lang", value)))  # one per language
    keys, levels = counted.filter(F.col(column) > 0).select("lang", "context", "last", F.col(column).alias("c")), []
    for k in range(ORDER, 0, -1):
        keys = stored(keys, "language-level")
        few = keys.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"))
        few = few.select("lang", F.when(F.col("once") > 0, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5).alias("d"))
        contexts = keys.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types")).join(F.broadcast(few), "lang")
        part = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        parts = keys.join(contexts, ["lang", "context"]).groupBy("context", "last").agg(entries(part.alias("v")).alias("parts"))
        weights = contexts.groupBy("context").agg(entries((F.col("d") * F.col("types") / F.col("total")).alias("v")).alias("weights"))
        levels.append((parts, weights))
        if k > 1:
            below = F.col("context").bitwiseAND(F.lit(_suffix(k - 2)))
            keys = keys.groupBy("lang", below.alias("context"), "last").agg(F.count("*").alias("c"))
    lower = None
    for k, (parts, weights) in zip(range(1, ORDER + 1), reversed(levels)):
        own = wanted.select(F.col("context").bitwiseAND(F.lit(_suffix(k - 1))).alias("context"), "last").distinct()
        own = own.join(parts, ["context", "last"], "left").join(weights, "context", "left")
        if lower is None:
            base = lambda i: F.lit(1 / symbols)
        else:
            own = own.withColumn("_below", F.col("context").bitwiseAND(F.lit(_suffix(k - 2))))
            own = own.join(lower.select(F.col("context").alias("_below"), "last", F.col("p").alias("_p")), ["_below", "last"])
            base = lambda i: F.get("_p", i)
        value = lambda name, i: F.coalesce(F.try_element_at("parts", name), F.lit(0.0)) + F.coalesce(F.try_element_at("weights", name), F.lit(1.0)) * base(i)
        lower = stored(own.select("context", "last", F.transform(languages, value).alias("p")), "language-probabilities")
    return lower


def _joined(rows: DataFrame, counted: DataFrame, column: str, names: list[str], symbols_: int) -> DataFrame:
    """What ``_measured`` gives, for models of any size: n-grams of texts meet their probabilities in a join."""
    kept = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "language-rows")

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = symbol_table()
        for batch in batches:
            for row, text in zip(batch["_row"], batch["text"]):
                codes = symbols(text, table)
                for a in range(0, len(codes) - ORDER + 1 if codes.any() else 0, SLICE):
                    context, last, n = _tally(*grams(codes[a : a + SLICE + ORDER - 1]))
                    yield pd.DataFrame({"_row": row, "context": context.astype(np.int64), "last": last.astype(np.int64), "n": n})

    found = kept.filter("text is not null").select("_row", "text").mapInPandas(taken, "_row long, context long, last long, n long")
    found = stored(found, "language-grams")
    p = _probabilities(found.select("context", "last").distinct(), counted, column, names, symbols_)
    sums = [F.sum(-F.col("n") * F.log(F.get("p", F.lit(i)))) for i in range(len(names))]
    size = F.sum("n")
    scored = found.join(p, ["context", "last"]).groupBy("_row").agg(F.array(*[s / size for s in sums]).alias("_e"), size.alias("_n"))
    none = F.array(*[F.lit(0.0)] * len(names))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return kept.join(scored, "_row", "left").select(*own, F.coalesce("_e", none).alias("_e"), F.coalesce("_n", F.lit(0)).alias("_n"))


def _measured(rows: DataFrame, counted: DataFrame, column: str, symbols_: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``_e``, nats per symbol of ``text`` in each language, and ``_n``, its symbols; and the languages.

    Models of up to ``MOST_CELLS`` numbers go to every task, larger ones are joined: the same rows.
    """
    per = counted.filter(F.col(column) > 0).groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    names = sorted(r["lang"] for r in per)
    if not names:
        return rows.withColumns({"_e": F.array().cast("array<double>"), "_n": F.lit(0).cast("long")}), names
    # an n-gram has a hash and a value at each of four orders, as much for contexts, and a row of the table of all languages
    if sum(r["n"] for r in per) * (4 * ORDER + len(names)) > MOST_CELLS:
        return _joined(rows, counted, column, names, symbols_), names
    models = rows.sparkSession.sparkContext.broadcast(Languages(counted.toArrow().to_pandas(), column, symbols_))

    @F.pandas_udf("_e array<double>, _n long")
    def entropies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = symbol_table()
        for texts in batches:
            e, n = models.value.entropies(texts.to_list(), table)
            yield pd.DataFrame({"_e": list(e), "_n": n})

    return rows.withColumn("_m", entropies.asNondeterministic()("text")).select(*[F.col(f"`{c}`") for c in rows.columns], "_m.*"), names


def _platt(features: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge; targets are smoothed by the class sizes."""
    yes, no = right.sum(), (~right).sum()
    target = np.where(right, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def _features(entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far the best language is ahead, per symbol and over the text, and how well it fits."""
    ordered = np.sort(entropies, axis=1)
    ahead = ordered[:, 1] - ordered[:, 0] if entropies.shape[1] > 1 else np.zeros(len(entropies))
    return np.column_stack([ahead, np.log1p(ahead * sizes), ordered[:, 0]])


def _stacked(entropies: pd.Series, languages: int) -> np.ndarray:
    """A row per text; ties and rows do not depend on the order in which a sum was taken."""
    return np.round(np.array(entropies.to_list(), float).reshape(-1, languages), DIGITS)


def identify(documents: DataFrame, learn: Column, aside: Column, others: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``others``, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    Models learn from the rows for which ``learn`` holds and whose language is known; the language is
    not read anywhere else. Characters are letters in lower case, each its own
    symbol in every script, with one gap for all between. Counts
    cover all training texts: tasks count whole n-grams, Spark adds them. The language of least cross-entropy
    per character wins; ties go to the first by name. ``score`` is the calibrated chance that it is
    right. Calibration uses the training rows for which ``aside`` holds, scored by models without
    them; ``rejected`` marks texts whose cross-entropy is above all but one in a thousand of those of
    their language.

    The order is the same for any number of n-grams: small models go to every task as one broadcast, larger
    ones meet the n-grams of the texts in a join (``_measured``). Null text or one without a letter gives
    ``und``, 0, null and false, and so does every text if nothing can be learned. Rows may repeat; an
    empty table gives no rows.
    """
    train = documents.filter(learn).filter("lang is not null and text is not null").select("text", "lang", F.coalesce(aside, F.lit(False)).alias("aside"))
    counted = stored(_counts(train), "language-counts")
    n_symbols = counted.select("last").distinct().count() + 1  # one for all that were never seen

    weights, limits = None, {}
    trial, half = _measured(train.filter("aside").select("text", "lang"), counted, "rest", n_symbols)
    if half:

        @F.pandas_udf("best string, a double, b double, c double")
        def measure(entropies: pd.Series, sizes: pd.Series) -> pd.DataFrame:
            e, n = _stacked(entropies, len(half)), sizes.to_numpy()
            f = _features(e, n)
            best = np.array(half, dtype=object)[e.argmin(axis=1)]
            return pd.DataFrame({"best": best, "a": f[:, 0], "b": f[:, 1], "c": f[:, 2]})

        pick = F.xxhash64("text", "lang").alias("pick")
        tried = trial.filter("_n > 0").select("lang", pick, measure("_e", "_n").alias("_m"), F.col("_n").alias("n")).select("lang", "pick", "_m.*", "n")
        tried = stored(tried, "language-trial")
        right = tried.filter("best = lang")
        limits = {r["lang"]: r["q"] for r in right.groupBy("lang").agg(F.percentile_approx("c", 0.999).alias("q")).collect()}
        share = min(1.0, CALIBRATION_ROWS / max(1, tried.count()))
        some = tried.filter(F.pmod("pick", F.lit(1 << 20)) < int(share * (1 << 20))).toArrow().to_pandas()
        if len(some):
            some = some.sort_values(["a", "b", "c", "n", "lang"])
            weights = _platt(some[["a", "b", "c"]].to_numpy(), (some["best"] == some["lang"]).to_numpy())

    own = [c for c in others if c not in ("lang_pred", "score", "cross_entropy", "rejected")]
    found, final = _measured(documents.select(*own, "text"), counted, "n", n_symbols)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predicted(entropies: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        if not final or not len(sizes):
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(sizes), "score": 0.0, "cross_entropy": None, "rejected": False})
        names = np.array([*final, UNKNOWN], dtype=object)
        e, n = _stacked(entropies, len(final)), sizes.to_numpy()
        known, f = n > 0, _features(e, n)
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(f)), f]) @ weights, -30, 30))) if weights is not None else 0.5
        best = names[np.where(known, e.argmin(axis=1), len(final))]
        limit = np.array([limits.get(x, np.inf) for x in best])
        fit = pd.Series(f[:, 2]).astype(object).where(known, None)
        return pd.DataFrame({"lang_pred": best, "score": np.where(known, p, 0.0), "cross_entropy": fit, "rejected": known & (f[:, 2] > limit)})

    return found.select(*own, predicted("_e", "_n").alias("_found")).select(*own, "_found.*")


FOLDS = 5


def query(documents: DataFrame) -> DataFrame:
    """Documents whose id falls in fold 0 are held out; those of fold 1 calibrate."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    placed = documents.select("doc_id", "text", "lang", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), fold.alias("fold"))
    found = identify(placed, F.col("fold") != 0, F.col("fold") == 1, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
