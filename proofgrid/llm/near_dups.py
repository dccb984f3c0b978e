"""MinHash near-duplicates: banding, signature and full-set verification, components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import partitions, stored
from proofgrid.session import durable

SHINGLE = 5  # words
MINIMA = 384  # universal hash minima per document; the first ``bands * rows`` make the bands


@dataclass(frozen=True)
class Linking:
    """When two sets are linked, and bands and signature floor that lose no more than one such pair in 80,000 each."""

    link: int  # per cent of the union that linked sets share, at least
    bands: int
    rows: int  # of minima in a band
    floor: float  # estimated similarity, four standard errors below the threshold


AT_80 = Linking(80, 30, 5, 0.71)  # a pair at the threshold misses every band once in 150,000 times
AT_85 = Linking(85, 24, 6, 0.77)  # once in 80,000 times, at 0.9 once in 80 million
BLOCK = 512  # documents of a bucket that are compared with as many others at once

_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SPREAD
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes of its shingles; fewer words than a shingle are one.

    ``known`` remembers the hashes of words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both are ASCII only on bytes
    if not words:
        return np.empty(0, np.uint64)
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _MIX + codes[i : i + n])
    return np.unique(out)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each universal hash over each (non-empty) set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), MINIMA), np.uint32)
    for i in range(MINIMA):
        out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], starts)
    return out


_FORGET = 500_000  # words a task remembers


def _fingerprints(batches: Iterator[pd.Series], linking: Linking) -> Iterator[pd.DataFrame]:
    known: dict[bytes, int] = {}

    def part(texts: pd.Series) -> list[tuple]:
        if len(known) > _FORGET:
            known.clear()
        sets = [shingles(t, known) for t in texts]
        full = [s for s in sets if len(s)]
        sig = iter(signature(full)) if full else iter(())
        out = []
        for s in sets:
            if not len(s):
                out.append((0, None, None, None))
                continue
            minima = next(sig)
            rows = minima[: linking.bands * linking.rows].reshape(linking.bands, linking.rows)
            bands = [xxhash.xxh3_64_intdigest(r.tobytes(), band) - (1 << 63) for band, r in enumerate(rows)]
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands, minima.astype(np.uint8).tobytes()))
        return out

    for texts in batches:
        # few at a time, so that their hashes stay in the processor's cache
        rows = [row for at in range(0, len(texts), 64) for row in part(texts.iloc[at : at + 64])]
        yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "bands", "minima"])


def fingerprints(documents: DataFrame, linking: Linking = AT_80) -> DataFrame:
    """Per document: size and 128-bit key of its shingle set, band hashes, and one byte of each minimum."""

    @F.pandas_udf("n_shingles long, set_key binary, bands array<long>, minima binary")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _fingerprints(batches, linking)

    made = prints.asNondeterministic()
    return documents.select("doc_id", made("text").alias("_f")).select("doc_id", "_f.*")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from bytes of minima: equal bytes are chance once in 256 times."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def confirmed(pairs: DataFrame, documents: DataFrame, linking: Linking) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are linked.

    Only texts that stand in a pair are taken along.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        last: dict[str, tuple[str, np.ndarray]] = {}

        def set_of(side: str, text: str) -> np.ndarray:
            if side not in last or last[side][0] != text:
                last[side] = (text, shingles(text, known))
            return last[side][1]

        for batch in batches:
            if len(known) > _FORGET:
                known.clear()
            links = []
            for a, b in zip(batch["text_a"], batch["text_b"]):
                x, y = set_of("a", a), set_of("b", b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(both > 0 and 100 * both >= linking.link * (len(x) + len(y) - both))
            yield batch.loc[links, ["a", "b"]]

    pairs = stored(pairs, "near-pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = stored(documents.join(ends, "doc_id", "left_semi"), "near-texts")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """Members of the buckets of two or more: ``bucket``, ``doc_id``, the smallest member ``p`` and the size ``n``."""
    members = classes.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.min("doc_id").alias("p"), F.count("*").alias("n")).filter("n > 1")
    return members.join(sizes, "bucket")


def star_pairs(members: DataFrame, classes: DataFrame, linking: Linking) -> DataFrame:
    """Each member of a bucket with its smallest, where sizes and signatures allow a link."""
    pairs = members.filter("doc_id <> p").select(F.col("doc_id").alias("a"), F.col("p").alias("b")).distinct()
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("minima").alias(f"minima_{c}"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = lambda c: np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, MINIMA)
                yield batch.loc[_alike(rows("minima_a"), rows("minima_b")) >= linking.floor, ["a", "b"]]

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= linking.link * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "minima_a", "minima_b").mapInPandas(near, "a long, b long")


def _open_pairs(rows: dict[str, np.ndarray], linking: Linking) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket and two of its blocks (or one, if they are the same) that may be links."""
    label, size, ids = rows["component"], rows["n_shingles"], rows["doc_id"]
    right = np.flatnonzero(rows["own"] == rows["j"])
    left = np.flatnonzero(rows["own"] == rows["i"])
    within = rows["i"][0] == rows["j"][0]
    out_a, out_b = [ids[:0]], [ids[:0]]
    for place, k in enumerate(left):
        others = right[place + 1 :] if within else right
        small, big = np.minimum(size[k], size[others]), np.maximum(size[k], size[others])
        others = others[(label[others] != label[k]) & (100 * small >= linking.link * big)]
        others = others[_alike(rows["minima"][others], rows["minima"][k]) >= linking.floor] if len(others) else others
        if len(others):
            common = rows["bands"][others] == rows["bands"][k]
            first = rows["bands"][k][common.argmax(axis=1)]
            others = others[first == rows["bucket"][k]]
            out_a.append(np.full(len(others), ids[k]))
            out_b.append(ids[others])
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare_blocks(batches: Iterator[pd.DataFrame], linking: Linking) -> Iterator[pd.DataFrame]:
    """Runs of one bucket and pair of blocks; a run may go on in the next batch, and holds two blocks at most."""
    held: dict[str, np.ndarray] | None = None

    def runs(rows: dict[str, np.ndarray], last: bool):
        task = np.stack([rows["bucket"], rows["i"], rows["j"]])
        starts = np.concatenate([[0], np.flatnonzero((task[:, 1:] != task[:, :-1]).any(axis=0)) + 1, [task.shape[1]]])
        ends = len(starts) - 1 if last else len(starts) - 2
        found = [_open_pairs({c: v[a:b] for c, v in rows.items()}, linking) for a, b in zip(starts[:ends], starts[1 : ends + 1])]
        rest = {c: v[starts[ends] :] for c, v in rows.items()}
        a, b = (np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64) for side in (0, 1))
        return pd.DataFrame({"a": a, "b": b}), rest

    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch[c].to_numpy(np.int64) for c in ("bucket", "i", "j", "own", "doc_id", "n_shingles", "component")}
        rows["minima"] = np.frombuffer(b"".join(batch["minima"]), np.uint8).reshape(-1, MINIMA)
        rows["bands"] = np.stack(batch["bands"].to_list())
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        out, held = runs(rows, False)
        yield out
    if held is not None and len(held["bucket"]):
        yield runs(held, True)[0]


def rest_pairs(members: DataFrame, classes: DataFrame, found: DataFrame, linking: Linking) -> DataFrame:
    """Pairs inside buckets that the stars left in different components and that signatures allow.

    The smallest member has been compared with all; buckets whose others are one component are done.
    The rest are dealt in blocks of about ``BLOCK`` members, and a task compares the signatures of two
    blocks at a time, so no task holds a large bucket and pairs that fail exist only inside numpy. A
    pair is given once, by its first common band.
    """
    others = members.filter("doc_id <> p and n > 2").join(found, "doc_id", "left")
    others = others.withColumn("component", F.coalesce("component", "doc_id")).drop("p")
    ends = others.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = others.join(ends.filter("lo < hi").select("bucket"), "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = left.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")})
    left = left.join(classes.select("doc_id", "n_shingles", "minima", "bands"), "doc_id")
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other", "n")
    task = ["bucket", "i", "j"]
    compare = lambda batches: _compare_blocks(batches, linking)
    return dealt.repartition(partitions(members), *task).sortWithinPartitions(*task, "doc_id").mapInPandas(compare, "a long, b long")


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(doc_id, component)`` for the ends of edges ``(u, v)``: the smallest id reached, left out for that id itself.

    Large-star links the larger neighbours of each node to its smallest neighbour, small-star the
    smaller ones, by turns until no edge changes. Minima are partial aggregates, and the join that
    takes them back to the edges is split where a node is hot. Each round is checkpointed.
    """
    edges = durable(edges.filter("u <> v").distinct())
    before = None
    while True:
        both = _symmetric(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = durable(small.filter("u <> v").distinct())
        after = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == after:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc_id")


def near_duplicates(documents: DataFrame, linking: Linking = AT_80) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set holds its distinct shingles of five words (ASCII lower case); a shorter text is one
    shingle. Two documents are linked if their sets share at least ``linking.link`` per cent of their union;
    a component is named by its smallest id, and that document is kept.

    1. Equal sets meet by a 128-bit key in a partial aggregate and go on as their smallest id.
    2. Signatures are cut into bands. In each bucket every member is compared with the smallest: by size
       and signature, then on full sets, which are made again from the whole texts.
    3. Components of these links. What a bucket still holds in different components is compared pair
       by pair, in blocks, and confirmed in the same way; then components are taken again.
    Sets are compared as 64-bit hashes of shingles.

    Null text or one without words has an empty set and is linked with nothing. Rows with equal ids are
    one document and end in one component. A null id is linked with nothing: component null, kept.
    Other columns are not read; an empty table gives no rows.
    """
    prints = durable(fingerprints(documents, linking))
    some = prints.filter("doc_id is not null and n_shingles > 0")
    least = F.min_by(F.struct("doc_id", "n_shingles", "bands", "minima"), "doc_id").alias("least")
    classes = durable(some.groupBy("set_key").agg(least).select("set_key", "least.*"))
    members = durable(shared_buckets(classes))
    texts = documents.select("doc_id", "text").filter("doc_id is not null")
    edge = lambda u, v: (F.coalesce(*u).alias("u"), F.coalesce(*v).alias("v"))

    links = confirmed(star_pairs(members, classes, linking), texts, linking)
    found = durable(components(links.select(*edge(("a",), ("b",)))))
    more = confirmed(rest_pairs(members, classes, found, linking), texts, linking)
    label = lambda side: found.select(F.col("doc_id").alias(side), F.col("component").alias(f"c{side}"))
    more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(*edge(("ca", "a"), ("cb", "b")))

    equal = some.select("set_key", F.col("doc_id").alias("u")).join(classes.select("set_key", F.col("doc_id").alias("v")), "set_key")
    # an id that stands in several classes ties them together
    tied = equal.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v <> w").select("u")
    joined = components(found.select(*edge(("doc_id",), ("component",))).union(more).union(equal.join(tied, "u").select("u", "v")))
    named = equal.join(joined.select(F.col("doc_id").alias("v"), "component"), "v", "left")
    named = named.groupBy(F.col("u").alias("doc_id")).agg(F.min(F.coalesce("component", "v")).alias("component_id"))
    out = prints.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents, AT_85)
