"""Periodic runs, Merkle manifests and toxicity: brute force, versions, held-out accuracy and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.llm import merkle, periodic_runs, queries, toxicity
from proofgrid.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (None, "no id " * 30, "en", "s", 180),
    (5, "same text twice over.", "en", "s", 21),
    (5, "same text twice over.", "en", "s", 21),
    (6, "A b C " * 50_000, None, None, 300_000),
    (7, "línea – 漢字 \U0001f600 tail", "xx", "t", 16),
]


def documents(spark, rows, clash=True):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA).coalesce(2)
    return df.withColumns({c: F.lit("clash") for c in ("runs", "collapsed_text", "best", "score", "toxic", "weight", "n_words", "leaf", "at", "root")}) if clash else df


# periodic runs


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(s <= i and j + q <= s + n and q % p == 0 for s, n, p in found):
                found.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(found)


def words_with_repeats(rnd):
    alphabet = rnd.choice([1, 2, 3, 5, 50])
    words = [rnd.randrange(alphabet) for _ in range(rnd.randrange(600))]
    for _ in range(rnd.randrange(6)):
        period = rnd.randrange(1, rnd.choice([3, 9, 40, 120]))
        block = [0] * (period - 1) + [1] if rnd.random() < 0.3 else [rnd.randrange(alphabet) for _ in range(period)]
        at = rnd.randrange(len(words) + 1)
        words[at:at] = (block * rnd.randrange(2, 9))[: rnd.randrange(1, 9 * period)]
    return [b"%d" % w for w in words]


@pytest.mark.parametrize("portion", [1, 7, 100, 1 << 16])
def test_runs_against_brute_force(monkeypatch, portion):
    monkeypatch.setattr(periodic_runs, "PORTION", portion)
    rnd = random.Random(portion)
    for _ in range(60 if portion == 1 else 200):
        words = words_with_repeats(rnd)
        assert periodic_runs.runs_of(words) == brute_runs(words)


def test_runs_that_overlap_and_touch():
    a, b = [b"a", b"b"], [b"b", b"a", b"c"]
    words = a * 20 + b * 10
    assert periodic_runs.runs_of(words) == brute_runs(words)
    assert periodic_runs.runs_of([b"x"] * 23) == [] and periodic_runs.runs_of([b"x"] * 24) == [(0, 24, 1)]
    assert periodic_runs.runs_of([b"%d" % (i % 9) for i in range(26)]) == []
    assert periodic_runs.runs_of([b"%d" % (i % 9) for i in range(27)]) == [(0, 27, 9)]


def test_long_periods_and_nested_runs():
    block = [b"%d" % (i * i % 1009) for i in range(1000)] + [b"x"] * 40
    words = [b"start"] + block * 4 + [b"end"]
    runs = periodic_runs.runs_of(words)
    assert (1, 4160, 1040) in runs and sum(p == 1 for _, _, p in runs) == 4 and len(runs) == 5
    assert periodic_runs.collapsed(words, runs) == [b"start"] + block[:1001] + [b"end"]


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = periodic_runs.runs_of(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)), words, runs,
    )


def test_periodic_query_against_python(spark):
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    found = queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert len(found) == len(docs)
    checked = 0
    for r in found:
        *want, words, runs = expected_row(r.doc_id, docs[r.doc_id])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == tuple(want)
        if runs and len(words) < 1500:
            assert runs == brute_runs(words)
            checked += 1
    assert checked > 5


def test_odd_rows_periodic(spark):
    found = periodic_runs.query(documents(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    for doc_id, text, *_ in ODD:
        *want, _, _ = expected_row(doc_id, text)
        r = by[doc_id]
        assert [r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256] == want
    assert by[None].period == 2 and by[1].n_runs == 0 and by[1].start is None
    assert periodic_runs.query(documents(spark, [])).count() == 0
    kept = periodic_runs.with_runs(documents(spark, ODD))
    assert kept.filter("best <> 'clash'").count() == 0 and kept.filter("doc_id = 1").first().collapsed_text == ""


# Merkle manifest


def sha(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha(*level[i : i + 8]) for i in range(0, len(level), 8)])
    return levels


def brute_path(levels, at):
    steps = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        steps.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return steps


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    h = lambda r, text: sha(*[enc(v) for v in (r[0], r[3], r[2], r[4], text)])
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(r, r[1]), h(r, lower(r[1])) if hit else None))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = brute_levels([x[2] for x in groups[g]])
    top = brute_levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for at, (has, doc_id, leaf, changed) in enumerate(groups[g]):
            steps = brute_path(trees[g], at) + brute_path(top, k)
            digest = changed or leaf
            for left, right in steps:
                digest = sha(*left, digest, *right)
            proof = sha(*[d for left, right in steps for d in [*left, *right]])
            out.append((doc_id if has else None, leaf, trees[g][-1][0], root, proof, digest, digest == root))
    return out


def check_manifest(spark, rows):
    found = merkle.query(documents(spark, rows)).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)
    return got


def test_odd_rows_merkle(spark):
    got = check_manifest(spark, ODD)
    assert len(got) == len(ODD)
    assert merkle.query(documents(spark, [])).count() == 0


def test_one_leaf_is_its_own_root(spark):
    ((_, leaf, subroot, root, proof, _, _),) = check_manifest(spark, [(4, "Aa", "en", "s", 2)])
    assert leaf == subroot == root and proof == sha()


@pytest.mark.parametrize("sizes", [(8, 9, 1), (64, 65), (512, 513, 2), (4097,)])
def test_trees_of_every_height(spark, sizes):
    rows = [(1000 * k + i, f"Text {i}", f"l{k}" if k else None, "s", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    got = check_manifest(spark, rows)
    assert not all(r[6] for r in got)


def test_many_groups(spark):
    check_manifest(spark, [(i, "A", f"g{i % 130}", "s", 1) for i in range(300)])


def test_a_version_shares_what_it_did_not_touch():
    root, height = merkle.tree([bytes([i]) * 32 for i in range(100)], True)
    other = merkle.replaced(root, height, 37, b"x" * 32)
    nodes = lambda n: {id(n)} | {i for c in n.children for i in nodes(c)}
    assert height == 3 and len(nodes(other) - nodes(root)) == 4  # the leaf and its three ancestors
    assert other.digest != root.digest and merkle.replaced(other, height, 37, bytes([37]) * 32).digest == root.digest


# toxicity


def test_folding():
    assert toxicity.folded("Idіοt 1d10t, $cum cl0wn! STUPID$$$ ​mo­ron ＩＤＩＯＴ") == ["idiot", "idiot", "scum", "ciown", "stupid", "moron", "idiot"]
    assert toxicity.folded("123 -- 4,5 it's a\nx-y") == ["it", "s", "a", "x", "y"]
    assert toxicity.folded(None) == [] and toxicity.folded("") == []


def test_exceptions_and_longest_terms():
    matcher = toxicity.Matcher(toxicity.Lexicon({" trash ": 4.0, " trash": 1.0, " scum ": 2.0}, frozenset({" trash can "})))
    assert matcher.measure("a trash trashy scum".split()) == (4, 3, 0, 7.0)
    assert matcher.measure("trash can and trash scum".split()) == (5, 2, 1, 6.0)
    assert toxicity.Matcher(toxicity.Lexicon()).measure(["x"]) == (1, 0, 0, 0)


def made_corpus(n, rnd):
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(40, 120))]
        bad = i % 4 == 0
        for _ in range(5 if bad else 0):
            words[rnd.randrange(len(words))] = rnd.choice(["grobian", "gr0bian", "Lümmel"])
        if not bad and i % 4 == 1:
            at = rnd.randrange(len(words) - 1)
            words[at : at + 2] = ["grobian", "museum"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learned_lexicon_and_exceptions(spark):
    rows, labels = made_corpus(600, random.Random(5))
    copy = " ".join(f"unique{chr(97 + i)}" for i in range(26)) + " grobian grobian"
    rows += [(10_000 + i, copy) for i in range(300)]  # copies of one toxic text say no more than one text
    labels += [(10_000 + i, 1) for i in range(300)]
    docs, marks = documents(spark, rows, clash=False), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks, F.col("doc_id") % 3 != 1)
    assert " grobian " in lexicon.weights and " iummei " in lexicon.weights
    assert " grobian museum " in lexicon.exceptions
    assert not any("unique" in term for term in lexicon.weights)
    truth = dict(labels)
    held = [r for r in toxicity.scored(docs, lexicon).collect() if r.doc_id % 3 == 1]
    assert np.mean([r.toxic == bool(truth[r.doc_id]) for r in held]) > 0.98
    assert any(r.n_excepted for r in held)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    found = queries.QUERIES["op13_toxicity"](spark, folder).collect()
    assert len(found) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [(toxic[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in toxic]
    assert np.mean([p for t, p in held if t == 1]) > 0.9 and np.mean([p for t, p in held if t == 0]) < 0.01


def test_odd_rows_toxicity(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    everything = F.lit(True)
    found = toxicity.scored(docs, toxicity.fit(docs, none, everything)).collect()
    assert len(found) == len(ODD) and all(r.score == 0 and not r.toxic for r in found)
    odd = spark.createDataFrame([(5, 1), (5, None), (5, 0), (None, 1), (6, 0), (1, 1), (99, 1)], "doc_id long, toxic int")
    assert {r.doc_id for r in toxicity.scored(docs, toxicity.fit(docs, odd, everything)).collect()} == {r[0] for r in ODD}
    empty = documents(spark, [])
    assert toxicity.scored(empty, toxicity.fit(empty, none, everything)).count() == 0
    one_class = toxicity.fit(docs, spark.createDataFrame([(5, 1), (6, 1)], "doc_id long, toxic int"), everything)
    assert {r.score for r in toxicity.scored(docs, one_class).collect()} == {1.0}
