"""The queries over the smallest tables: SQL twins, brute force, round trips and held-out accuracy."""

import glob
import hashlib
import os
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from proofgrid.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    result = duck.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_every_number_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def word_sets(docs):
    sets = {}
    for d, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def brute_components(sets, link=80):
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= link * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_near_duplicates_against_all_pairs(spark, docs):
    sets = word_sets(docs)
    want = brute_components(sets, 85)
    for r in queries.QUERIES["op7_near_duplicates"](spark, FOLDER).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def check_pieces(pieces, texts):
    """``texts``: (doc_id, text) of single rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start), 0
        for p in own:
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 1024
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in sequences.values()) / sum(sequences.values())


def test_packing_round_trip(spark, docs):
    assert check_pieces(queries.QUERIES["op5_packing"](spark, FOLDER).collect(), docs.items()) < 0.02


def test_flac_round_trip(spark, docs):
    for r in queries.QUERIES["op9_flac"](spark, FOLDER).collect():
        raw = (docs[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])


def test_language_of_held_out_documents(spark, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    found = queries.QUERIES["op4_language_id"](spark, FOLDER).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_quality_agrees_with_labels(spark, duck):
    folder = "/root/testdata/sf0.01"
    quality = dict(duck.execute(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    found = {r.doc_id: r for r in queries.QUERIES["op3_quality_cotraining"](spark, folder).collect()}
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found.values())
    assert np.mean([found[d].kept == bool(q) for d, q in quality.items()]) > 0.97


def test_secrets_are_told_from_numbers(spark):
    found = queries.QUERIES["op1_secrets"](spark, "/root/testdata/sf0.01").collect()
    assert found
    for r in found:
        assert r.is_secret == (len(r.value) == 40 and not r.value.isdigit())


def test_pipeline_stages(spark, duck):
    before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        if name != "packing":
            assert after.columns == before.columns
            after = spark.createDataFrame(after.collect(), before.schema)
            ids = {r.doc_id for r in after.collect()}
            assert ids <= {r.doc_id for r in before.collect()}
        kept[name], before = after, after
    sets = word_sets({r.doc_id: r.text for r in kept["lines"].collect()})
    want = brute_components(sets)
    assert sorted(r.doc_id for r in kept["near_duplicates"].collect()) == sorted({c for d, c in want.items()})
    quality = dict(duck.execute("select doc_id, quality from labels").fetchall())
    good = [d for d, q in quality.items() if q == 1]
    stayed = {r.doc_id for r in kept["quality"].collect()}
    assert np.mean([d in stayed for d in good]) > 0.95
    words = kept["near_duplicates"].select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    mixed = kept["mixing"].select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(mixed - words) < 0.15 * words
    assert kept["packing"].count() >= kept["mixing"].count()
