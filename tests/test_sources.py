import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import gates
from proofgrid.sources import files, records, shapes


def record(i, question="q", answer="a"):
    return {
        "messages": [{"role": "user", "content": f"<image>{question}"}, {"role": "assistant", "content": answer}],
        "images": [f"images/{i}.jpg"],
        "metadata": {"img_id": str(i), "source_img_id": str(i), "question_class": ["c"]},
    }


def test_blank_lines_vanish_and_malformed_lines_fail(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(record(1, "é")) + "\n\n   \n" + json.dumps(record(2)) + "\n", encoding="utf-8")
    rows = files.read_json_lines(spark, str(good), shapes.QA_RECORD)
    assert rows.count() == 2
    assert records.with_keys(rows).filter("source = '1'").first()["question"] == "é"
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(record(1)) + "\n{not json\n")
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(bad), shapes.QA_RECORD).collect()


def test_prediction_files_by_name(spark, tmp_path):
    for name in ("development__tuned.jsonl", "development__tuned__scored.jsonl", "test__tuned.jsonl", "development__a__b.jsonl"):
        (tmp_path / name).write_text(json.dumps({"item_id": name}) + "\n")
    rows = files.read_predictions(spark, str(tmp_path), "development", shapes.PREDICTION)
    assert {(r["item_id"], r["condition"]) for r in rows.collect()} == {
        ("development__tuned.jsonl", "tuned"), ("development__a__b.jsonl", "a__b")
    }


def test_manifest_of_binary_files_and_changed_hashes(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x00\xff\x10")
    (tmp_path / "b.jpg").write_bytes(b"x")
    (tmp_path / "empty.jpg").write_bytes(b"")
    rows = files.manifest(files.binary_files(spark, str(tmp_path), "*.jpg"), "r1")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"], r["revision"]) for r in rows.collect()}
    assert got["a.jpg"] == (3, hashlib.sha256(b"\x00\xff\x10").hexdigest(), "r1")
    assert got["b.jpg"] == (1, hashlib.sha256(b"x").hexdigest(), "r1")
    assert len(got) == 2  # Spark makes no row of an empty file
    recorded = rows.withColumn("sha256", F.when(F.col("bytes") == 1, "other").otherwise(F.col("sha256")))
    assert [r["bytes"] for r in gates.changed_hashes(recorded, rows).collect()] == [1]


def test_csv_keeps_quotes_commas_and_dates(spark, tmp_path):
    rows = spark.createDataFrame(
        [('say "hi", now', "2026-01-01", "2026-02-01", "VLM", None)], "task string, start string, finish string, category string, status string"
    ).withColumns({c: F.to_date(c) for c in ("start", "finish")})
    files.write_csv(rows, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), shapes.TASK).first()
    assert back["task"] == 'say "hi", now' and str(back["finish"]) == "2026-02-01" and back["status"] is None


def test_question_only_changes_image_and_variant_only(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(record(7)) + "\n")
    row = records.question_only(files.read_json_lines(spark, str(path), shapes.QA_RECORD), "c.png").first()
    assert row["images"] == ["c.png"] and row["metadata"]["image_variant"] == "constant_training_control"
    assert row["metadata"]["img_id"] == "7" and row["messages"][1]["content"] == "a"


def test_one_image_per_id(spark):
    images = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "img_id string, n int, path string")
    required = spark.createDataFrame([("a",), ("c",), ("a",)], "img_id string")
    assert [tuple(r) for r in records.one_image_per_id(images, required, "img_id", [F.col("n")]).collect()] == [("a", 1, "y")]
    assert [r[0] for r in records.missing_images(images, required, "img_id").collect()] == ["c"]


def test_manifest_of_files_on_storage(spark, tmp_path):
    contents = {"a.bin": b"abc", "deep/b c+%20.bin": b"x" * 5000, "deep/empty.bin": b"", "edge.bin": b"y" * 100, "skip.txt": b"no"}
    for name, data in contents.items():
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    folder = str(tmp_path / "files")
    for large in (100, files.LARGE):  # read piece by piece, and as rows
        found = {r.path.split("/files/")[1]: (r.bytes, r.sha256, r.revision) for r in files.file_manifest(spark, folder, "*.bin", "r1", large).collect()}
        assert found == {n: (len(d), hashlib.sha256(d).hexdigest(), "r1") for n, d in contents.items() if n.endswith(".bin")}
    old = files.file_manifest(spark, folder)
    old = spark.createDataFrame(old.collect(), old.schema)
    (tmp_path / "files" / "a.bin").write_bytes(b"abd")
    (tmp_path / "files" / "edge.bin").unlink()
    (tmp_path / "files" / "fresh.bin").write_bytes(b"")
    state = {r.path.rsplit("/", 1)[1]: r.state for r in gates.compared_hashes(old, files.file_manifest(spark, folder)).collect()}
    assert state == {"a.bin": "changed", "edge.bin": "gone", "fresh.bin": "new", "b c+%20.bin": "same", "empty.bin": "same", "skip.txt": "same"}


def test_named_outputs_stand_beside_their_inputs(spark, tmp_path):
    folder = str(tmp_path / "predictions")
    rows = [(s, c, f"{s}{c}{i}") for s in ("development", "test") for c in ("tuned", "base é") for i in range(40)]
    df = spark.createDataFrame(rows, "split string, condition string, item_id string").repartition(3)
    names = files.write_named(df, folder)
    assert {n.split(".")[0] for n in names} == {f"{s}__{c}" for s in ("development", "test") for c in ("tuned", "base é")}
    assert len(names) > 4 and not [n for n in os.listdir(folder) if n.startswith("_")]  # several tasks wrote parts
    read = lambda derived=None: files.read_predictions(spark, folder, "test", "item_id string, score int", derived)
    scored = read().withColumns({"split": F.lit("test"), "score": F.length("item_id")})
    files.write_named(scored, folder, "scored")
    files.write_named(scored.limit(1), folder, "metrics")
    want = {(c, i) for s, c, i in rows if s == "test"}
    assert {(r.condition, r.item_id) for r in read().collect()} == {(r.condition, r.item_id) for r in read("scored").collect()} == want
    assert read().count() == read("scored").count() == 80 and read("metrics").count() == 1
    assert read("scored").filter("score is null").count() == 0
    assert "_metadata.file_name" in read()._jdf.queryExecution().optimizedPlan().toString() or read().inputFiles()
