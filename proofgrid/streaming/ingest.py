"""Results that arrive as files while a run is going on."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from proofgrid.functions import keys
from proofgrid.operators.intervene import RANDOM_MAP
from proofgrid.sources import shapes


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """JSON-lines results as they come, with ``arrived``, the time their file was written."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def result_stream(
    spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000, wait: str | None = None
) -> DataFrame:
    """JSON-lines results, each intervention once; ids seen so far are streaming state.

    State is kept per item: its ids, twelve bytes each. An item's rows travel packed, and a batch stores them side by
    side, so effects are nearly reduced where they are read. An id that does not follow from its row
    (``keys.intervention_id``) is looked up among all such ids, whatever the item.

    With ``wait`` (such as ``"2 hours"``) an id leaves the state that long after its file was written, as the newest
    file tells the time, so the state holds one period's ids. A repeat that comes later is then stored again;
    ``intervene.level_effects`` would refuse it, ``effect_stream`` reports it as expired.
    """
    rows = arrivals(spark, folder, schema, files_per_trigger)
    if wait is not None:
        return rows.withWatermark("arrived", wait).dropDuplicatesWithinWatermark(["intervention_id"]).drop("arrived")
    rows = rows.drop("arrived")
    kinds = {f.name: _KINDS.get(type(f.dataType)) for f in schema}
    if None in kinds.values() or any(f not in schema.fields for f in shapes.INTERVENTION if f.name in (_ID, *_NAMED)):
        return rows.dropDuplicates([_ID])
    packed = rows.withColumn("_owner", _owner()).mapInArrow(partial(_packed, kinds), f"_owner string, {_PACKED}")
    grouped = packed.groupBy("_owner")
    new = grouped.applyInPandasWithState(
        partial(_first_seen, kinds), f"{_PACKED}, _new binary", "ids binary", "append", GroupStateTimeout.NoTimeout
    )
    return new.mapInArrow(partial(_unpacked, kinds), rows.schema)


_ID = "intervention_id"
_NAMED = ("item_id", "method", "intervention", "treatment", "fraction", "mode", "repeat")  # what an id is made of
_KINDS = {StringType: pa.string(), DoubleType: pa.float64(), IntegerType: pa.int32(), LongType: pa.int64()}
_PACKED = "_rows binary, _bytes long"
_OF_ITEM, _OTHER = "i", "o"
_OTHERS = 1 << 16  # groups of ids that do not follow from their rows
_AT_ONCE = 10_000  # rows


def _owner() -> Column:
    """The item if the row's id is made of it, else a group of ids; a bar in a text would leave open where the item ends."""
    texts = [F.col(c) for c in _NAMED if c not in ("fraction", "repeat")]
    made = F.col(_ID) == keys.intervention_id(*[F.col(c) for c in _NAMED])
    of_item = made & ~F.concat_ws("", *texts).contains("|")
    other = F.pmod(F.xxhash64(_ID), F.lit(_OTHERS)).cast("string")
    return F.when(of_item, F.concat(F.lit(_OF_ITEM), keys.joined(F.col("item_id")))).otherwise(F.concat(F.lit(_OTHER), other))


def _wide(kinds: dict[str, pa.DataType]) -> pa.Schema:
    """One row for many: a list per column; texts are one after another, with a list of their lengths."""
    listed = {c: pa.list_(pa.int32() if kind == pa.string() else kind) for c, kind in kinds.items()}
    return pa.schema([*listed.items(), *((f"{c}_text", pa.binary()) for c, kind in kinds.items() if kind == pa.string())])


def _packed(kinds: dict[str, pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per owner of a batch, with all of its rows compressed."""
    schema, codec = _wide(kinds), pa.Codec("zstd")
    for batch in batches:
        owners = batch.column("_owner").cast(pa.string()).dictionary_encode()
        codes = owners.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        cuts = np.append(starts, len(order)).astype(np.int32)
        rows, cells = batch.take(pa.array(order)), {}
        for c, kind in kinds.items():
            column = rows.column(c).cast(kind)
            if kind == pa.string():  # by lengths, as offsets grow from row to row and hardly shrink
                places = np.frombuffer(column.buffers()[1], np.int32)[column.offset + cuts]
                texts = [None, pa.py_buffer(places), column.buffers()[2]]
                cells[f"{c}_text"] = pa.BinaryArray.from_buffers(pa.binary(), len(starts), texts)
                column = pc.binary_length(column)
            cells[c] = pa.ListArray.from_arrays(pa.array(cuts), column)
        wide = pa.RecordBatch.from_arrays([cells[c] for c in schema.names], schema=schema)
        parts = [wide.slice(i, 1).serialize() for i in range(len(starts))]
        packed = [pa.array([codec.compress(p, asbytes=True) for p in parts], pa.binary()), pa.array([p.size for p in parts], pa.int64())]
        yield pa.RecordBatch.from_arrays([owners.dictionary.take(pa.array(codes[order[starts]])), *packed], ["_owner", "_rows", "_bytes"])


def _read(packed: bytes | pa.Buffer, size: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.Codec("zstd").decompress(packed, size), schema)


def _ids(rows: pa.RecordBatch) -> list[str | None]:
    lengths, text, start, out = rows.column(_ID)[0].as_py(), rows.column(f"{_ID}_text")[0].as_py(), 0, []
    for n in lengths:
        out.append(None if n is None else text[start : start + n].decode())
        start += n or 0
    return out


def _first_seen(kinds: dict[str, pa.DataType], key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An owner's packed rows with a flag for each row, whether its id is new; packed rows without a new one are left out."""
    schema, width, of_item = _wide(kinds), keys.INTERVENTION_ID_HEX // 2, key[0].startswith(_OF_ITEM)
    cut = lambda ids: [ids[i : i + width] for i in range(0, len(ids), width)]
    known = bytes(state.get[0]) if state.exists else b""
    seen, fresh = set(cut(known) if of_item else json.loads(known or b"[]")), []
    for frame in frames:
        out = []
        for packed, size in zip(frame["_rows"], frame["_bytes"]):
            rows = _read(packed, size, schema)
            ids = cut(bytes.fromhex(rows.column(f"{_ID}_text")[0].as_py().decode())) if of_item else _ids(rows)
            before, new = len(fresh), bytearray(len(ids))
            for i, one in enumerate(ids):
                if one not in seen:
                    seen.add(one)
                    fresh.append(one)
                    new[i] = 1
            if len(fresh) > before:
                out.append((packed, size, bytes(new)))
        if out:
            yield pd.DataFrame(out, columns=["_rows", "_bytes", "_new"])
    if fresh:
        state.update((known + b"".join(fresh) if of_item else json.dumps(list(seen)).encode(),))


def _unpacked(kinds: dict[str, pa.DataType], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are new, some thousands at a time."""
    schema = _wide(kinds)
    for batch in batches:
        parts, flags = [], bytearray()
        for packed, size, new in zip(batch.column("_rows"), batch.column("_bytes"), batch.column("_new")):
            parts.append(_read(packed.as_buffer(), size.as_py(), schema))
            flags += new.as_py()
            if len(flags) >= _AT_ONCE:
                yield _rows(kinds, parts, flags)
                parts, flags = [], bytearray()
        if parts:
            yield _rows(kinds, parts, flags)


def _rows(kinds: dict[str, pa.DataType], parts: list[pa.RecordBatch], flags: bytearray) -> pa.RecordBatch:
    """The flagged rows of packed ones."""
    wide, columns = pa.Table.from_batches(parts).combine_chunks().to_batches()[0], []
    for c, kind in kinds.items():
        column = wide.column(c).flatten()
        if kind == pa.string():
            known, ends = column.is_valid(), np.cumsum(column.fill_null(0).to_numpy(), dtype=np.int32)
            text = b"".join(x.as_buffer() for x in wide.column(f"{c}_text"))
            column = pa.StringArray.from_buffers(len(column), pa.py_buffer(np.insert(ends, 0, 0)), pa.py_buffer(text))
            column = pc.if_else(known, column, None)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, list(kinds)).filter(pa.array(np.frombuffer(flags, bool)))


_LEVEL = "method string, treatment string, fraction double"
EFFECT = (
    f"item_id string, source_img_id string, {_LEVEL}, state string, targeted_fixed_answer_mean_logprob double, "
    "random_fixed_answer_mean_logprob double, targeted_deletion_effect double"
)


def effect_stream(results: DataFrame, random_repeats: int, wait: str) -> DataFrame:
    """Level effects of ``arrivals``, each handed on when its last result comes.

    State is kept per item: for an open level the ids and scores that came (one targeted and ``random_repeats`` random
    ones at most), for a finished one its name. A repeated id of an open level and any result of a finished one
    are left out. So nothing is stored twice and no stored result is read again.

    An item's state goes when nothing of it came for ``wait``, as the newest file tells the time. Levels that are open
    then are handed on with the state ``expired`` and no effect; finished ones have ``complete``. A repeat after that
    opens its level anew and expires; only the repeat of a whole level would give its effect again. Files
    older than the newest by more than ``wait`` are left out.
    """
    kept = results.withWatermark("arrived", wait).filter(
        (F.col("intervention") == "deletion") & (F.col("method") != RANDOM_MAP) & F.col("mode").isin("targeted", "random")
    )
    quiet = int(pd.Timedelta(wait).total_seconds() * 1000)

    def row(key: tuple, level: str, scores: dict | None) -> tuple:
        method, treatment, fraction = json.loads(level)
        if scores is None:
            return (*key, method, treatment, fraction, "expired", None, None, None)
        targeted = [x for mode, x in scores.values() if mode == "targeted"][0]
        random = math.fsum(x for mode, x in scores.values() if mode == "random") / random_repeats
        return (*key, method, treatment, fraction, "complete", targeted, random, random - targeted)

    def reduce(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_levels, done = json.loads(state.get[0]) if state.exists else ({}, [])
        out = []
        if state.hasTimedOut:
            out = [row(key, level, None) for level in open_levels]
            state.remove()
        else:
            finished, newest = set(done), state.getCurrentWatermarkMs() + 1
            for frame in frames:
                newest = max(newest, int(frame["arrived"].max().timestamp() * 1000) + quiet)
                cells = ("method", "treatment", "fraction", "intervention_id", "mode", "fixed_answer_mean_logprob")
                for method, treatment, fraction, one, mode, score in zip(*[frame[c].tolist() for c in cells]):
                    level = json.dumps([method, treatment, fraction])
                    if level in finished:
                        continue
                    scores = open_levels.setdefault(level, {})
                    scores.setdefault(one, (mode, score))
                    modes = [m for m, _ in scores.values()]
                    if modes.count("targeted") > 1 or modes.count("random") > random_repeats:
                        raise ValueError(f"an effect needs exactly one targeted and {random_repeats} random scores: {key} {level}")
                    if len(modes) == 1 + random_repeats:
                        out.append(row(key, level, open_levels.pop(level)))
                        finished.add(level)
            state.update((json.dumps((open_levels, sorted(finished))),))
            state.setTimeoutTimestamp(newest)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EFFECT.split(", ")])

    keyed = kept.groupBy("item_id", "source_img_id")
    return keyed.applyInPandasWithState(reduce, EFFECT, "levels string", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(results: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append to ``store`` until the source is drained.

    A batch overwrites its own folder, so a batch that is run again after a failure
    leaves no row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/batch={batch_id}")

    writer = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stored_results(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).drop("batch")
