"""JSON lines, CSV and binary files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LARGE = 256 << 20  # bytes from which a file is hashed piece by piece
PIECE = 8 << 20


def read_json_lines(spark: SparkSession, path, schema: StructType, glob: str | None = None) -> DataFrame:
    """Typed JSON lines; blank lines vanish and a malformed line fails the job."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    df.write.mode(mode).option("compression", compression).json(path)


_NAME = r"^(.*?)__(.*?)(?:\.[0-9]+)?\.jsonl$"  # <split>__<condition>.jsonl, further parts <split>__<condition>.1.jsonl
DERIVED = ("scored", "metrics")


def _decoded(name: Column) -> Column:
    """A path as it was given; Spark's own columns and listings have it encoded as a URI."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def read_predictions(spark: SparkSession, folder: str, split: str, schema: StructType, derived: str | None = None) -> DataFrame:
    """All ``<split>__<condition>.jsonl`` files but derived ones; the condition comes from the name.

    ``derived`` reads the ``__scored`` or ``__metrics`` files beside them instead. The name decides before a file is opened.
    """
    name = _decoded(F.col("_metadata.file_name"))
    base = F.regexp_extract(name, _NAME, 2)
    found = read_json_lines(spark, folder, schema, glob=f"{split}__*.jsonl")
    if derived is not None:
        return found.filter(base.endswith(f"__{derived}")).withColumn("condition", F.substring_index(base, f"__{derived}", 1))
    kept = found.filter(~name.rlike(rf"__(?:{'|'.join(DERIVED)})(?:\.[0-9]+)?\.jsonl$"))
    return kept.withColumn("condition", base)


def write_named(df: DataFrame, folder: str, derived: str | None = None) -> list[str]:
    """Write ``<split>__<condition>[__<derived>].jsonl`` files for the rows' ``split`` and ``condition``; returns the names.

    Spark writes to a staging folder that readers skip, and its commit decides which files count; they are
    then renamed into place. A condition written by several tasks has numbered parts, so no task gets a condition
    as a whole. Files of the same names are replaced.
    """
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    df.write.partitionBy("split", "condition").json(staging)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts, listing = [], store.listFiles(path(staging), True)
    while listing.hasNext():
        parts.append(listing.next().getPath().toString())
    names, used = [], {}
    for part in sorted(p for p in parts if p.endswith(".json")):
        values = [cell.split("=", 1)[1] for cell in part.split("/")[-3:-1]]
        stem = "__".join([*[jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(v) for v in values], *([derived] if derived else [])])
        used[stem] = used.get(stem, -1) + 1
        name = f"{stem}.{used[stem]}.jsonl" if used[stem] else f"{stem}.jsonl"
        target = path(f"{folder.rstrip('/')}/{name}")
        if store.exists(target):
            store.delete(target, False)
        if not store.rename(path(part), target):
            raise OSError(f"could not rename {part} to {name}")
        names.append(name)
    store.delete(path(staging), True)
    return names


def stored_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of a parquet folder, or None before anything was written."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_by_condition(df: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """One pass writes the outputs of every split and condition under ``<path>/<kind>``."""
    df.write.mode(mode).partitionBy("split", "condition").json(f"{path}/{kind}")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The edited table again, with every column checked against the schema."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as rows. Spark makes no row of an empty file, so the missing-file gate reports it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def manifest(files: DataFrame, revision: str | None = None) -> DataFrame:
    """Length and sha256 of each file; ``files`` has ``path`` and binary or text ``content``."""
    content = F.col("content").cast("binary")
    return files.select(
        "path",
        F.octet_length(content).cast("bigint").alias("bytes"),
        F.sha2(content, 256).alias("sha256"),
        F.lit(revision).cast("string").alias("revision"),
    )


def _folded(large: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sha256 of each path's bytes, read piece by piece."""
    for rows in large:
        digests = []
        for path in rows["path"]:
            local = path.startswith("file:/")
            store, place = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe=":/"))
            digest = hashlib.sha256()
            with store.open_input_stream(place) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": rows["path"], "bytes": rows["bytes"], "sha256": digests})


def file_manifest(spark: SparkSession, folder: str, glob: str = "*", revision: str | None = None, large: int = LARGE) -> DataFrame:
    """Length and sha256 of every file under ``folder``, whatever its size; ``manifest`` for files on storage.

    Spark lists the files, and the paths are the rows: content is read by the tasks only. A file below ``large``
    bytes is one row and hashed by Spark; a larger one, which need not fit a row, is read piece by piece by the
    task that has its path. Empty files, of which Spark makes no row, come from the listing. Folders are
    read as deep as they go.
    """
    reader = lambda: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    found = reader().select("path", F.col("length").alias("bytes"))
    small = reader().filter(F.col("length") < large).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    big = found.filter(F.col("bytes") >= large).repartition("path").mapInPandas(_folded, "path string, bytes long, sha256 string")
    hashed = small.unionByName(big)
    # the listing that the driver made for the scan names empty files too, as encoded URIs
    listed = spark.createDataFrame([(p,) for p in reader().inputFiles()], "uri string")
    named = listed.select(F.regexp_replace(_decoded(F.col("uri")), "^file:/+", "file:/").alias("path"))
    empty = named.join(found, "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("sha256"))
    return hashed.unionByName(empty).withColumn("revision", F.lit(revision).cast("string"))
