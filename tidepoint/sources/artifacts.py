"""File verdicts: size, digest and soundness of gzip artifacts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions.work import dealt
from tidepoint.model import MAX_GZIP_BYTES

VERDICT_SCHEMA = (
    "path string, compressed_size bigint, uncompressed_size bigint, sha256 string, "
    "line_count bigint, valid boolean, problem string"
)
BLOCK = 4 * 1024 * 1024


def file_system(path: str):
    """(file system, path on it) of a URI; the Hadoop names of S3 mean S3."""
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^//+(?=/)", "", path[5:])
    return fs.FileSystem.from_uri(path)


def open_stream(path: str):
    """Open a file named by URI for streaming, on whatever file system it lives."""
    filesystem, inner = file_system(path)
    return filesystem.open_input_stream(inner, compression=None)


def open_range(path: str, start: int):
    """A stream of the file's bytes from `start` on."""
    if start == 0:
        return open_stream(path)
    filesystem, inner = file_system(path)
    stream = filesystem.open_input_file(inner)
    stream.seek(start)
    return stream


def inspect_gzip(stream, limit: int) -> dict:
    """Read one file once, in blocks: digest, sizes, and whether it is exactly one sound member."""
    digest, size, plain, newlines = hashlib.sha256(), 0, 0, 0
    decoder, problem, last = zlib.decompressobj(31), None, b""
    while block := stream.read(BLOCK):
        digest.update(block)
        size += len(block)
        if problem:
            continue
        if decoder.eof:
            problem = "TRAILING_BYTES"
            continue
        data = block
        try:
            while data:
                out = decoder.decompress(data, BLOCK)
                plain += len(out)
                newlines += out.count(b"\n")
                last = out[-1:] or last
                data = decoder.unconsumed_tail
                if plain > limit:
                    problem = "LIMIT_EXCEEDED"
                    break
        except zlib.error:
            problem = "CORRUPT"
        if not problem and decoder.unused_data:
            problem = "TRAILING_BYTES"
    if not problem and not decoder.eof:
        problem = "CORRUPT"
    return {
        "compressed_size": size,
        "uncompressed_size": plain,
        "sha256": digest.hexdigest(),
        "line_count": newlines + (1 if last not in (b"", b"\n") else 0),
        "valid": problem is None,
        "problem": problem,
    }


def list_files(spark: SparkSession, path) -> DataFrame:
    """path, length, modification_time of every file; contents are not read.

    A scan leaves out files of zero bytes, so those are added from the driver's own listing.
    """
    scan = spark.read.format("binaryFile").load(path)
    found = scan.select("path", "length", F.col("modificationTime").alias("modification_time"))
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in scan.inputFiles()]
    listed = spark.createDataFrame(names, "path string")
    empty = listed.join(found, "path", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modification_time")
    )
    return found.unionByName(empty)


def verify_artifacts(spark: SparkSession, path, limit: int = MAX_GZIP_BYTES) -> DataFrame:
    """One verdict row per gzip file. Each worker streams its files block by block."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["path"]:
                with open_stream(name) as stream:
                    rows.append({"path": name, **inspect_gzip(stream, limit)})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERDICT_SCHEMA.split(", ")])

    files = list_files(spark, path).select("path")
    return dealt(files).mapInPandas(check, VERDICT_SCHEMA)


def source_identity(spark: SparkSession, path) -> DataFrame:
    """path, sha256, size_bytes, modification_time of source files, streamed by the workers."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for name in batch["path"]:
                h, size = hashlib.sha256(), 0
                with open_stream(name) as stream:
                    while block := stream.read(BLOCK):
                        h.update(block)
                        size += len(block)
                sums.append((name, h.hexdigest(), size))
            out = pd.DataFrame(sums, columns=["path", "sha256", "size_bytes"])
            out["length"] = batch["length"].to_numpy()
            out["modification_time"] = batch["modification_time"].to_numpy()
            yield out

    files = dealt(list_files(spark, path))
    return files.mapInPandas(
        digest,
        "path string, sha256 string, size_bytes bigint, length bigint, modification_time timestamp",
    )


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose bytes, size or time differ between two identities, or that came or went."""
    b, a = before.alias("b"), after.alias("a")
    same = (
        F.col("b.sha256").eqNullSafe(F.col("a.sha256"))
        & F.col("b.size_bytes").eqNullSafe(F.col("a.size_bytes"))
        & F.col("b.modification_time").eqNullSafe(F.col("a.modification_time"))
    )
    return b.join(a, F.col("b.path") == F.col("a.path"), "full").where(~same).select(
        F.coalesce("b.path", "a.path").alias("path"),
        F.col("b.sha256").alias("sha256_before"),
        F.col("a.sha256").alias("sha256_after"),
        F.lit("SOURCE_CHANGED").alias("code"),
    )
