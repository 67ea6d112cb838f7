"""Committing one gzip file for each slice, in tasks.

Writing tasks give every file a name of its own attempt and report it in a row with its sizes and digest. The stored table of these
rows decides: of a task that ran twice only the attempt in the table counts. A second job, one row a slice, then moves the files to
their final names. Moving is repeatable: a file that is there already with the planned digest is left alone, any other stops the
commit. The driver handles no names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.functions.work import dealt, stored
from tidepoint.model import RejectedInput
from tidepoint.sinks.files import EMPTY_GZIP
from tidepoint.sources.artifacts import BLOCK, file_system

ATTEMPTS = "ordinal long, attempt string, compressed_size long, uncompressed_size long, sha256 string, line_count long"
_NAMES = [c.split()[0] for c in ATTEMPTS.split(", ")]


class _GzipFile:
    """One gzip member that is written line by line, with its digest and sizes."""

    def __init__(self, folder: str, ordinal: int):
        self.name, self.ordinal = f"{folder}/{ordinal}.{uuid.uuid4().hex}", ordinal
        filesystem, inner = file_system(self.name)
        filesystem.create_dir(file_system(folder)[1], recursive=True)
        self.out = filesystem.open_output_stream(inner, compression=None)
        self.deflate, self.digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
        self.size = self.plain = self.lines = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def write(self, lines: list[str]) -> None:
        data = ("\n".join(lines) + "\n").encode()
        self.plain += len(data)
        self.lines += len(lines)
        self._put(self.deflate.compress(data))

    def close(self) -> tuple:
        self._put(self.deflate.flush())
        self.out.close()
        return self.ordinal, self.name, self.size, self.plain, self.digest.hexdigest(), self.lines


def write_attempts(lines: DataFrame, folder: str) -> DataFrame:
    """ATTEMPTS of `lines` (ordinal, line), whose partitions hold whole slices in order; stored."""
    schema = _arrow(ATTEMPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            ordinals = batch["ordinal"].to_numpy()
            start = 0
            while start < len(ordinals):
                # Slices stand together, so the next one begins where the number first differs.
                same = ordinals[start:] == ordinals[start]
                stop = len(ordinals) if same.all() else start + int(same.argmin())
                if current is None or current.ordinal != ordinals[start]:
                    if current is not None:
                        done.append(current.close())
                    current = _GzipFile(folder, int(ordinals[start]))
                current.write(batch["line"].slice(start, stop - start).to_pylist())
                start = stop
        if current is not None:
            done.append(current.close())
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in done], schema=schema)

    return stored(lines.mapInArrow(run, ATTEMPTS), "attempts")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _digest(filesystem, inner: str) -> str:
    digest = hashlib.sha256()
    with filesystem.open_input_stream(inner, compression=None) as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def _settle(attempt: str | None, target: str, sha256: str | None) -> str:
    from pyarrow import fs

    filesystem, inner = file_system(target)
    wanted = sha256 or hashlib.sha256(EMPTY_GZIP).hexdigest()
    if filesystem.get_file_info(inner).type != fs.FileType.NotFound:
        return "KEPT" if _digest(filesystem, inner) == wanted else "OTHER_CONTENT"
    if attempt is None:
        with filesystem.open_output_stream(inner, compression=None) as out:
            out.write(EMPTY_GZIP)
        return "EMPTY"
    source = file_system(attempt)[1]
    if filesystem.get_file_info(source).type == fs.FileType.NotFound:
        return "ATTEMPT_MISSING"
    filesystem.move(source, inner)
    return "MOVED"


def commit(slices: DataFrame, attempts: DataFrame, directory: str) -> DataFrame:
    """ordinal, file, state of every slice (ordinal, file) after its file has its final name; raises where another file is in the way."""
    root, settled = directory.rstrip("/"), "ordinal long, file string, state string"
    schema = _arrow(settled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"ordinal": r["ordinal"], "file": r["file"], "state": _settle(r["attempt"], f"{root}/{r['file']}", r["sha256"])}
                    for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    planned = slices.select("ordinal", "file").join(attempts.select("ordinal", "attempt", "sha256"), "ordinal", "left")
    done = stored(dealt(planned).mapInArrow(run, settled), "settled")
    bad = done.where(F.col("state").isin("OTHER_CONTENT", "ATTEMPT_MISSING")).orderBy("ordinal").limit(1).collect()
    if bad:
        raise RejectedInput("ARTIFACT_STATE", f"{bad[0]['file']}: {bad[0]['state']}")
    return done
