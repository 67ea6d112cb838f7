"""Cutting files of consecutive JSON objects in many tasks at once.

A file is dealt out in byte ranges. Whether a byte stands inside a string, and how deep in brackets, depends on all
bytes before it, so each range is first read for every state it may be entered in (outside strings, inside one, right
behind a backslash in one) and gives, for each, the state at its end and the change of depth. Composed along the file,
one small row a range, these name the true state at each border. Then every task cuts the objects that begin in its range and
reads on past the range's end for the last of them; no object is gathered from several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.functions.work import dealt, stored
from tidepoint.sources.artifacts import open_range

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
NOT_AN_OBJECT, TOO_LARGE = "FAILED_PROTOCOL", "FAILED_RESPONSE_TOO_LARGE"
SPACES = b" \t\r\n"
RANGES = "source_file string, part long, start long, size long, length long"

_QUOTE, _BACKSLASH = 1, 2
_kind = np.zeros(256, np.int8)
_kind[ord('"')], _kind[ord("\\")] = _QUOTE, _BACKSLASH
_step = np.zeros(256, np.int64)
_step[[ord("{"), ord("[")]], _step[[ord("}"), ord("]")]] = 1, -1
_special = (_kind > 0) | (_step != 0)


def scan(block: np.ndarray, state: int, special: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, steps, state behind it) of the brackets outside strings of a block that is entered in `state`."""
    at = np.flatnonzero(_special[block]) if special is None else special
    if state == ESCAPED and len(block):
        at, state = at[at > 0], INSIDE
    if not len(at):
        return at, at, state
    byte = block[at]
    back = _kind[byte] == _BACKSLASH
    if back.any():
        # A byte is escaped behind an odd run of backslashes.
        run = np.where(back, np.concatenate([[True], ~back[:-1] | (np.diff(at) > 1)]), True)
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        odd = back & ((np.arange(len(at)) - first) % 2 == 0)
        escaped = np.concatenate([[False], odd[:-1] & (np.diff(at) == 1)]) & ~back
        hanging = bool(odd[-1]) and at[-1] == len(block) - 1
    else:
        escaped, hanging = np.zeros(len(at), bool), False
    quote = (_kind[byte] == _QUOTE) & ~escaped
    inside = (np.cumsum(quote) - quote + state) % 2 == 1
    if back.any() and not inside[back].all():
        return _scan_slowly(block, at, state)
    brackets = (_step[byte] != 0) & ~inside
    end = int((quote.sum() + state) % 2)
    return at[brackets], _step[byte][brackets], ESCAPED if hanging else end


def _scan_slowly(block: np.ndarray, at: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """As `scan`, byte by byte, where a backslash stands outside strings and so escapes nothing."""
    found, skip = [], -1
    for p in at.tolist():
        kind = _kind[block[p]]
        if p == skip:
            continue
        if kind == _QUOTE:
            state = INSIDE - state
        elif kind == _BACKSLASH:
            skip = p + 1 if state == INSIDE else -1
        elif state == OUTSIDE:
            found.append(p)
    places = np.array(found, np.int64)
    return places, _step[block[places]], ESCAPED if skip == len(block) else state


def frames(stream, limit: int, span: int | None = None, state: int = OUTSIDE, depth: int = 0) -> Iterator[tuple[bytes | None, str | None]]:
    """(text, problem) of each top-level object that begins in the first `span` bytes; ends at the first problem.

    `state` and `depth` are those in front of the stream; an object that began before it is passed over.
    """
    passing, text, base = state != OUTSIDE or depth != 0, bytearray(), 0
    while block := stream.read(BLOCK):
        at, steps, state = scan(np.frombuffer(block, np.uint8), state)
        level = depth + np.cumsum(steps)
        i = 0
        for end in [*(at[(level == 0) & (steps < 0)] + 1).tolist(), None]:
            if passing:
                if end is None:
                    break
                i, passing = end, False
                continue
            if not text:
                i = len(block) - len(block[i:].lstrip(SPACES))
                if i == len(block) or span is not None and base + i >= span:
                    break
                if block[i] != 0x7B:
                    yield None, NOT_AN_OBJECT
                    return
            stop = len(block) if end is None else end
            if len(text) + stop - i > limit:
                yield None, TOO_LARGE
                return
            text += block[i:stop]
            if end is not None:
                yield bytes(text), None
                text.clear()
                i = end
        base += len(block)
        depth = int(level[-1]) if len(level) else depth
        if not text and span is not None and base >= span:
            return
    if text:
        yield None, NOT_AN_OBJECT


def ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RANGES of a table of path, length; ranges are dealt out one by one, whatever their file."""
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("length") - 1) / split_bytes), F.lit(0))))
    cut = files.select(F.col("path").alias("source_file"), "length", part.alias("part")).withColumn("start", F.col("part") * split_bytes)
    cut = cut.select("source_file", "part", "start", F.least(F.lit(split_bytes), F.col("length") - F.col("start")).alias("size"), "length")
    return dealt(cut, F.col("size") / SPLIT_BYTES)


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, start, size in zip(batch["source_file"], batch["start"], batch["size"]):
            states, depths, left = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0], int(size)
            with open_range(name, int(start)) as stream:
                while left and (raw := stream.read(min(BLOCK, left))):
                    left -= len(raw)
                    block = np.frombuffer(raw, np.uint8)
                    special = np.flatnonzero(_special[block])
                    seen = {}
                    for k, state in enumerate(states):
                        if state not in seen:
                            _, steps, after = scan(block, state, special)
                            seen[state] = int(steps.sum()), after
                        depths[k] += seen[state][0]
                        states[k] = seen[state][1]
            rows.append((states, depths))
        yield batch.assign(states=[r[0] for r in rows], depths=[r[1] for r in rows])


def _compose(parts: pd.DataFrame) -> pd.DataFrame:
    """The state and depth in front of each range of one file: one row for SPLIT_BYTES of it."""
    parts = parts.sort_values("part")
    state, depth, entries = OUTSIDE, 0, []
    for states, depths in zip(parts["states"], parts["depths"]):
        entries.append((state, depth))
        state, depth = int(states[state]), depth + int(depths[state])
    return parts.drop(columns=["states", "depths"]).assign(state=[e[0] for e in entries], depth=[e[1] for e in entries])


def entered(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The ranges of the files with the state and depth each is entered in. A file of one range is not read for it."""
    cut = ranges(files, split_bytes)
    one = cut.where(F.col("length") <= split_bytes).select("*", F.lit(OUTSIDE).alias("state"), F.lit(0).cast("long").alias("depth"))
    many = cut.where(F.col("length") > split_bytes).mapInPandas(_exits, RANGES + ", states array<int>, depths array<long>")
    return one.unionByName(many.groupBy("source_file").applyInPandas(_compose, RANGES + ", state int, depth long"))


def read_objects(
    files: DataFrame, parse: Callable[[bytes], list[dict]], names: list[str], schema: str, limit: int, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """source_file, part, place and the rows that `parse` makes of each object (or `code` of a problem), as they stand in the files.

    `place` counts the objects that begin in a range. Nothing follows the first problem of a file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                with open_range(r["source_file"], r["start"]) as stream:
                    found = frames(stream, limit, r["size"], r["state"], r["depth"])
                    for place, (text, problem) in enumerate(found):
                        rows = parse(text) if problem is None else [{"code": problem}]
                        head = {"source_file": r["source_file"], "part": r["part"], "place": place, "ends": problem is not None}
                        held += [{**empty, **head, **row} for row in rows]
                        weight += len(text or b"")
                        if weight >= BLOCK:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"source_file string, part long, place long, ends boolean, {schema}"
    arrow, empty = to_arrow_schema(StructType.fromDDL(full)), dict.fromkeys(names)
    return dealt(stored(entered(files, split_bytes), "ranges"), F.col("size") / SPLIT_BYTES).mapInArrow(run, full)


def within_first_problem(objects: DataFrame) -> DataFrame:
    """Rows of `read_objects`, stored, up to the first problem of each file, with the running number `chunk_no` in it.

    Tasks behind a problem have cut what nobody would read. Numbers come from one row for each range.
    """
    from pyspark.sql import Window

    per_part = objects.groupBy("source_file", "part").agg((F.max("place") + 1).alias("_n"), F.bool_or("ends").alias("_ends"))
    before = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select(
        "source_file", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.bool_or("_ends").over(before), F.lit(False)).alias("_behind"))
    return objects.join(bases, ["source_file", "part"]).where(~F.col("_behind")).withColumn(
        "chunk_no", F.col("_base") + F.col("place")).drop("_base", "_behind", "place", "ends")
