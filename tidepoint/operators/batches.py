"""Write batches: greedy packing of lines, exact and distributed.

Greedy packing is sequential by nature: a batch starts where the previous one ended. It
becomes parallel by cutting each fragment into blocks of lines. A batch holds at most
max_points lines, so the first batch that starts in a block starts in its first
max_points lines. For each of these entry positions a block can work out, on its own,
where the following block is entered. These small tables compose: blocks into
super-blocks, super-blocks along the fragment. That fixes the real entry of every block,
and then all blocks emit their batches in parallel. Only line lengths take part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.model import MAX_BATCH_BYTES, MAX_BATCH_POINTS, RejectedInput

BLOCK_LINES = 65_536
SUPER_BLOCKS = 256


def _next_start(lengths: np.ndarray, max_points: int, max_bytes: int) -> np.ndarray:
    """For every line: the line after the batch that starts there."""
    n = len(lengths)
    ends = np.concatenate(([0], np.cumsum(lengths + 1)))
    # A payload joins its lines with one LF each, none at the end.
    fit = np.searchsorted(ends, ends[:-1] + max_bytes + 1, side="right") - 1
    own = np.arange(n)
    return np.minimum(n, np.maximum(own + 1, np.minimum(own + max_points, fit)))


def _exits(lengths: np.ndarray, own: int, max_points: int, max_bytes: int) -> np.ndarray:
    """For each entry position: offset in the next block where the walk leaves this one."""
    jump = np.append(_next_start(lengths, max_points, max_bytes), len(lengths))
    places = np.arange(len(jump))
    jump = np.where(places >= own, places, jump)
    while True:  # pointer doubling until every walk has left the block
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    return jump[: min(max_points, own)] - own


def plan_batches(
    lines: DataFrame,
    max_points: int = MAX_BATCH_POINTS,
    max_bytes: int = MAX_BATCH_BYTES,
    text: str = "canonical_lp",
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """fragment, line_index (dense, 0-based), text -> one row per line with its batch:
    fragment, line_index, batch_start, start_offset (of the batch, in bytes with line ends).
    """
    if not (0 < max_points <= MAX_BATCH_POINTS and 0 < max_bytes <= MAX_BATCH_BYTES):
        raise RejectedInput("INVALID_BATCH_LIMITS")
    block_lines = max(block_lines, max_points)
    index, block = F.col("line_index"), F.floor(F.col("line_index") / F.lit(block_lines)).cast("bigint")
    # The head of a block is also shown to the block before it, which may have to look ahead.
    shown = F.when(
        (F.pmod(index, F.lit(block_lines)) < max_points) & (block > 0), F.array(block, block - 1)
    ).otherwise(F.array(block))
    narrow = lines.select(
        "fragment", index.cast("bigint").alias("line_index"),
        F.octet_length(F.col(text)).cast("bigint").alias("len"),
        F.explode(shown).alias("block"),
    )

    def summarise(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_index")
        own = int((pdf["line_index"] < (key[1] + 1) * block_lines).sum())
        lengths = pdf["len"].to_numpy()
        return pd.DataFrame({
            "fragment": [key[0]], "block": [key[1]], "bytes": [int((lengths[:own] + 1).sum())],
            "exits": [_exits(lengths, own, max_points, max_bytes).astype(np.int32)],
        })

    fragment_type = lines.schema["fragment"].dataType.simpleString()
    maps = narrow.groupBy("fragment", "block").applyInPandas(
        summarise, f"fragment {fragment_type}, block bigint, bytes bigint, exits array<int>"
    ).withColumn("super", F.floor(F.col("block") / F.lit(SUPER_BLOCKS)).cast("bigint"))

    def through(entry: np.ndarray, exits: np.ndarray) -> np.ndarray:
        # Entries past a short last block leave it at once.
        inside = entry < len(exits)
        return np.where(inside, exits[np.minimum(entry, len(exits) - 1)], 0)

    def compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        entry = np.arange(max_points)
        for exits in pdf.sort_values("block")["exits"]:
            entry = through(entry, np.asarray(exits))
        return pd.DataFrame({
            "fragment": [key[0]], "super": [key[1]], "bytes": [int(pdf["bytes"].sum())],
            "exits": [entry.astype(np.int32)],
        })

    supers = maps.groupBy("fragment", "super").applyInPandas(
        compose, f"fragment {fragment_type}, super bigint, bytes bigint, exits array<int>"
    )

    def walk(pdf: pd.DataFrame, name: str, entry: int, offset: int) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values(name).itertuples(index=False):
            rows.append((r.fragment, getattr(r, name), entry, offset))
            entry = int(through(np.array([entry]), np.asarray(r.exits))[0])
            offset += int(r.bytes)
        return pd.DataFrame(rows, columns=["fragment", name, "entry", "offset"])

    # One row per SUPER_BLOCKS * block_lines lines of a fragment.
    super_entries = supers.groupBy("fragment").applyInPandas(
        lambda pdf: walk(pdf, "super", 0, 0),
        f"fragment {fragment_type}, super bigint, entry bigint, offset bigint",
    )

    def enter(entries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        return walk(blocks, "block", int(entries["entry"].iloc[0]), int(entries["offset"].iloc[0]))

    entries = super_entries.groupBy("fragment", "super").cogroup(
        maps.groupBy("fragment", "super")
    ).applyInPandas(enter, f"fragment {fragment_type}, block bigint, entry bigint, offset bigint")

    def emit(entry: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_index")
        block_no = int(entry["block"].iloc[0])
        indexes, lengths = pdf["line_index"].to_numpy(), pdf["len"].to_numpy()
        own = int((indexes < (block_no + 1) * block_lines).sum())
        nxt = _next_start(lengths, max_points, max_bytes)
        starts, at = [], int(entry["entry"].iloc[0])
        while at < own:
            starts.append(at)
            at = int(nxt[at])
        starts = np.array(starts, dtype=np.int64)
        if not len(starts):
            return pd.DataFrame({"fragment": [], "line_index": [], "batch_start": [], "start_offset": []})
        ends = nxt[starts]
        offsets = int(entry["offset"].iloc[0]) + np.concatenate(([0], np.cumsum(lengths + 1)))
        member = np.repeat(np.arange(len(starts)), ends - starts)
        return pd.DataFrame({
            "fragment": entry["fragment"].iloc[0],
            "line_index": indexes[starts[0]: ends[-1]],
            "batch_start": indexes[starts][member],
            "start_offset": offsets[starts][member],
        })

    return entries.groupBy("fragment", "block").cogroup(
        narrow.groupBy("fragment", "block")
    ).applyInPandas(
        emit, f"fragment {fragment_type}, line_index bigint, batch_start bigint, start_offset bigint"
    )


def batch_payloads(lines: DataFrame, plan: DataFrame, text: str = "canonical_lp") -> DataFrame:
    """fragment, batch_start, start_offset, end_offset, points, payload, payload_digest.

    One group is one batch, so it holds at most 5000 lines and 5 MiB (or one larger line).
    """
    joined = lines.select("fragment", "line_index", F.col(text).alias("_line")).join(
        plan, ["fragment", "line_index"]
    )
    grouped = joined.groupBy("fragment", "batch_start", "start_offset").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_index", "_line"))), lambda r: r["_line"]), "\n"
        ).alias("payload"),
        F.count(F.lit(1)).alias("points"),
    )
    return _finish(grouped)


def _finish(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "fragment", "batch_start", "start_offset",
        (F.col("start_offset") + F.octet_length("payload") + 1).alias("end_offset"),
        "points", "payload", F.sha2("payload", 256).alias("payload_digest"),
    )


def replay_batches(lines: DataFrame, incidents: DataFrame, text: str = "canonical_lp") -> DataFrame:
    """Rebuild the exact byte range of each incident (fragment, incident_id, start_offset,
    end_offset, payload_digest); code tells when the range cuts a line or the digest differs.

    `lines` carries line_offset, the byte position of each line in its fragment. The range
    join meets on megabyte cells; an incident touches only the few cells of its own range.
    """
    cell = F.lit(1 << 20)
    wanted = incidents.withColumn(
        "_cell",
        F.explode(F.sequence(
            F.floor(F.col("start_offset") / cell).cast("bigint"),
            F.floor((F.col("end_offset") - 1) / cell).cast("bigint"),
        )),
    )
    placed = lines.select(
        "fragment", "line_offset", F.col(text).alias("_line"),
        F.floor(F.col("line_offset") / cell).cast("bigint").alias("_cell"),
    )
    hits = placed.join(wanted, ["fragment", "_cell"]).where(
        (F.col("line_offset") >= F.col("start_offset")) & (F.col("line_offset") < F.col("end_offset"))
    )
    built = hits.groupBy("fragment", "incident_id", "start_offset", "end_offset", "payload_digest").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("line_offset", "_line"))), lambda r: r["_line"]), "\n"
        ).alias("payload"),
        F.count(F.lit(1)).alias("points"), F.min("line_offset").alias("_first"),
    )
    whole = (F.col("_first") == F.col("start_offset")) & (
        F.col("start_offset") + F.octet_length("payload") + 1 == F.col("end_offset")
    )
    return built.select(
        "fragment", "incident_id", "start_offset", "end_offset", "points", "payload",
        F.when(~whole, "IMPORT_OFFSET_CONFLICT")
        .when(F.sha2("payload", 256) != F.lower("payload_digest"), "IMPORT_CHECKPOINT_CONFLICT").alias("code"),
    )


def line_offsets(lines: DataFrame, size: Column, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Add line_offset: bytes (line plus LF) before each line of its fragment."""
    from pyspark.sql import Window

    staged = lines.withColumn("_size", size + 1).withColumn(
        "_block", F.floor(F.col("line_index") / F.lit(block_lines)).cast("bigint")
    )
    sums = staged.groupBy("fragment", "_block").agg(F.sum("_size").alias("_sum"))
    upto = Window.unboundedPreceding
    earlier = Window.partitionBy("fragment").orderBy("_block").rowsBetween(upto, -1)
    bases = sums.select("fragment", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("fragment", "_block").orderBy("line_index").rowsBetween(upto, -1)
    run = staged.withColumn("_run", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return run.join(bases, ["fragment", "_block"]).withColumn(
        "line_offset", F.col("_base") + F.col("_run")
    ).drop("_size", "_block", "_run", "_base")
