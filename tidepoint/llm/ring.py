"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `nodes` points of the ring. A key belongs to the first point clockwise of its
own position; when that shard is full, it goes on clockwise to the next point whose shard has
room. Capacities are (1 + slack) times the even share, in rows; with slack 0 (the default) they
are the even share rounded up or down, so that row counts are at most one apart, however the
keys fall. A key moves only when its arc or the room on its way changes.

Keys are numbered in ring order (a distributed sort; equal keys spread over tasks). What is
then known of the arcs, the count of keys on each, is shards x nodes numbers, whatever the
data; the walk for room runs on those and yields runs of consecutive numbers with one shard each.

doc_id decides the position; null is a key like any other. Null text has no bytes (size 8,
CRC 0). Repeated rows stay repeated, each with a slot of its own. Columns other than doc_id
and text are carried by `assign` and ignored by the query.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, numbered, table

SHARDS, NODES = 24, 64


def ring_points(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in ring order."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"shard-{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards) for v in range(nodes)
    )


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-int(-(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[tuple[int, int, int]]:
    """(rows, shard, first slot) in ring order. counts[i] keys lie between points i-1 and i.

    Home first: each shard takes from its own arcs as long as it has room. Then what is left of each
    arc goes on clockwise, arc by arc in ring order.
    """
    room, slots, n = list(room), [0] * len(room), len(points)
    taken: list[list[tuple[int, int]]] = [[] for _ in points]
    left = list(counts)
    for i, (_, shard) in enumerate(points):
        k = min(left[i], room[shard])
        if k:
            taken[i].append((k, shard))
            left[i] -= k
            room[shard] -= k
    for i in range(n):
        step = 1
        while left[i]:
            shard = points[(i + step) % n][1]
            k = min(left[i], room[shard])
            if k:
                taken[i].append((k, shard))
                left[i] -= k
                room[shard] -= k
            step += 1
    runs = []
    for arc in taken:
        for k, shard in arc:
            runs.append((k, shard, slots[shard]))
            slots[shard] += k
    return runs


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """`docs` with shard (int) and slot (long, gapless from 0 in each shard); columns of these names give way to them."""
    points = ring_points(shards, nodes)
    places = [p for p, _ in points]
    columns = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.xxhash64("doc_id").alias("_at"),
        F.xxhash64("text").alias("_tie"),
    )
    placed = numbered(rows, ["_at", "_tie"], "_number", "ring")

    found = {r._arc: r["count"] for r in _arcs(placed, places).groupBy("_arc").count().collect()}
    # Ring order starts behind point 0's wrapped keys: arcs 0..n-1, and n for the keys past the last point.
    n = len(points)
    counts = [found.get(i, 0) for i in range(n + 1)]
    head = counts[0]
    runs = walk(points, [head + counts[n], *counts[1:n]], capacities(sum(counts), shards, slack))
    # Numbers run from the smallest position, so the keys past the last point, part of arc 0, come last.
    starts, owners, slots = _by_number(runs, head, counts[n])
    shared = docs.sparkSession.sparkContext.broadcast((starts, owners, slots))

    @F.pandas_udf("shard int, slot long")
    def place(number: pd.Series) -> pd.DataFrame:
        first, owner, slot = (pd.Series(x) for x in shared.value)
        run = pd.Series(first.searchsorted(number, side="right") - 1)
        return pd.DataFrame({
            "shard": owner.take(run).astype("int32").to_numpy(),
            "slot": (slot.take(run).to_numpy() + number.to_numpy() - first.take(run).to_numpy()),
        })

    done = placed.withColumn("_place", place("_number"))
    return done.select(*[F.col("_row")[c].alias(c) for c in columns if c not in ("shard", "slot")], "_place.shard", "_place.slot")


def _arcs(placed: DataFrame, places: list[int]) -> DataFrame:
    shared = placed.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("int")
    def arc(at: pd.Series) -> pd.Series:
        return pd.Series(pd.Series(shared.value).searchsorted(at, side="left")).astype("int32")

    return placed.select(arc("_at").alias("_arc"))


def _by_number(runs: list[tuple[int, int, int]], head: int, tail: int):
    """Runs as (first number, shard, first slot) in the order of numbers: arc 0's tail moves to the end."""
    total = sum(k for k, _, _ in runs)
    pieces, at = [], 0
    for k, shard, slot in runs:
        # Of arc 0, the first `head` keys are numbered 0.., the other `tail` keys come last.
        if at < head + tail:
            low = min(k, max(0, head - at))
            if low:
                pieces.append((at, shard, slot))
            if k - low and at + low < head + tail:
                pieces.append((total - tail + at + low - head, shard, slot + low))
        else:
            pieces.append((at - tail, shard, slot))
        at += k
    pieces.sort()
    pieces = pieces or [(0, 0, 0)]
    return tuple(list(x) for x in zip(*pieces))


def sized(docs: DataFrame) -> DataFrame:
    held = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "size": F.octet_length(held).cast("long") + 8, "text_crc32": F.crc32(held.cast("binary")).cast("long"),
    })


@query("op7_ring")
def ring(spark, sf):
    docs = sized(fresh(table(spark, sf, "documents"), "doc_id", "text")).drop("text")
    # The text has done its work: what is sorted and stored is narrow.
    return assign(docs.withColumn("text", F.col("text_crc32").cast("string"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
