"""Export plans: half-open time slices and the points that fall into them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions import identity
from tidepoint.functions.joins import BROADCAST_ROWS, bounded_broadcast
from tidepoint.model import INT64_MAX, INT64_MIN, MAX_SLICES, RejectedInput

INVALID_PLAN = "INVALID_EXPORT_PLAN"


def check_range(start_ns: int, end_ns: int, width_ns: int | None) -> int:
    """Width in use; raises for an empty or oversized plan."""
    if not (INT64_MIN <= start_ns < end_ns <= INT64_MAX):
        raise RejectedInput(INVALID_PLAN, "range")
    width = end_ns - start_ns if width_ns is None else width_ns
    if width <= 0 or -(-(end_ns - start_ns) // width) > MAX_SLICES:
        raise RejectedInput(INVALID_PLAN, "width")
    return width


def plan_slices(
    spark: SparkSession, job_id: str, start_ns: int, end_ns: int, width_ns: int | None = None
) -> DataFrame:
    """ordinal, quantum_id, fragment_id, start_ns, end_ns, file; the last slice is clipped."""
    try:
        uuid.UUID(job_id)
    except ValueError:
        raise RejectedInput(INVALID_PLAN, "job id") from None
    width = check_range(start_ns, end_ns, width_ns)
    count = -(-(end_ns - start_ns) // width)
    # A width beyond 64 bits only occurs in a one-slice plan, where it is not used.
    step = F.lit(min(width, INT64_MAX)).cast("bigint")
    ordinal = F.col("ordinal")
    start = F.when(ordinal == 0, F.lit(start_ns).cast("bigint")).otherwise(F.lit(start_ns).cast("bigint") + ordinal * step)
    end = F.when(ordinal == count - 1, F.lit(end_ns).cast("bigint")).otherwise(
        F.lit(start_ns).cast("bigint") + (ordinal + 1) * step
    )
    return spark.range(count).withColumnRenamed("id", "ordinal").select(
        "ordinal", *_names(job_id), start.alias("start_ns"), end.alias("end_ns"), _file())


def _number():
    text = F.col("ordinal").cast("string")
    return F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))


def _names(job_id: str) -> list:
    return [F.concat(F.lit("slice/"), _number()).alias("quantum_id"), identity.fragment_id(F.lit(job_id), F.col("ordinal")).alias("fragment_id")]


def _file():
    return F.concat(F.lit("data-"), _number(), F.lit(".lp.gz")).alias("file")


def plan_digest(database: str, retention_policy: str, measurement: str, start_ns: int, end_ns: int,
                width_ns: int | None = None, ranges: list[tuple[int, int]] | None = None) -> str:
    """Digest of the statements a plan stands for: two schema listings and one range per slice (of equal width, or `ranges`)."""
    width = check_range(start_ns, end_ns, width_ns)
    ranges = ranges or [(low, min(low + width, end_ns)) for low in range(start_ns, end_ns, width)]
    quoted = ['"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"' for n in (database, retention_policy, measurement)]
    source = ".".join(quoted)
    texts = [f"SHOW TAG KEYS FROM {source}", f"SHOW FIELD KEYS FROM {source}"]
    for low, high in ranges:
        texts.append(f"SELECT * FROM {source} WHERE time >= {low} AND time < {high} GROUP BY *")
    return identity.text_list_digest(texts)


def assign_slices(points: DataFrame, start_ns: int, end_ns: int, width_ns: int | None = None) -> DataFrame:
    """Points of the range plus slice_ordinal. Equal widths need arithmetic only, no join."""
    from tidepoint.operators.select import time_range

    width = check_range(start_ns, end_ns, width_ns)
    wide = "decimal(20,0)" if end_ns - start_ns > INT64_MAX else "bigint"
    distance = F.col("time_ns").cast(wide) - F.lit(str(start_ns)).cast(wide)
    ordinal = (distance - F.pmod(distance, F.lit(str(width)).cast(wide))) / F.lit(str(width)).cast(wide)
    return time_range(points, start_ns, end_ns).withColumn("slice_ordinal", ordinal.cast("bigint"))


def assign_irregular_slices(points: DataFrame, slices: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As assign_slices for any disjoint slices (ordinal, start_ns, end_ns): the last slice that starts at or before a point, if it has not ended.

    Up to `broadcast_rows` slices are searched in a sorted array, one candidate a point; more meet the points in an as-of join.
    """
    from tidepoint.operators.asof import as_of_join, as_of_sorted, small_enough
    from tidepoint.operators.select import time_range

    bounds = slices.agg(F.min("start_ns"), F.max("end_ns"), F.count(F.lit(1))).first()
    if not bounds[2] or bounds[2] > MAX_SLICES:
        raise RejectedInput(INVALID_PLAN, "slices")
    inside = time_range(points, int(bounds[0]), int(bounds[1]))
    if not small_enough(slices, broadcast_rows):
        ends = slices.select("start_ns", F.col("ordinal").alias("slice_ordinal"), F.col("end_ns").alias("_end"))
        met = as_of_join(inside, ends, "time_ns", "start_ns", ["slice_ordinal", "_end"])
        return met.where(F.col("time_ns") < F.col("_end")).drop("_end")
    listed = sorted(map(tuple, slices.select("start_ns", "end_ns", "ordinal").collect()))
    shared = points.sparkSession.createDataFrame(
        [(i, o, e) for i, (_, e, o) in enumerate(listed)], f"_at int, slice_ordinal {slices.schema['ordinal'].dataType.simpleString()}, _end long")
    found = as_of_sorted(inside, "time_ns", [low for low, _, _ in listed], "_at")
    return found.join(F.broadcast(shared), "_at").where(F.col("time_ns") < F.col("_end")).drop("_at", "_end")


def fit_width(points: DataFrame, start_ns: int, end_ns: int, width_ns: int, max_points: int) -> int:
    """Largest width_ns / 2^k whose fullest slice holds at most max_points points.

    A slice becomes one file written by one task, so this bounds that task. Points that
    share one nanosecond cannot be told apart by time and may still exceed it.
    """
    width = width_ns
    while True:
        sliced = assign_slices(points, start_ns, end_ns, width)
        fullest = sliced.groupBy("slice_ordinal").count().agg(F.max("count")).first()[0] or 0
        half = width // 2
        if fullest <= max_points or half == 0 or -(-(end_ns - start_ns) // half) > MAX_SLICES:
            return width
        width = half


CELLS, QUANTILES, ACCURACY = 1024, 256, 10_000
# Ranks in the sketch are off by n / ACCURACY at most, so a step between two quantiles holds this share of its cell at most.
STEP = 1 / QUANTILES + 2 / ACCURACY


def _segments(points: DataFrame, low: int, high: int, max_points: int) -> list[tuple[int, int, float]]:
    """(start, end, most points) that cover [low, high), each within the bound unless it is one nanosecond.

    One scan: cells of equal width, each with its count and a quantile sketch of its times, which merge in the tasks. A cell with
    more than QUANTILES times the bound is looked at again by itself.
    """
    from tidepoint.operators.select import time_range

    width = -(-(high - low) // CELLS)
    distance = F.col("time_ns").cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")
    cell = F.floor(distance / F.lit(str(width)).cast("decimal(20,0)")).cast("int")
    marks = [i / QUANTILES for i in range(1, QUANTILES)]
    # CELLS rows of QUANTILES numbers, whatever the size of the table.
    sketched = time_range(points, low, high).select(cell.alias("cell"), "time_ns").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("time_ns", marks, ACCURACY).alias("q")).orderBy("cell").collect()
    out, at = [], low
    for r in sketched:
        start, end, n = low + r["cell"] * width, min(low + (r["cell"] + 1) * width, high), r["n"]
        if start > at:
            out.append((at, start, 0.0))
        at = end
        if n <= max_points or end - start == 1:
            out.append((start, end, float(n)))
            continue
        # Points at one nanosecond show as a value that many quantiles share.
        steps, borders = {}, sorted({start, *(x for x in r["q"] if x > start), *(x + 1 for x, k in _counted(r["q"]) if k > 1 and x + 1 < end)})
        for x, k in _counted(r["q"]):
            steps[x] = k
        for a, b in zip(borders, [*borders[1:], end]):
            share = min(float(n), n * STEP * (steps.get(a, 0) + 1))
            if share > max_points and b - a > 1:
                out += _segments(points, a, b, max_points)
            else:
                out.append((a, b, share))
    if at < high:
        out.append((at, high, 0.0))
    return out


def _counted(values: list[int]) -> list[tuple[int, int]]:
    from itertools import groupby

    return [(x, len(list(same))) for x, same in groupby(sorted(values))]


def plan_bounded_slices(
    points: DataFrame, job_id: str, start_ns: int, end_ns: int, max_points: int,
) -> DataFrame:
    """As plan_slices, with slices of about equal depth that hold at most `max_points` points; and share, shares.

    What one nanosecond overfills is split by its series: `shares` slices of the same range, of which each takes the series whose
    hash names it (twice as many as the count asks for, since hashes are not even).
    """
    check_range(start_ns, end_ns, None)
    found, made = _segments(points, start_ns, end_ns, max_points), []
    low, held = start_ns, 0.0
    for a, b, n in found:
        if n > max_points:
            if low < a:
                made.append((low, a, 1))
            made.append((a, b, int(-(-2 * n // max_points))))
            low, held = b, 0.0
        elif held + n > max_points:
            made.append((low, a, 1))
            low, held = a, n
        else:
            held += n
    if low < end_ns:
        made.append((low, end_ns, 1))
    if sum(m for _, _, m in made) > MAX_SLICES:
        raise RejectedInput(INVALID_PLAN, "slices")
    rows = [(low, high, share, shares) for low, high, shares in made for share in range(shares)]
    plan = points.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "ordinal long, start_ns long, end_ns long, share int, shares int")
    return plan.select("ordinal", *_names(job_id), "start_ns", "end_ns", _file(), "share", "shares")


def assign_bounded_slices(points: DataFrame, plan: DataFrame) -> DataFrame:
    """Points plus slice_ordinal under a plan of plan_bounded_slices."""
    first = plan.where("share = 0").select("ordinal", "start_ns", "end_ns")
    met = assign_irregular_slices(points, first)
    split = plan.where("share = 0 and shares > 1").select(F.col("ordinal").alias("slice_ordinal"), "shares")
    met = met.join(bounded_broadcast(split), "slice_ordinal", "left")
    step = F.coalesce(F.pmod(F.xxhash64("series_key"), F.col("shares").cast("long")), F.lit(0))
    return met.withColumn("slice_ordinal", F.col("slice_ordinal") + step).drop("shares")
