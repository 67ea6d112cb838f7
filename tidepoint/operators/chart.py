"""Chart projection: exact deltas around an origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.model import (
    EXACT_KINDS, INT64_MAX, INT64_MIN, MAX_EXACT_DELTA, NUMBER_KINDS, UINT64_MAX,
)

WIDE = "decimal(38,0)"
NUMBER_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def choose_axes(columns: list[tuple[str, str]]) -> tuple[tuple[str, str] | None, tuple[str, str] | None]:
    """X is the first timestamp, else the first number; Y the first other number."""
    x = next((c for c in columns if c[1] == "timestamp_ns"), None) or next(
        (c for c in columns if c[1] in NUMBER_KINDS), None
    )
    y = next(
        (c for c in columns if x and c[0] != x[0] and c[1] in NUMBER_KINDS and c[1] != "timestamp_ns"), None
    )
    return x, y


def _parsed(c: Column, kind: str) -> Column:
    """Decimal text -> number; NULL when the text does not fit the kind."""
    if kind == "uint64":
        n = c.try_cast(WIDE)
        return F.when(c.rlike(r"^(?:0|[1-9][0-9]*)\z") & (n <= F.lit(str(UINT64_MAX)).cast(WIDE)), n)
    if kind in EXACT_KINDS:
        n = c.try_cast(WIDE)
        low, high = F.lit(str(INT64_MIN)).cast(WIDE), F.lit(str(INT64_MAX)).cast(WIDE)
        return F.when(c.rlike(r"^(?:0|-?[1-9][0-9]*)\z") & (n >= low) & (n <= high), n)
    n = F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))
    return F.when(F.abs(n) <= F.lit(1.7976931348623157e308), n)


def _axis(name: str, prefix: str, kind: str, allow_null: bool, allow_approx: bool, letter: str):
    """(aggregates, reason, unsafe, origin) over the statistics row."""
    value, text = F.col(f"_{prefix}"), F.col(f"`{name}`")
    bad = value.isNull() & (text.isNotNull() if allow_null else F.lit(True))
    aggs = [
        F.count_if(bad).alias(f"{prefix}_bad"), F.count(value).alias(f"{prefix}_n"),
        F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"),
    ]
    invalid = (F.col(f"{prefix}_bad") > 0) | (F.col(f"{prefix}_n") == 0)
    if kind in EXACT_KINDS:
        low, high = F.col(f"{prefix}_min").cast(WIDE), F.col(f"{prefix}_max").cast(WIDE)
        origin = (low + F.floor((high - low) / F.lit(2).cast("decimal(1,0)")).cast(WIDE)).cast(WIDE)
        limit = F.lit(MAX_EXACT_DELTA).cast(WIDE)
        unsafe = ((high - origin) > limit) | ((origin - low) > limit)
        reason = F.when(invalid, f"INVALID_{letter}_VALUE")
        if not allow_approx:
            reason = reason.when(unsafe, f"UNSAFE_{letter}_DELTA")
        return aggs, reason, unsafe, origin
    if kind == "numeric_text":
        reason = (
            F.when(invalid, f"INVALID_{letter}_VALUE") if allow_approx else F.lit(f"UNSAFE_{letter}_DELTA")
        )
        return aggs, reason, F.lit(True), F.lit(None).cast(WIDE)
    return aggs, F.when(invalid, f"INVALID_{letter}_VALUE"), F.lit(False), F.lit(None).cast(WIDE)


def chart_verdict(df: DataFrame, columns: list[tuple[str, str]], allow_approx: bool = False) -> DataFrame:
    """One row: status, reason, approximate_available, x_origin, y_origin."""
    x, y = choose_axes(columns)
    if x is None or y is None:
        return df.agg(
            F.lit("blocked").alias("status"), F.lit("NO_NUMERIC_AXES").alias("reason"),
            F.lit(False).alias("approximate_available"),
            F.lit(None).cast(WIDE).alias("x_origin"), F.lit(None).cast(WIDE).alias("y_origin"),
        )
    staged = _staged(df, x, y)
    x_aggs, x_reason, x_unsafe, x_origin = _axis(x[0], "x", x[1], False, allow_approx, "X")
    y_aggs, y_reason, y_unsafe, y_origin = _axis(y[0], "y", y[1], True, allow_approx, "Y")
    stats = staged.agg(F.count(F.lit(1)).alias("_rows"), *x_aggs, *y_aggs)
    reason = F.when(F.col("_rows") == 0, "NO_NUMERIC_AXES").otherwise(F.coalesce(x_reason, y_reason))
    stats = stats.select(
        reason.alias("reason"), (x_unsafe | y_unsafe).alias("_unsafe"),
        x_origin.alias("x_origin"), y_origin.alias("y_origin"),
    )
    return stats.select(
        F.when(F.col("reason").isNotNull(), "blocked").when(F.col("_unsafe"), "approximate")
        .otherwise("exact").alias("status"),
        "reason",
        F.coalesce(F.startswith("reason", F.lit("UNSAFE")), F.lit(False)).alias("approximate_available"),
        F.when(F.col("reason").isNull(), F.col("x_origin")).alias("x_origin"),
        F.when(F.col("reason").isNull(), F.col("y_origin")).alias("y_origin"),
    )


def _staged(df: DataFrame, x, y) -> DataFrame:
    return df.withColumn("_x", _parsed(F.col(f"`{x[0]}`"), x[1])).withColumn("_y", _parsed(F.col(f"`{y[0]}`"), y[1]))


def project_chart(
    df: DataFrame, columns: list[tuple[str, str]], allow_approx: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Chart points (x, y as DOUBLE deltas from the origin) with the status of the whole projection.

    `df` holds the columns as decimal text; `columns` gives (name, kind) in display order.
    The verdict is one row from one aggregation and enters the second pass as a scalar
    subquery. A blocked projection has no points.
    """
    x, y = choose_axes(columns)
    verdict = chart_verdict(df, columns, allow_approx)
    keep = list(keep or [])
    if x is None or y is None:
        return df.select(*keep).where(F.lit(False)).select(
            *keep, F.lit("blocked").alias("status"), F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("y"),
        )
    packed = verdict.select(F.struct("status", "x_origin", "y_origin").alias("v"))
    staged = _staged(df, x, y).withColumn("_v", packed.scalar())

    def delta(prefix, kind):
        value = F.col(f"_{prefix}")
        return (value - F.col(f"_v.{prefix}_origin")).cast("double") if kind in EXACT_KINDS else value

    return staged.where(F.col("_v.status") != "blocked").select(
        *keep, F.col("_v.status").alias("status"), delta("x", x[1]).alias("x"), delta("y", y[1]).alias("y")
    )
