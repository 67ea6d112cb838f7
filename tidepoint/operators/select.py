"""Projections, filters, limits."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.model import INT64_MAX, INT64_MIN, NS_PER_DAY, RejectedInput, duration_ns

EPOCH = datetime(1970, 1, 1)
# Import states that can be resumed.
OPEN_STATES = (
    "PREFLIGHTING", "STAGING", "READY", "RUNNING", "PAUSED_SAFE", "PAUSED_RESTAGE",
    "NEEDS_PARTIAL_DECISION", "NEEDS_UNKNOWN_DECISION", "CLEANING",
)


def _ntz(micros: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{(EPOCH + timedelta(microseconds=micros)).isoformat(sep=' ')}'")


def _date(days: int) -> Column:
    return F.expr(f"DATE'{(EPOCH + timedelta(days=days)).date().isoformat()}'")


def _between(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Keep low <= time_ns <= high, with coarse twins on `time` and `day` when present.

    The twins are implied by the exact test, so they change no result; they reach the
    Parquet filters and the partition list, which an expression on time_ns cannot.
    """
    for bound, op in ((low, "__ge__"), (high, "__le__")):
        if bound is None:
            continue
        df = df.where(getattr(F.col("time_ns"), op)(F.lit(bound).cast("bigint")))
        if "time" in df.columns and dict(df.dtypes)["time"] == "timestamp_ntz":
            df = df.where(getattr(F.col("time"), op)(_ntz(bound // 1000)))
        if "day" in df.columns:
            df = df.where(getattr(F.col("day"), op)(_date(bound // NS_PER_DAY)))
    return df


def time_range(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """start <= time < end."""
    if end_ns <= start_ns:
        return df.where(F.lit(False))
    return _between(df, start_ns, end_ns - 1)


def since(df: DataFrame, now_ns: int, duration: str | int, inclusive: bool = False) -> DataFrame:
    """time > now - duration (>= when inclusive). `now_ns` is given, so runs can be repeated."""
    edge = now_ns - duration_ns(duration)
    low = edge if inclusive else edge + 1
    return _between(df, max(min(low, INT64_MAX), INT64_MIN), None)


def tag_equals(df: DataFrame, tag: str | None, value: str | None) -> DataFrame:
    """Equality on a tag; no filter when tag or value is empty."""
    if not tag or not value:
        return df
    return df.where(F.col(f"`{tag}`") == F.lit(value))


def where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def project(df: DataFrame, columns: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Pick columns by name (any character is allowed), renaming through `aliases`."""
    aliases = aliases or {}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(aliases.get(c, c)) for c in columns])


def select_all_by_series(df: DataFrame, series: Column) -> DataFrame:
    """Rows laid out series by series, each in time order.

    Rows are range-partitioned on (series, time), so a series larger than a task's share
    spreads over neighbouring partitions instead of filling one task.
    """
    keyed = df.withColumn("series_key", series)
    return keyed.repartitionByRange("series_key", "time_ns").sortWithinPartitions("series_key", "time_ns")


def select_rows(rows: DataFrame, indexes: list[int]) -> DataFrame:
    """Chosen row indexes of one series. Duplicates, or an index that is not there, are errors."""
    if not indexes or len(set(indexes)) != len(indexes) or min(indexes) < 0:
        raise RejectedInput("INVALID_SELECTION")
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i,) for i in indexes], "row_index bigint")
    chosen = rows.join(wanted, "row_index", "left_semi")
    if chosen.select("row_index").count() != len(indexes):
        raise RejectedInput("INVALID_SELECTION", "row not found")
    return chosen


def search_schema(schema: DataFrame, needle: str) -> DataFrame:
    """Schema rows (db, measurement, fields ARRAY, tags ARRAY) that hold the needle, case-blind.

    `match` says how: the measurement itself, or only the database name.
    """
    needle = needle.strip().lower()
    words = F.lower(F.concat_ws(" ", "measurement", F.array_join("fields", " "), F.array_join("tags", " ")))
    hit = words.contains(needle)
    db_hit = F.lower("db").contains(needle)
    return schema.where(hit | db_hit).withColumn("match", F.when(hit, "measurement").otherwise("database"))


def dedupe_last(points: DataFrame, order: list[str]) -> DataFrame:
    """One point per series and time: the last in `order` (for files: source_file, split_start, row_id).

    Without it both points stay. A map-side maximum, so a point sent very often costs one row per task.
    """
    rest = [c for c in points.columns if c not in ("series_key", "time_ns")]
    last = points.groupBy("series_key", "time_ns").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select("series_key", "time_ns", "_last.*").select(*points.columns)


# Fixed value: longest list of jobs.
MAX_JOBS = 500


def list_recoverable_jobs(jobs: DataFrame, profile_id: str | None = None, limit: int = 100) -> DataFrame:
    """Retained jobs in an open state, newest first."""
    if not 0 < limit <= MAX_JOBS:
        raise ValueError(f"a list holds 1 to {MAX_JOBS} jobs, not {limit}")
    picked = jobs.where(F.col("retained") & F.col("state").isin(*OPEN_STATES))
    if profile_id:
        picked = picked.where(F.col("profile_id") == profile_id)
    return picked.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def limit_offset(df: DataFrame, limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
    """Points in time order (ties by series), skipping `offset`, keeping `limit`."""
    time = F.col("time_ns").desc() if descending else F.col("time_ns").asc()
    ordered = df.orderBy(time, "series_key")
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def series_limit(df: DataFrame, slimit: int, soffset: int = 0) -> DataFrame:
    """Rows of the series numbered soffset+1 .. soffset+slimit in key order.

    The series list is a map-side aggregate and a top-k, so no window over all rows.
    """
    names = df.select("series_key").distinct().orderBy("series_key")
    if soffset:
        names = names.offset(soffset)
    return df.join(names.limit(slimit), "series_key", "left_semi")
