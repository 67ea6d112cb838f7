"""Aggregates, time buckets, gap filling, summaries, catalog listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepoint.model import RejectedInput, duration_ns

# Aggregate names -> Spark aggregates.
AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
# Buckets are generated in blocks, so that no single array grows with the time range.
GRID_BLOCK = 4096


def allowed_aggregates(data_type: T.DataType) -> tuple[str, ...]:
    """Numbers allow all five, anything else only count."""
    return tuple(AGGREGATES) if isinstance(data_type, T.NumericType) else ("count",)


def _agg_column(df: DataFrame, fn: str, field: str, alias: str | None) -> Column:
    if fn not in AGGREGATES or fn not in allowed_aggregates(df.schema[field].dataType):
        raise RejectedInput("AGGREGATE_NOT_ALLOWED", f"{fn}({field})")
    return AGGREGATES[fn](F.col(f"`{field}`")).alias(alias or field)


def aggregate(df: DataFrame, fn: str, field: str, by: list[str] | None = None, alias: str | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(_agg_column(df, fn, field, alias))


def aggregate_many(
    df: DataFrame, aggregates: list[tuple[str, str, str]], by: list[str] | None = None
) -> DataFrame:
    """(function, field, alias) list in one pass."""
    return df.groupBy(*(by or [])).agg(*[_agg_column(df, fn, f, a) for fn, f, a in aggregates])


def bucket_ns(width: int, time: str | Column = "time_ns") -> Column:
    """Start of the epoch-aligned bucket, in integer nanoseconds."""
    t = F.col(time) if isinstance(time, str) else time
    return t - F.pmod(t, F.lit(width).cast("bigint"))


def group_by_time(
    df: DataFrame, interval: str | int, aggregates: list[tuple[str, str, str]], tags: list[str] | None = None
) -> DataFrame:
    """One row per (bucket, tags): bucket_ns, tags, aggregates. Map-side partial aggregation
    means a hot tag value costs one partial row per bucket and task."""
    width = duration_ns(interval)
    bucketed = df.withColumn("bucket_ns", bucket_ns(width))
    return aggregate_many(bucketed, aggregates, ["bucket_ns", *(tags or [])])


def fill_null(
    buckets: DataFrame, start_ns: int, end_ns: int, interval: str | int, tags: list[str] | None = None
) -> DataFrame:
    """Add the empty buckets of [start, end) with NULL aggregates (count too).

    A series is a tag set with at least one bucket in the range. Every bucket row emits
    itself and the empty ones up to its successor, so there is no grid to build and join;
    what is sorted per series is at most one row per bucket.
    """
    width, tags = duration_ns(interval), list(tags or [])
    first = start_ns - start_ns % width
    stop = end_ns + (-end_ns) % width  # first bucket start outside the range
    values = [c for c in buckets.columns if c not in ("bucket_ns", *tags)]
    inside = buckets.where((F.col("bucket_ns") >= first) & (F.col("bucket_ns") < stop))
    series = Window.partitionBy(*tags).orderBy("bucket_ns")
    step = F.lit(width).cast("bigint")
    marked = inside.withColumn("_next", F.lead("bucket_ns").over(series)).withColumn(
        "_from",
        F.when(F.lag("bucket_ns").over(series).isNull(), F.lit(first)).otherwise(F.col("bucket_ns")),
    )
    # Last bucket this row is responsible for; a series' first row also covers the lead-in.
    last = F.coalesce("_next", F.lit(stop).cast("bigint")) - step
    block = F.lit(width * GRID_BLOCK).cast("bigint")
    blocks = marked.withColumn("_last", last).withColumn(
        "_block", F.explode(F.sequence(F.col("_from").cast("bigint"), F.col("_last"), block))
    )
    block_end = F.least(F.col("_last"), F.col("_block") + block - step)
    rows = blocks.withColumn("_bucket", F.explode(F.sequence("_block", block_end, step)))
    own = F.col("_bucket") == F.col("bucket_ns")
    return rows.select(
        F.col("_bucket").alias("bucket_ns"),
        *[F.col(f"`{t}`") for t in tags],
        *[F.when(own, F.col(f"`{v}`")).alias(v) for v in values],
    )


def series_summary(rows: DataFrame) -> DataFrame:
    """Rows, columns, measurement and tags per series of result rows."""
    return rows.groupBy("statement_id", "series_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.any_value("measurement").alias("measurement"),
        F.any_value(F.array_sort(F.map_entries("tags"))).alias("tag_entries"),
        F.any_value("columns").alias("columns"),
    ).select(
        "statement_id", "series_id", "row_count", "measurement",
        F.map_from_entries("tag_entries").alias("tags"), "columns",
    )


def statement_summary(statements: DataFrame) -> DataFrame:
    """(statement_id, series_id, complete, has_error) rows -> one row per statement.

    Distinct series are found by a grouping of their own, so one statement with very many
    series does not build one set in one task.
    """
    per_series = statements.groupBy("statement_id", "series_id").agg(
        F.bool_and("complete").alias("complete"), F.bool_or("has_error").alias("has_error")
    )
    return per_series.groupBy("statement_id").agg(
        F.count("series_id").alias("series_count"),
        F.bool_and("complete").alias("complete"),
        F.bool_or("has_error").alias("has_error"),
    )


def column_kinds(rows: DataFrame) -> DataFrame:
    """Display kind per (statement, column): the one kind, 'null', or 'mixed'."""
    cells = rows.select(
        "statement_id", F.explode(F.arrays_zip(F.col("columns"), F.col("cells"))).alias("c")
    ).select(
        "statement_id", F.col("c.columns").alias("column"),
        F.when(F.col("c.cells.kind") != "null", F.col("c.cells.kind")).alias("kind"),
    )
    return cells.groupBy("statement_id", "column").agg(
        F.min("kind").alias("_low"), F.max("kind").alias("_high")
    ).select(
        "statement_id", "column",
        F.when(F.col("_low").isNull(), "null").when(F.col("_low") == F.col("_high"), F.col("_low"))
        .otherwise("mixed").alias("kind"),
    )


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """One row per code ('' for good points): rows and logical bytes (line plus LF)."""
    return parsed.groupBy(F.coalesce("code", F.lit("")).alias("code")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.octet_length("canonical_lp") + 1), F.lit(0)).alias("logical_bytes"),
    )


def require_points(stats: DataFrame) -> None:
    """An import without a single good point is an error."""
    if not stats.where((F.col("code") == "") & (F.col("row_count") > 0)).take(1):
        raise RejectedInput("EMPTY")


def _distinct_count(df: DataFrame, columns: list[str], approximate: bool) -> DataFrame:
    if approximate:
        return df.agg(F.approx_count_distinct(F.struct(*columns)).alias("cardinality"))
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("cardinality"))


def cardinality(points: DataFrame, of: str, key: str | None = None, approximate: bool = False) -> DataFrame:
    """Distinct measurements, series, tag keys, tag values (of `key`) or field keys. Exact by default."""
    if of == "measurement":
        return _distinct_count(points, ["measurement"], approximate)
    if of == "series":
        return _distinct_count(points, ["series_key"], approximate)
    if of == "tag_key":
        return _distinct_count(_key_rows(points, "tags"), ["measurement", "key"], approximate)
    if of == "field_key":
        return _distinct_count(_key_rows(points, "fields"), ["measurement", "key"], approximate)
    if of == "tag_value":
        return _distinct_count(show_tag_values(points, key), ["value"], approximate)
    raise ValueError(of)


def _key_rows(points: DataFrame, column: str) -> DataFrame:
    # The key lists of points repeat; deduplicate the short lists before exploding.
    lists = points.select("measurement", F.array_sort(F.map_keys(column)).alias("keys")).distinct()
    return lists.select("measurement", F.explode("keys").alias("key"))


def _names(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull() & (c != "")).select(c.alias("name")).distinct().orderBy("name")


def show_measurements(points: DataFrame) -> DataFrame:
    return _names(points, "measurement")


def show_databases(points: DataFrame) -> DataFrame:
    return _names(points, "db")


def show_retention_policies(points: DataFrame, db: str) -> DataFrame:
    return _names(points.where(F.col("db") == db), "rp")


def show_series(points: DataFrame) -> DataFrame:
    return _names(points, "series_key")


def show_tag_keys(points: DataFrame, measurement: str | None = None) -> DataFrame:
    df = points.where(F.col("measurement") == measurement) if measurement else points
    return _names(_key_rows(df, "tags"), "key")


def show_tag_values(points: DataFrame, key: str) -> DataFrame:
    value = F.try_element_at("tags", F.lit(key))
    return points.select(value.alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def show_field_keys(points: DataFrame, measurement: str | None = None) -> DataFrame:
    """Field names with their kind."""
    df = points.where(F.col("measurement") == measurement) if measurement else points
    pairs = df.select(
        F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(
            e["key"].alias("name"), e["value"]["kind"].alias("kind")))).alias("pairs")
    ).distinct()
    return pairs.select(F.explode("pairs").alias("p")).select("p.name", "p.kind").distinct().orderBy("name", "kind")
