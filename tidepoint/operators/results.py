"""Result rows: numbering, pages, truncation, sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepoint.functions import points
from tidepoint.operators.result_store import ResultStore, laid_out, store_result, with_numbers
from tidepoint.model import DEFAULT_PAGE, MAX_PAGE, MAX_RESULT_BYTES, MAX_RESULT_ROWS, RejectedInput

ROW_BLOCK = 65_536


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "row_index") -> DataFrame:
    """Dense 0-based position of each row inside its group, in the given order.

    One range sort over group, order and a row salt, written once; positions come from the partitions' counts.
    """
    rows, ranges = laid_out(df, group, order)
    return with_numbers(rows, ranges, group, name)


def page_series(
    rows: DataFrame, statement_id: int, series_id: str, after: int = 0, limit: int = DEFAULT_PAGE
) -> DataFrame:
    """Rows [after, after+limit) of one series by their stored index: a filter, never a scan-wide sort."""
    limit = limit if limit > 0 else DEFAULT_PAGE
    if limit > MAX_PAGE:
        raise RejectedInput("INVALID_PAGE_SIZE")
    index = F.col("row_index")
    return rows.where(
        (F.col("statement_id") == statement_id) & (F.col("series_id") == series_id)
        & (index >= after) & (index < after + limit)
    ).orderBy("row_index")


def page_end(summary: DataFrame, statement_id: int, series_id: str, after: int, limit: int,
             finished: bool = True) -> tuple[int, bool]:
    """(next index, end of result) from the series summary; EOF only for a finished result."""
    row = summary.where(
        (F.col("statement_id") == statement_id) & (F.col("series_id") == series_id)
    ).select("row_count").first()
    total = row["row_count"] if row else 0
    if row is None or after > total:
        raise RejectedInput("RESULT_SERIES_NOT_FOUND")
    end = min(after + limit, total)
    return end, finished and end == total


def row_bytes(cells: Column) -> Column:
    """Logical size of a row: the text bytes of its cells."""
    return F.aggregate(
        cells, F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.coalesce(F.octet_length(points.scalar_text(c)), F.lit(0)),
    )


def truncate_result(
    rows: DataFrame, max_rows: int = MAX_RESULT_ROWS, max_bytes: int = MAX_RESULT_BYTES,
    size: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with row_count, byte_count, truncated).

    Keeps the longest prefix in arrival order within both limits; reaching a limit exactly
    also counts as truncated. `rows` carries a dense 0-based `arrival`, so the row limit is a
    filter and the byte limit two prefix sums: over blocks of rows, then inside a block.
    """
    size = row_bytes(F.col("cells")) if size is None else size
    capped = rows.where(F.col("arrival") < max_rows).withColumn("_size", size)
    capped = capped.withColumn("_block", F.floor(F.col("arrival") / F.lit(ROW_BLOCK)).cast("bigint"))
    blocks = capped.groupBy("_block").agg(F.sum("_size").alias("_sum"))
    # At most max_rows / ROW_BLOCK rows: the block table of an already limited prefix.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    running = capped.withColumn("_run", F.sum("_size").over(inside)).join(bases, "_block").withColumn(
        "_total", F.col("_base") + F.col("_run")
    )
    kept = running.where(F.col("_total") <= max_bytes)
    verdict = kept.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.max("_total"), F.lit(0)).alias("byte_count")
    )
    total = rows.agg(F.count(F.lit(1)).alias("all_rows"))
    verdict = verdict.withColumn("all_rows", total.scalar()).select(
        "row_count", "byte_count",
        (
            (F.col("row_count") < F.col("all_rows"))
            | (F.col("row_count") >= max_rows) | (F.col("byte_count") >= max_bytes)
        ).alias("truncated"),
    )
    return kept.drop("_size", "_block", "_run", "_base", "_total"), verdict


def sort_result(rows: DataFrame, column: str, kind: str, descending: bool = False,
                ties: list[str] | None = None) -> DataFrame:
    """Order by one column: NULL first ascending and last descending.

    Whole numbers and timestamps compare exactly, floats as numbers, the rest as text.
    """
    c = F.col(f"`{column}`")
    if kind in ("int64", "uint64", "timestamp_ns"):
        key = c.try_cast("decimal(20,0)")
    elif kind in ("float64", "numeric_text"):
        key = c.try_cast("double")
    else:
        key = c.cast("string")
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return rows.orderBy(order, *(ties or []))


def store_tabulated(
    wide: DataFrame, measurement: str, tags: tuple[str, ...], fields: dict[str, str], statement_id: int = 0, ties: list[str] | None = None,
) -> ResultStore:
    """A stored result of computed points: one series per tag set, rows in time order.

    The points are stored as they are; cells are made of the rows that are read.
    """
    from tidepoint.functions import identity
    from tidepoint.sources.tables import field_scalar, tag_entries

    def finish(rows: DataFrame) -> DataFrame:
        cells = F.array(
            points.scalar("timestamp_ns", F.col("time_ns").cast("string")),
            *[F.coalesce(field_scalar(n, k), points.null_scalar()) for n, k in fields.items()],
        )
        return rows.select(
            "statement_id", "series_id", "row_index", F.lit(measurement).alias("measurement"), F.map_from_entries(tag_entries(tags)).alias("tags"),
            F.array(*map(F.lit, ["time", *fields])).alias("columns"), cells.alias("cells"),
        )

    order = ["time_ns", *(ties or [])]
    used = dict.fromkeys([*tags, *order, *fields])
    series = identity.series_id(F.lit(statement_id), F.lit(measurement), F.map_from_entries(tag_entries(tags)))
    return store_result(wide.select(F.lit(statement_id).alias("statement_id"), series.alias("series_id"), *used), order, finish)


def tabulate(
    wide: DataFrame, measurement: str, tags: tuple[str, ...], fields: dict[str, str], statement_id: int = 0, ties: list[str] | None = None,
) -> DataFrame:
    """Computed points as result rows: one series per tag set, rows in time order.

    statement_id, series_id, row_index, measurement, tags, columns, cells.
    """
    return store_tabulated(wide, measurement, tags, fields, statement_id, ties).numbered()
