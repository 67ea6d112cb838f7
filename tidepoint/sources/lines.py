"""Text lines with a stable place: file, split and row; line numbers only for the rows that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A scan reads a split in order inside one task, so row_id (taken right above the scan) grows along the split.
PLACE = ["source_file", "split_start", "row_id"]


def placed(scan: DataFrame, *columns) -> DataFrame:
    """PLACE and `columns` of rows fresh from a file scan."""
    return scan.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"), *columns,
    )


def read_lines(spark: SparkSession, path) -> DataFrame:
    """PLACE and raw: one row per LF line, with one trailing CR stripped. One scan, no join, no shuffle."""
    return placed(spark.read.option("lineSep", "\n").text(path), strip_cr(F.col("value")).alias("raw"))


def with_line_numbers(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """`rows` of a placed `scan` with line_no, 1-based per file.

    Rows are counted per split in a second, narrow scan of the same files; position = rows in earlier splits of
    the file plus distance from the split's first row. Meant for rejects: `rows` meets one row per split.
    """
    splits = scan.groupBy("source_file", "split_start").agg(
        F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = splits.select(
        "source_file", "split_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    return rows.join(splits, ["source_file", "split_start"]).withColumn(
        "line_no", F.col("row_id") - F.col("_first") + F.col("_base") + 1
    ).drop("_first", "_base")


def strip_cr(c):
    return F.when(F.endswith(c, F.lit("\r")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
