"""Streaming ingest of point files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.sources import lines
from tidepoint.sources.line_protocol import parse_line_protocol
from tidepoint.sources.typed_jsonl import parse_typed_jsonl


def stream_ingest(
    spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
    source_format: str = "LP", mapping: DataFrame | None = None, max_files: int = 1000,
    trigger: dict | None = None,
):
    """Start a query that turns new files into points and rejects, in one table (see ingested).

    Each micro-batch replaces its own batch_id partitions, so a batch that runs again after
    a restart leaves one copy. Points are never dropped for being late; rejected lines stay whole.
    """
    raw = (
        spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).format("text")
        .load(source_dir)
        .select(F.col("_metadata.file_path").alias("source_file"), lines.strip_cr(F.col("value")).alias("raw"))
    )
    keep = ["source_file", "raw"]

    def store(batch: DataFrame, batch_id: int) -> None:
        if source_format == "LP":
            parsed = parse_line_protocol(batch, keep=keep)
        else:
            parsed = parse_typed_jsonl(batch, keep=keep, mapping=mapping)
        # One table, one pass: a batch replaces its own two partitions, `rejected` false and true.
        rejected = F.col("code").isNotNull()
        _replace(parsed.withColumns({
            "raw": F.when(rejected, F.col("raw")), "batch_id": F.lit(batch_id), "rejected": rejected,
        }), table_dir)

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _replace(df: DataFrame, directory: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "rejected").parquet(directory)


def ingested(spark: SparkSession, table_dir: str) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) that a stream has written so far."""
    rows = spark.read.parquet(table_dir)
    points = rows.where(~F.col("rejected").cast("boolean")).drop("rejected", "code", "raw")
    return points, rows.where(F.col("rejected").cast("boolean")).select("source_file", "raw", "code", "batch_id")
