"""Captured replies to writes, one JSON object a line: status, body, contentLength."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepoint.plans.transfers import classify_write_responses

REPLY = "batch_id string, status int, body string, contentLength bigint"


def read_write_responses(spark: SparkSession, path, success: tuple[int, ...] = ()) -> DataFrame:
    """batch_id, status, body, content_length and outcome of every captured reply.

    A reply without a status never arrived; a line that is no such object counts as one. A log that
    knows no batch leaves batch_id NULL.
    """
    rows = spark.read.schema(REPLY).option("mode", "PERMISSIVE").json(path)
    return classify_write_responses(rows.withColumnRenamed("contentLength", "content_length"), success)
