"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepoint.catalog.registry import E, HOUR, event_points, query, rounded, shared_dir, table
from tidepoint.streaming import downsample, ingest, task_state


@query(
    "stream_ingest",
    "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type",
)
def stream_ingest(spark, sf):
    root = shared_dir(spark, "ingest")
    event_points(spark, sf).select("canonical_lp").write.text(root + "/in")
    ingest.stream_ingest(spark, root + "/in", root + "/table", root + "/state").awaitTermination()
    p, _ = ingest.ingested(spark, root + "/table")
    return p.groupBy(F.try_element_at("tags", F.lit("event_type")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.try_element_at("fields", F.lit("user_id"))["decimal_text"].cast("bigint")).alias("users"),
    )


@query(
    "continuous_downsample",
    f"""
    SELECT time_ns - time_ns % {HOUR} AS bucket_ns, event_type, round(avg(value), 6) AS mean_value, count(value) AS n
    FROM {E} GROUP BY 1, 2
    """,
)
def continuous_downsample(spark, sf):
    """Events come in four files, each over the whole time, so that most rows of the later ones are late."""
    root = shared_dir(spark, "downsample")
    e = table(spark, sf, "events")
    for part in range(4):
        e.where(F.col("event_id") % 4 == part).write.mode("append").parquet(root + "/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    form = ("1h", [("mean", "value", "mean_value"), ("count", "value", "n")], ["event_type"])
    out = downsample.continuous_downsample(stream, *form, "1 hour", "ts")
    downsample.write_downsample(out, root + "/out", root + "/state").awaitTermination()
    downsample.note_late(stream, root + "/notes", root + "/notes-state", "1h", ["event_type"], "1 hour", "ts").awaitTermination()
    closed, history = spark.read.schema(out.schema).parquet(root + "/out"), spark.read.schema(e.schema).parquet(root + "/in")
    late = spark.read.schema("bucket_ns long, event_type string").parquet(root + "/notes/late")
    whole = downsample.revised(closed, history, late, *form, "ts").unionByName(
        downsample.open_windows(history, closed, *form, "ts").join(late, ["bucket_ns", "event_type"], "left_anti"))
    return rounded(whole, "mean_value")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query(
    "stream_task_state",
    """
    SELECT CAST(conv_id AS VARCHAR) AS log_id, role AS kind, CAST(max(turn) + 1 AS VARCHAR) AS seq, arg_max(length(text), turn) AS size
    FROM conversations GROUP BY conv_id, role
    """,
)
def stream_task_state(spark, sf):
    root = shared_dir(spark, "tasks")
    log = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("log_id"), F.lit(1).alias("schema_version"),
        (F.col("turn") + 1).cast("string").alias("seq"), F.col("role").alias("kind"), F.col("role").alias("resource_id"),
        F.col("turn").cast("string").alias("resource_revision"), F.length("text").cast("string").alias("state"),
    )
    log.write.parquet(root + "/in")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(log.schema).parquet(root + "/in")
        q = (
            task_state.stream_task_state(stream).writeStream.format("parquet").option("path", root + "/out")
            .option("checkpointLocation", root + "/state").outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    out = spark.read.parquet(root + "/out").where(F.col("action") == "APPLY")
    # A micro-batch reports each resource once; several batches report it again.
    newest = out.groupBy("log_id", "kind").agg(F.max_by(F.struct("seq", "state"), F.col("seq").cast("bigint")).alias("m"))
    return newest.select("log_id", "kind", "m.seq", F.col("m.state").cast("bigint").alias("size"))
