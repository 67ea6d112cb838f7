"""Standing time-bucket aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.model import NS_PER_SECOND, RejectedInput, duration_ns
from tidepoint.operators.aggregate import AGGREGATES


def continuous_downsample(
    stream: DataFrame, interval: str, aggregates: list[tuple[str, str, str]], tags: list[str] | None = None,
    watermark: str = "1 hour", time: str = "time",
) -> DataFrame:
    """Windowed aggregate of a stream, for append mode: a window comes out once the watermark
    has passed its end; rows later than that miss it. `time` is a timestamp column.
    open_windows gives what is still open, note_late and revised mend what late rows missed.
    """
    stamped = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", watermark)
    return _windows(stamped, interval, aggregates, tags)


def _seconds(interval: str) -> int:
    seconds = duration_ns(interval) // NS_PER_SECOND
    if seconds * NS_PER_SECOND != duration_ns(interval):
        raise ValueError("a streaming window is a whole number of seconds")
    return seconds


def open_windows(
    history: DataFrame, closed: DataFrame, interval: str, aggregates: list[tuple[str, str, str]],
    tags: list[str] | None = None, time: str = "time",
) -> DataFrame:
    """The windows a stream has not closed yet, from the rows behind it: what a last run adds to `closed`.

    A stream closes windows in the order of time, so the open ones are those after the newest closed one.
    """
    newest = closed.agg(F.max("bucket_ns")).first()[0]
    rows = history.withColumn("_time", F.col(time).cast("timestamp"))
    if newest is not None:
        rows = rows.where(F.unix_micros("_time") >= newest // 1000 + _seconds(interval) * 1_000_000)
    return _windows(rows, interval, aggregates, tags)


def note_late(
    stream: DataFrame, path: str, checkpoint_dir: str, interval: str, tags: list[str] | None = None, watermark: str = "1 hour",
    time: str = "time", trigger: dict | None = None,
):
    """Write, batch by batch, the windows (bucket_ns, tags) whose rows may have come too late.

    Runs beside the aggregate over the same source. Its batches may be cut otherwise, so a window counts as missed when it ends
    before the newest time seen so far, this batch included, less the watermark: never fewer windows than the aggregate missed.
    A batch that runs again writes its own folders again.
    """
    width, delay, tags = _seconds(interval) * 1_000_000, duration_ns(_short(watermark)) // 1000, list(tags or [])

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = F.unix_micros(F.col(time).cast("timestamp"))
        batch.agg(F.max(at).alias("top")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        # One row a batch.
        top = spark.read.parquet(f"{path}/marks").where(F.col("batch") <= number).agg(F.max("top")).first()[0]
        start = at - F.pmod(at, F.lit(width))
        late = batch.where(start + width <= F.lit(None if top is None else top - delay).cast("long"))
        late.select((start * 1000).alias("bucket_ns"), *tags).distinct().write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def _short(text: str) -> str:
    """'1 hour' -> '1h'."""
    number, unit = text.split()
    return number + {"second": "s", "minute": "m", "hour": "h", "day": "d"}[unit.rstrip("s")]


def revised(
    closed: DataFrame, history: DataFrame, late: DataFrame, interval: str, aggregates: list[tuple[str, str, str]],
    tags: list[str] | None = None, time: str = "time",
) -> DataFrame:
    """`closed` with the windows named in `late` (bucket_ns, tags) made anew from the rows behind the stream."""
    tags = list(tags or [])
    width = _seconds(interval) * 1_000_000
    keys = ["bucket_ns", *tags]
    missed = late.select(*keys).distinct()
    at = F.unix_micros(F.col(time).cast("timestamp"))
    named = history.withColumn("_bucket", (at - F.pmod(at, F.lit(width))) * 1000)

    def met(rows: DataFrame, bucket: str):
        found = F.col(f"rows.{bucket}") == F.col("missed.bucket_ns")
        for t in tags:
            found = found & F.col(f"rows.{t}").eqNullSafe(F.col(f"missed.{t}"))
        return rows.alias("rows").join(missed.alias("missed"), found, "left_anti" if rows is closed else "left_semi")

    again = met(named, "_bucket").drop("_bucket").withColumn("_time", F.col(time).cast("timestamp"))
    return met(closed, "bucket_ns").unionByName(_windows(again, interval, aggregates, tags))


def _windows(stamped: DataFrame, interval: str, aggregates: list[tuple[str, str, str]], tags: list[str] | None) -> DataFrame:
    if any(fn not in AGGREGATES for fn, _, _ in aggregates):
        raise RejectedInput("AGGREGATE_NOT_ALLOWED")
    seconds = _seconds(interval)
    out = stamped.groupBy(F.window("_time", f"{seconds} seconds").alias("w"), *(tags or [])).agg(
        *[AGGREGATES[fn](F.col(f"`{field}`")).alias(alias) for fn, field, alias in aggregates]
    )
    return out.select(
        (F.unix_micros("w.start") * F.lit(1000)).alias("bucket_ns"),
        *(tags or []), *[a for _, _, a in aggregates],
    )


def write_downsample(df: DataFrame, path: str, checkpoint_dir: str, trigger: dict | None = None):
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint_dir)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )
