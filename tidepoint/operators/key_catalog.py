"""Key sets and sketches of points by measurement and day, kept beside the points; listings read only these.

Rows are (day, what, measurement, name, detail, points, sketch):

- `series`: name is a series key,
- `tag`: name is a tag key, detail a value of it,
- `field`: name is a field key, detail its kind,
- `total`: sketch is an HLL sketch of the series keys,

each with the number of points that hold it on that day. Days are partitions: a listing of a time range
prunes to its days, and `refresh` replaces whole days, so writing a day again changes nothing. Every listing
is a union over days, which merges exact rows by grouping and sketches by their own union.

Tags and fields may be null (none); null and empty values of a tag are no values; a null measurement
is listed nowhere but its days still count as refreshed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions.work import stored
from tidepoint.operators.mutate import day_of

SCHEMA = "what string, measurement string, name string, detail string, points long, sketch binary, day date"
LISTED = {"series": "series", "tag_key": "tag", "tag_value": "tag", "field_key": "field"}


def key_days(points: DataFrame) -> DataFrame:
    """The rows of every day in `points` (measurement, time_ns, tags, fields, series_key).

    Points of one series, day and set of fields meet on the map side, before anything is exploded.
    """
    tags = F.array_sort(F.filter(F.map_entries("tags"), lambda e: e["value"] != ""))
    fields = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"], e["value"]["kind"].alias("value"))))
    series = points.where(F.col("measurement").isNotNull()).groupBy(
        day_of(F.col("time_ns")).alias("day"), "measurement", "series_key", tags.alias("tags"), fields.alias("fields"),
    ).agg(F.count(F.lit(1)).alias("points"))

    def entry(what: str, name: Column, detail: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), name.cast("string").alias("name"), detail.cast("string").alias("detail"))

    none = F.array().cast("array<struct<what:string,name:string,detail:string>>")
    each = F.concat(
        F.array(entry("series", F.col("series_key"), F.lit(None))),
        F.coalesce(F.transform("tags", lambda e: entry("tag", e["key"], e["value"])), none),
        F.coalesce(F.transform("fields", lambda e: entry("field", e["key"], e["value"])), none),
    )
    series = stored(series, "key-series")  # read by both aggregates, which keep sketches out of the many exact groups
    exact = series.select("day", "measurement", "points", F.explode(each).alias("e")).groupBy(
        "e.what", "measurement", "e.name", "e.detail", "day").agg(F.sum("points").alias("points"))
    totals = series.groupBy("day", "measurement").agg(F.sum("points").alias("points"), F.hll_sketch_agg("series_key").alias("sketch"))
    return exact.unionByName(totals.withColumn("what", F.lit("total")), allowMissingColumns=True).select(
        "what", "measurement", "name", "detail", "points", "sketch", "day")


def refresh(points: DataFrame, folder: str, days: DataFrame | None = None) -> None:
    """Replace the days of `points`, which holds all points of these days; `days` (day) names those that may have none left."""
    rows = key_days(points)
    if days is not None:
        # A row of no measurement empties a day whose points are gone.
        rows = rows.unionByName(days.select("day").distinct().select(
            F.lit("none").alias("what"), *[F.lit(None).cast(t).alias(c) for c, t in (
                ("measurement", "string"), ("name", "string"), ("detail", "string"), ("points", "long"), ("sketch", "binary"))], "day"))
    # One measurement's names on one day may be many: the name spreads them.
    rows.repartition("day", F.pmod(F.xxhash64("measurement", "name"), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def key_rows(spark: SparkSession, folder: str, what: str, measurement: str | None = None, since=None, until=None) -> DataFrame:
    """Stored rows of a kind, of the days from `since` to before `until` (dates)."""
    rows = spark.read.schema(SCHEMA).parquet(folder).where(F.col("what") == what)
    for bound, test in ((measurement, F.col("measurement") == measurement), (since, F.col("day") >= F.lit(since)), (until, F.col("day") < F.lit(until))):
        rows = rows if bound is None else rows.where(test)
    return rows


def measurements(spark: SparkSession, folder: str, **limits) -> DataFrame:
    """name, points."""
    return key_rows(spark, folder, "total", **limits).groupBy(F.col("measurement").alias("name")).agg(F.sum("points").alias("points"))


def keys(spark: SparkSession, folder: str, of: str, key: str | None = None, **limits) -> DataFrame:
    """measurement, name (and value or kind), points: every series, tag key, tag value (of `key`, or of all) or field key."""
    rows = key_rows(spark, folder, LISTED[of], **limits)
    detail = {"tag_value": [F.col("detail").alias("value")], "field_key": [F.col("detail").alias("kind")]}.get(of, [])
    if key is not None:
        rows = rows.where(F.col("name") == key)
    return rows.groupBy("measurement", "name", *detail).agg(F.sum("points").alias("points"))


def cardinality(spark: SparkSession, folder: str, of: str, key: str | None = None, approximate: bool = False, **limits) -> DataFrame:
    """measurement, cardinality of series, tag keys, tag values or field keys; series also from the sketches alone."""
    if approximate:
        if of != "series":
            raise ValueError(f"only series have sketches, not {of!r}")
        return key_rows(spark, folder, "total", **limits).groupBy("measurement").agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality"))
    listed = keys(spark, folder, of, key, **limits)
    columns = [c for c in ("measurement", "name", "value") if c in listed.columns]
    return listed.select(*columns).distinct().groupBy("measurement").agg(F.count(F.lit(1)).alias("cardinality"))
