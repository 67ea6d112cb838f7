"""Checks of packages, sources, headers, sizes and plan digests, over files that are written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepoint.catalog.ingest import MAX_BYTES, MAX_POINTS, _indexed_lines
from tidepoint.catalog.registry import (
    DAY, E, EVENT_LINE, FEB_1, JAN_1, JOB, ORACLES, event_points, events, query, shared_dir, table,
)
from tidepoint.functions import points
from tidepoint.functions.work import stored
from tidepoint.operators import batches
from tidepoint.operators.schema import infer_schema
from tidepoint.plans import exports as packages
from tidepoint.plans import slices
from tidepoint.sinks import exports
from tidepoint.sources import artifacts, mapped_csv

SPEC = {"database": "d", "retention_policy": "r", "measurement": "events", "start_ns": JAN_1, "end_ns": FEB_1}
SLICES_SQL = f"""
    WITH s AS (SELECT unnest(generate_series(0, 30)) AS ordinal),
    n AS (SELECT ordinal, count(event_id) AS points FROM s LEFT JOIN {E} e ON (e.time_ns - {JAN_1}) // {DAY} = ordinal AND e.time_ns >= {JAN_1} AND e.time_ns < {FEB_1}
          GROUP BY ordinal)
"""


def _package(spark, sf):
    """(folder, plan, fragments) of the events of January, one slice a day."""
    directory = shared_dir(spark, "package")
    plan = slices.plan_slices(spark, JOB, JAN_1, FEB_1, DAY)
    placed = slices.assign_slices(event_points(spark, sf), JAN_1, FEB_1, DAY)
    return directory, plan, stored(exports.write_canonical_lp(placed, plan, directory), "fragments")


def _manifest(spark, sf, directory, fragments):
    digest = slices.plan_digest("d", "r", "events", JAN_1, FEB_1, DAY)
    exports.write_manifest(spark, fragments, infer_schema(event_points(spark, sf)), SPEC, digest, directory + "/manifest.json")
    return digest


@query("verify_package", SLICES_SQL + """
    SELECT 'data-' || printf('%06d', ordinal) || '.lp.gz' AS file, points,
           CASE ordinal % 4 WHEN 1 THEN 'POINT_COUNT' WHEN 2 THEN 'UNLISTED' WHEN 3 THEN 'DIGEST' END AS problem FROM n
""")
def verify_package(spark, sf):
    """A package against its manifest, in which some slices have another count or digest and some are left out."""
    directory, _, fragments = _package(spark, sf)
    kind = F.col("ordinal") % 4
    told = fragments.where(kind != 2).withColumns({
        "point_count": F.when(kind == 1, F.col("point_count") + 1).otherwise(F.col("point_count")),
        "sha256": F.when(kind == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")),
    })
    _manifest(spark, sf, directory, told)
    found = packages.verify_package(spark, directory)
    return found.join(fragments.select("file", F.col("point_count").alias("points")), "file").select("file", "points", "problem")


@query("verify_manifest", SLICES_SQL + """
    SELECT ordinal AS position, CASE ordinal % 3 WHEN 1 THEN 'range' ELSE 'sha256' END AS problem FROM n WHERE ordinal % 3 > 0
    UNION ALL SELECT NULL, 'retentionPolicy'
""")
def verify_manifest(spark, sf):
    """A manifest against the plan it should describe: some ranges are shifted, some digests are no digests, and the policy is another."""
    directory, plan, fragments = _package(spark, sf)
    kind = F.col("ordinal") % 3
    told = fragments.withColumns({
        "start_ns": F.when(kind == 1, F.col("start_ns") + 1).otherwise(F.col("start_ns")),
        "sha256": F.when(kind == 2, F.upper(F.concat(F.lit("x"), F.substring("sha256", 2, 63)))).otherwise(F.col("sha256")),
    })
    digest = _manifest(spark, sf, directory, told)
    manifest = packages.read_manifest(spark, directory + "/manifest.json")
    return packages.verify_manifest(manifest, plan, {**SPEC, "retention_policy": "other"}, digest)


@query("changed_sources", """
    WITH n AS (SELECT event_type, count(*) AS c, sum(strlen(event_type || ' ' || event_id) + 1) AS bytes FROM events GROUP BY event_type)
    SELECT event_type, bytes AS bytes_before, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN bytes + c ELSE bytes END AS bytes_after,
           event_type IN ('click', 'error') AS changed FROM n
""")
def changed_sources(spark, sf):
    """Files by event type; then one type's files are emptied out of the folder, and another's written anew with longer lines."""
    path = shared_dir(spark, "sources")
    e = table(spark, sf, "events").select("event_type", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"))

    def write(rows):
        rows.repartition("event_type").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type").text(path)

    def now(name):
        return stored(artifacts.source_identity(spark, path), name)

    write(e)
    before = now("before")
    write(e.where("event_type = 'error'").withColumn("value", F.concat("value", F.lit("!"))))
    after = before.where("false").unionByName(now("after").where(~F.col("path").contains("event_type=click/")))
    kind = F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type")
    sizes = [s.groupBy(kind).agg(F.sum("size_bytes").alias(c)) for s, c in ((before, "bytes_before"), (after, "bytes_after"))]
    codes = artifacts.changed_sources(before, after).select(kind, F.lit(True).alias("changed")).distinct()
    return sizes[0].join(sizes[1], "event_type", "left").join(codes, "event_type", "left").select(
        "event_type", "bytes_before", F.coalesce("bytes_after", F.lit(0)).alias("bytes_after"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query("check_csv_headers", """
    SELECT c_custkey, CASE c_nationkey % 6 WHEN 1 THEN 'INVALID_INPUT' WHEN 2 THEN 'CSV_MAPPING_INVALID' WHEN 3 THEN 'CSV_MAPPING_INVALID'
        WHEN 4 THEN 'INVALID_INPUT' WHEN 5 THEN 'CSV_MAPPING_INVALID' END AS code FROM customer
""")
def check_csv_headers(spark, sf):
    """One header for each customer: as the mapping wants it, in another order, doubled, too short, too long, broken, or empty."""
    name, kind = F.col("c_name"), F.col("c_nationkey") % 6
    full = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("time"), F.lit("value"), F.lit("host"))).otherwise(
        F.array(F.lit("host"), F.lit("time"), F.lit("value")))
    header = F.when(kind == 1, F.concat(full, F.array(F.lit("value")))).when(kind == 2, F.array(F.lit("time"), F.lit("value"))).when(
        kind == 3, F.concat(full, F.array(name))).when(kind == 4, F.array(F.lit("time"), F.lit("value"), F.concat(name, F.lit("\nhost")))).when(
        kind == 5, F.array().cast("array<string>")).otherwise(full)
    mapping = mapped_csv.CsvMapping("time", {"value": ("v", "float64")}, {"host": "host"}, static_measurement="m")
    return mapped_csv.check_headers(table(spark, sf, "customer").select("c_custkey", header.alias("header")), mapping).select("c_custkey", "code")


@query("plan_digest", f"""
    WITH r AS (SELECT event_type AS m, min(time_ns) AS lo, max(time_ns) + 1 AS hi FROM {E} GROUP BY event_type),
    t AS (SELECT m, -2 AS i, 'SHOW TAG KEYS FROM "d"."r"."' || m || '"' AS q FROM r
          UNION ALL SELECT m, -1, 'SHOW FIELD KEYS FROM "d"."r"."' || m || '"' FROM r
          UNION ALL SELECT m, i, 'SELECT * FROM "d"."r"."' || m || '" WHERE time >= ' || (lo + i * {DAY}) || ' AND time < ' || least(lo + (i + 1) * {DAY}, hi) || ' GROUP BY *'
          FROM (SELECT *, unnest(generate_series(0, (hi - lo - 1) // {DAY})) AS i FROM r))
    SELECT m AS measurement, sha256(string_agg(strlen(q) || ':' || q, '' ORDER BY i)) AS digest FROM t GROUP BY m
""")
def plan_digest(spark, sf):
    """The digest of each event type's plan of daily slices."""
    bounds = events(spark, sf).groupBy("event_type").agg(F.min("time_ns").alias("lo"), F.max("time_ns").alias("hi")).collect()
    rows = [(r["event_type"], slices.plan_digest("d", "r", r["event_type"], r["lo"], r["hi"] + 1, DAY)) for r in bounds]
    return spark.createDataFrame(rows, "measurement string, digest string")


@query("write_batches", ORACLES["batch_payloads"])
def write_batches(spark, sf):
    """Batches stored for a writer and read back; digests are taken again from the payloads that were read."""
    path = shared_dir(spark, "batches")
    lines = stored(_indexed_lines(spark, sf), "lines")
    exports.write_batches(batches.batch_payloads(lines, batches.plan_batches(lines, MAX_POINTS, MAX_BYTES)), path)
    back = spark.read.parquet(path)
    return back.select("fragment", "batch_start", "start_offset", "end_offset", "points", F.sha2("payload", 256).alias("payload_digest"))


@query("reject_oversize", f"SELECT line AS canonical_lp, CASE WHEN strlen(line) > 64 THEN 'POINT_TOO_LARGE' END AS code FROM (SELECT {EVENT_LINE} AS line FROM {E})")
def reject_oversize(spark, sf):
    """The size rule at a limit that parts the events; ingest applies it at 5 MiB."""
    found = event_points(spark, sf).select("canonical_lp", F.lit(None).cast("string").alias("code"))
    return points.reject_oversize(found, 64)
