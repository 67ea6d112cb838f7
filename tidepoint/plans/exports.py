"""Verified export packages: reading, manifest checks, restart plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.model import RejectedInput
from tidepoint.sinks.exports import MANIFEST_VERSION
from tidepoint.sources import artifacts, line_protocol

ARTIFACT_STATE = "ARTIFACT_STATE"
MANIFEST_SCHEMA = """
    schemaVersion string, exportKind string, database string, retentionPolicy string, measurement string,
    range struct<startNs:string,endNs:string>,
    schema struct<tagKeys:array<string>,fields:array<struct<name:string,kind:string>>>,
    queryDigestSha256 string, checksumAlgorithm string, snapshotConsistent boolean, typePreserving boolean,
    lossy boolean, warnings array<string>,
    fragments array<struct<file:string,startNs:string,endNs:string,compressedSize:string,
        uncompressedSize:string,sha256:string,pointCount:string>>
"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def manifest_fragments(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.posexplode("fragments").alias("position", "f")).select(
        F.col("position").cast("bigint").alias("position"), "f.*"
    )


def verify_manifest(manifest: DataFrame, slices: DataFrame, spec: dict, query_digest: str) -> DataFrame:
    """Differences between a manifest and the plan it should describe: position, problem. Empty = clean."""
    m = F.col
    heads = manifest.select(F.explode(F.array_compact(F.array(
        F.when(~m("schemaVersion").eqNullSafe(MANIFEST_VERSION), "schemaVersion"),
        F.when(~m("exportKind").eqNullSafe("LOGICAL_EXPORT"), "exportKind"),
        F.when(~m("database").eqNullSafe(spec["database"]), "database"),
        F.when(~m("retentionPolicy").eqNullSafe(spec["retention_policy"]), "retentionPolicy"),
        F.when(~m("measurement").eqNullSafe(spec["measurement"]), "measurement"),
        F.when(~m("range.startNs").eqNullSafe(str(spec["start_ns"])), "startNs"),
        F.when(~m("range.endNs").eqNullSafe(str(spec["end_ns"])), "endNs"),
        F.when(~m("queryDigestSha256").eqNullSafe(query_digest), "queryDigestSha256"),
        F.when(~m("checksumAlgorithm").eqNullSafe("SHA-256"), "checksumAlgorithm"),
        F.when(~m("snapshotConsistent").eqNullSafe(False), "snapshotConsistent"),
        F.when(~m("typePreserving").eqNullSafe(True), "typePreserving"),
        F.when(~m("lossy").eqNullSafe(False), "lossy"),
    ))).alias("problem")).select(F.lit(None).cast("bigint").alias("position"), "problem")
    unsigned = r"^(?:0|[1-9][0-9]*)\z"
    s = slices.select(
        F.col("ordinal").alias("position"), F.col("file").alias("p_file"),
        F.col("start_ns").cast("string").alias("p_start"), F.col("end_ns").cast("string").alias("p_end"),
    )
    joined = manifest_fragments(manifest).join(s, "position", "full")
    bodies = joined.select("position", F.explode(F.array_compact(F.array(
        F.when(F.col("p_file").isNull(), "unplanned").when(F.col("file").isNull(), "missing"),
        F.when(F.col("file") != F.col("p_file"), "file"),
        F.when((F.col("startNs") != F.col("p_start")) | (F.col("endNs") != F.col("p_end")), "range"),
        F.when(~F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), "sha256"),
        F.when(~F.col("compressedSize").rlike(unsigned) | ~F.col("uncompressedSize").rlike(unsigned)
               | ~F.coalesce("pointCount", F.lit("0")).rlike(unsigned), "size"),
    ))).alias("problem"))
    return heads.unionByName(bodies)


def verify_package(spark: SparkSession, directory: str) -> DataFrame:
    """Fragment by fragment: manifest entry against the file on disk; problem NULL = sound."""
    root = directory.rstrip("/")
    listed = manifest_fragments(read_manifest(spark, root + "/manifest.json"))
    disk = artifacts.verify_artifacts(spark, root + "/data-*.lp.gz").withColumn(
        "file", F.element_at(F.split("path", "/"), -1)
    )
    joined = listed.join(disk.withColumnRenamed("sha256", "disk_sha256"), "file", "full")
    return joined.select(
        "position", "file", "path",
        F.when(F.col("position").isNull(), "UNLISTED")
        .when(F.col("path").isNull(), "MISSING")
        .when(~F.col("valid"), F.col("problem"))
        .when(F.col("compressedSize") != F.col("compressed_size").cast("string"), "SIZE")
        .when(F.col("uncompressedSize") != F.col("uncompressed_size").cast("string"), "SIZE")
        .when(F.col("sha256") != F.col("disk_sha256"), "DIGEST")
        .when(F.col("pointCount") != F.col("line_count").cast("string"), "POINT_COUNT").alias("problem"),
    )


def read_export_package(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of a package; raises when any fragment differs from the manifest."""
    verdicts = verify_package(spark, directory)
    broken = verdicts.where(F.col("problem").isNotNull()).orderBy("file").limit(1).collect()
    if broken:
        raise RejectedInput(ARTIFACT_STATE, f"{broken[0]['file']}: {broken[0]['problem']}")
    return line_protocol.read_line_protocol(spark, directory.rstrip("/") + "/data-*.lp.gz")


def plan_restart(slices: DataFrame, stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What to do with each slice after an interruption: WRITE, REUSE, REDO or BLOCK.

    `stored` (fragment_id, state, compressed_size, uncompressed_size, sha256) is the fragment
    table, `verdicts` (file, valid, sizes, sha256) what is on disk now. A complete fragment is
    reused only when the disk agrees with it; otherwise it counts as corrupt and is redone.
    """
    f, v = stored.alias("f"), verdicts.alias("v")
    joined = slices.alias("s").join(f, F.col("s.fragment_id") == F.col("f.fragment_id"), "left").join(
        v, F.col("s.file") == F.col("v.file"), "left"
    )
    same = F.coalesce(
        F.col("v.valid")
        & (F.col("f.compressed_size") == F.col("v.compressed_size"))
        & (F.col("f.uncompressed_size") == F.col("v.uncompressed_size"))
        & (F.col("f.sha256") == F.col("v.sha256")),
        F.lit(False),
    )
    state = F.col("f.state")
    return joined.select(
        F.col("s.ordinal").alias("ordinal"), F.col("s.fragment_id").alias("fragment_id"),
        F.col("s.file").alias("file"), state.alias("state"),
        F.when(state.isNull(), "WRITE")
        .when(state == "CORRUPT", "REDO")
        .when((state == "COMPLETE") & same, "REUSE")
        .when(state == "COMPLETE", "REDO")
        .otherwise("BLOCK").alias("action"),
    )
