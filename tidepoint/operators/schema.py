"""Schema inference and strict validation of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.functions.joins import bounded_broadcast
from tidepoint.model import SCHEMA_DRIFT, TAG_FIELD_CONFLICT, UNKNOWN_FIELD, UNKNOWN_TAG


def infer_schema(points: DataFrame) -> DataFrame:
    """measurement, name, role, kind, code: tag keys and field kinds found in the data.

    code is SCHEMA_DRIFT for a field of several kinds, TAG_FIELD_CONFLICT for a name used both ways.
    """
    names = points.select(
        "measurement",
        F.array_sort(F.concat(
            F.transform(F.map_keys("tags"), lambda k: F.struct(
                k.alias("name"), F.lit("tag").alias("role"), F.lit("string").alias("kind"))),
            F.transform(F.map_entries("fields"), lambda e: F.struct(
                e["key"].alias("name"), F.lit("field").alias("role"), e["value"]["kind"].alias("kind"))),
        )).alias("names"),
    ).distinct()
    flat = names.select("measurement", F.explode("names").alias("n")).select("measurement", "n.*")
    return flat.groupBy("measurement", "name").agg(
        F.sort_array(F.collect_set("role")).alias("roles"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.sort_array(F.collect_set(F.when(F.col("role") == "field", F.col("kind")))).alias("field_kinds"),
    ).select(
        "measurement", "name",
        F.array_join("roles", "|").alias("role"),
        F.when(F.size("field_kinds") > 0, F.array_join("field_kinds", "|")).otherwise("string").alias("kind"),
        F.when(F.size("roles") > 1, TAG_FIELD_CONFLICT)
        .when(F.size("field_kinds") > 1, SCHEMA_DRIFT).alias("code"),
    )


def folded_schema(schema: DataFrame) -> DataFrame:
    """(measurement, name, role, kind) -> one row per measurement with its tag set and field map."""
    roles = F.split("role", r"\|")  # a name used both ways carries both
    return schema.groupBy("measurement").agg(
        F.collect_set(F.when(F.array_contains(roles, "tag"), F.col("name"))).alias("_tag_names"),
        F.map_from_entries(
            F.collect_list(F.when(F.array_contains(roles, "field"), F.struct("name", "kind")))
        ).alias("_field_kinds"),
    )


def validate_points(points: DataFrame, schema: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Points plus `code` against a schema and a half-open time slice.

    Only the schema moves, folded to one row per measurement; points are checked in place.
    """
    joined = points.join(bounded_broadcast(folded_schema(schema), schema), "measurement", "left")
    tag_names, kinds = F.col("_tag_names"), F.col("_field_kinds")
    live = F.filter(F.map_entries("fields"), lambda e: e["value"].isNotNull() & (e["value"]["kind"] != "null"))
    no_names = F.array().cast("array<string>")
    tag_keys = F.coalesce(F.map_keys("tags"), no_names)
    field_keys = F.coalesce(F.map_keys("fields"), no_names)
    code = (
        F.when(tag_names.isNull(), SCHEMA_DRIFT)
        .when(F.size(F.array_except(tag_keys, tag_names)) > 0, UNKNOWN_TAG)
        .when(F.arrays_overlap(tag_keys, F.map_keys(kinds)), TAG_FIELD_CONFLICT)
        .when(F.arrays_overlap(field_keys, tag_names), TAG_FIELD_CONFLICT)
        .when(F.size(F.array_except(field_keys, F.map_keys(kinds))) > 0, UNKNOWN_FIELD)
        .when((F.size(live) == 0) | F.col("time_ns").isNull(), SCHEMA_DRIFT)
        .when((F.col("time_ns") < start_ns) | (F.col("time_ns") >= end_ns), SCHEMA_DRIFT)
        .when(
            F.exists(live, lambda e: ~e["value"]["kind"].eqNullSafe(F.try_element_at(kinds, e["key"]))),
            SCHEMA_DRIFT,
        )
    )
    return joined.withColumn("code", code).select(*points.columns, "code")


def unknown_keys(points: DataFrame, schema: DataFrame) -> DataFrame:
    """Distinct (measurement, name, role) used by points but absent from the schema."""
    used = infer_schema(points).select(
        "measurement", "name", F.explode(F.split("role", r"\|")).alias("role")
    )
    return used.join(schema.select("measurement", "name", "role"), ["measurement", "name", "role"], "left_anti")


def column_drift(rows: DataFrame) -> DataFrame:
    """Measurements whose series carry different field columns: measurement, shapes, code."""
    shapes = rows.select(
        "measurement", F.sort_array(F.array_remove("columns", "time")).alias("shape")
    ).distinct()
    return shapes.groupBy("measurement").agg(F.count(F.lit(1)).alias("shapes")).withColumn(
        "code", F.when(F.col("shapes") > 1, SCHEMA_DRIFT)
    )
