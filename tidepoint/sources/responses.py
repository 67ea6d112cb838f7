"""Captured query answers: files of consecutive JSON chunk objects."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepoint.functions import identity, numbers, points
from tidepoint.functions.joins import bounded_broadcast
from tidepoint.functions.work import stored
from tidepoint.model import FIELD_TYPE_KIND, MAX_CHUNK_BYTES, SCHEMA_DRIFT
from tidepoint.sources import framing
from tidepoint.sources.artifacts import list_files

# --- Fixed values: codes of a whole answer --------------------------------------
PROTOCOL = framing.NOT_AN_OBJECT
EMPTY_RESPONSE = "FAILED_EMPTY_RESPONSE"
SERVER = "FAILED_SERVER"
INCOMPLETE = "FAILED_INCOMPLETE_RESPONSE"
TOO_LARGE = framing.TOO_LARGE

SERIES_SCHEMA = (
    "code string, statement_id bigint, error string, partial boolean, series_no int, name string, "
    "tags map<string,string>, columns array<string>, cells array<array<struct<t:string,v:string>>>"
)
_NAMES = ["code", "statement_id", "error", "partial", "series_no", "name", "tags", "columns", "cells"]


class _Number(str):
    """Number token exactly as it was written."""


_frames = framing.frames


def _cell(value):
    if value is None:
        return {"t": "null", "v": None}
    if isinstance(value, bool):
        return {"t": "boolean", "v": "true" if value else "false"}
    if isinstance(value, _Number):
        return {"t": "number", "v": str(value)}
    if isinstance(value, str):
        return {"t": "string", "v": value}
    raise ValueError("nested cell")


def _typed(value, kind, default):
    if value is None:
        return default
    if not isinstance(value, kind) or isinstance(value, _Number):
        raise ValueError("wrong member type")
    return value


def _chunk_rows(text: bytes) -> list[dict]:
    """One chunk object -> one row per series (or one row when it has none)."""
    root = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=lambda _: 1 / 0)
    if _typed(root.get("error"), str, ""):
        return [{"code": SERVER, "error": root["error"]}]
    results = _typed(root.get("results"), list, [])
    if len(results) != 1:
        return [{"code": PROTOCOL}]
    result = results[0] or {}
    number = result.get("statement_id")
    if number is None:
        return [{"code": PROTOCOL}]
    if not isinstance(number, _Number):
        raise ValueError("statement_id")
    series = _typed(result.get("series"), list, [])
    error = _typed(result.get("error"), str, "")
    flag = _typed(result.get("partial"), bool, False)
    head = {"statement_id": int(number), "error": error or None}
    if error and (series or flag):
        return [{**head, "code": PROTOCOL}]
    flag = flag or any(_typed(s.get("partial"), bool, False) for s in series)
    head["partial"] = flag
    rows = []
    for position, item in enumerate(series):
        columns = [_typed(c, str, "") for c in _typed(item.get("columns"), list, [])]
        values = _typed(item.get("values"), list, [])
        if not columns or any(len(row or []) != len(columns) for row in values):
            return [{**head, "code": PROTOCOL}]
        tags = {k: _typed(v, str, "") for k, v in _typed(item.get("tags"), dict, {}).items()}
        rows.append({
            **head, "series_no": position, "name": _typed(item.get("name"), str, ""), "tags": tags,
            "columns": columns, "cells": [[_cell(v) for v in row] for row in values],
        })
    return rows or [head]


def _safe_rows(text: bytes) -> list[dict]:
    try:
        return _chunk_rows(text)
    except (ValueError, AttributeError, ArithmeticError, TypeError):
        return [{"code": PROTOCOL}]


def read_chunks(
    spark: SparkSession, path, limit: int = MAX_CHUNK_BYTES, split_bytes: int = framing.SPLIT_BYTES,
) -> DataFrame:
    """One row per series of every chunk; number tokens are kept as written.

    Python tokenises, because Spark's JSON readers rewrite number text. Files are cut in byte ranges, a task's memory
    holds one chunk, and what is parsed is stored, so that rows and verdicts come from one pass.
    """
    files = list_files(spark, path).select("path", "length")
    parsed = framing.read_objects(files.where("length > 0"), _safe_rows, _NAMES, SERIES_SCHEMA, limit, split_bytes)
    chunks = framing.within_first_problem(stored(parsed, "chunks"))
    empty = files.select(F.col("path").alias("source_file")).join(chunks, "source_file", "left_anti").select(
        "source_file", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("chunk_no"), F.lit(EMPTY_RESPONSE).alias("code"))
    return chunks.unionByName(empty, allowMissingColumns=True)


def reconcile_statements(chunks: DataFrame, statement_count: int) -> DataFrame:
    """Verdict per file: source_file, chunk_count, code (NULL when the answer is complete).

    Works on one narrow row per chunk. The neighbour of a chunk is found by joining on
    (file, chunk_no - 1), so a file of many chunks spreads over tasks.
    """
    heads = chunks.groupBy("source_file", "chunk_no").agg(
        F.max("code").alias("code"), F.max("statement_id").alias("id"),
        F.max(F.coalesce("partial", F.lit(False))).alias("partial"),
    )
    before = heads.select(
        "source_file", (F.col("chunk_no") + 1).alias("chunk_no"),
        F.col("id").alias("p_id"), F.col("partial").alias("p_partial"), F.col("code").alias("p_code"),
    )
    joined = heads.join(before, ["source_file", "chunk_no"], "left")
    own = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when((F.col("id") < 0) | (F.col("id") >= statement_count), PROTOCOL)
        .when((F.col("chunk_no") == 0) & (F.col("id") != 0), PROTOCOL)
        .when((F.col("chunk_no") > 0) & ((F.col("id") < F.col("p_id")) | (F.col("id") > F.col("p_id") + 1)), PROTOCOL)
        .when((F.col("id") > F.col("p_id")) & F.col("p_partial"), INCOMPLETE)
        .when((F.col("id") == F.col("p_id")) & ~F.col("p_partial"), PROTOCOL)
    )
    checked = joined.withColumn("own", own)
    per_file = checked.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min_by("own", F.when(F.col("own").isNotNull(), F.col("chunk_no"))).alias("first"),
        F.max_by(F.struct("id", "partial"), "chunk_no").alias("last"),
    )
    return per_file.select(
        "source_file", "chunk_count",
        F.coalesce(
            "first",
            F.when(F.col("last.partial") & (F.col("last.id") == statement_count - 1), INCOMPLETE)
            .when(F.col("last.id") < statement_count - 1,
                  F.when(F.col("last.partial"), INCOMPLETE).otherwise(PROTOCOL)),
        ).alias("code"),
    )


def _running(sizes: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of `group` in chunks before this one: sums inside a range of the file, and over whole ranges."""
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.groupBy(*group, "part").agg(F.sum("_n").alias("_sum")).select(
        *group, "part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(bases, [*group, "part"]).withColumn(
        name, F.col("_base") + F.col("_before")).drop("_base", "_before")


def result_rows(chunks: DataFrame, time_column: str = "time", schema: DataFrame | None = None) -> DataFrame:
    """Flat rows: source_file, statement_id, series_id, row_index, arrival, measurement, tags,
    columns, cells ARRAY<scalar>, code.

    `schema` (measurement, field, kind) types number cells; without an entry a number
    stays numeric_text. Row numbers come from prefix sums over chunks, not over rows.
    """
    blocks = chunks.where(F.col("columns").isNotNull()).withColumn(
        "series_id", identity.series_id(F.col("statement_id"), F.col("name"), F.col("tags"))
    ).withColumn("_n", F.size("cells"))
    order = ["chunk_no", "series_no"]
    sizes = blocks.select("source_file", "part", "series_id", *order, "_n", F.sha2(F.to_json("columns"), 256).alias("_cols"))
    columns = sizes.groupBy("source_file", "series_id").agg(F.min_by("_cols", F.struct(*order)).alias("_first"))
    sizes = _running(sizes, ["source_file"], order, "_arrival").join(columns, ["source_file", "series_id"])
    sizes = _running(sizes, ["source_file", "series_id"], order, "_index").select(
        "source_file", *order, "_arrival", "_index", (F.col("_first") != F.col("_cols")).alias("_changed"))
    blocks = blocks.join(sizes, ["source_file", *order])
    if schema is not None:
        kinds = schema.groupBy(F.col("measurement").alias("_m")).agg(
            F.map_from_entries(F.collect_list(F.struct("field", "kind"))).alias("_kinds")
        )
        kinds = bounded_broadcast(kinds, schema)
        blocks = blocks.join(kinds, blocks["name"] == kinds["_m"], "left").drop("_m")
    else:
        blocks = blocks.withColumn("_kinds", F.lit(None).cast("map<string,string>"))
    rows = blocks.select(
        "source_file", F.col("statement_id").cast("int").alias("statement_id"), "series_id",
        F.col("name").alias("measurement"), "tags", "columns", "_kinds", "_arrival", "_index", "_changed",
        F.posexplode("cells").alias("_pos", "_cells"),
    )
    rows = rows.withColumn(
        "_typed",
        F.zip_with("_cells", "columns", lambda c, name: _type_cell(c, name, time_column)),
    )
    bad = F.col("_changed") | F.exists("_typed", lambda c: c["bad"])
    return rows.select(
        "source_file", "statement_id", "series_id", (F.col("_index") + F.col("_pos")).alias("row_index"),
        (F.col("_arrival") + F.col("_pos")).alias("arrival"), "measurement", "tags", "columns",
        F.transform("_typed", lambda c: c["cell"]).alias("cells"),
        F.when(bad, PROTOCOL).alias("code"),
    )


def _type_cell(cell, name, time_column):
    is_time = name == time_column
    number = cell["t"] == "number"
    kind = F.when(is_time, "timestamp_ns").otherwise(
        F.coalesce(F.try_element_at(F.col("_kinds"), name), F.lit("numeric_text"))
    )
    return typed_cell(cell["t"], cell["v"], kind, is_time, number)


def typed_cell(token, value, kind, is_time, number):
    """STRUCT<cell SCALAR, bad BOOLEAN>: a number token under the kind its column has."""
    decimal = (
        F.when(kind.isin("timestamp_ns", "int64"), numbers.canonical_int64(value))
        .when(kind == "uint64", numbers.canonical_uint64(value))
        .when(kind == "float64", F.when(numbers.finite_double(value).isNotNull(), value))
        .when(kind == "numeric_text", value)
    )
    cell = points.scalar(
        F.when(number, kind).otherwise(token),
        F.when(number, decimal),
        F.when(token == "string", value),
        F.when(token == "boolean", value == "true"),
    )
    bad = F.coalesce((is_time & ~number) | (number & decimal.isNull()), F.lit(True))
    return F.struct(cell.alias("cell"), bad.alias("bad"))


def resolve_numeric_kind(cells: DataFrame, schema: DataFrame) -> DataFrame:
    """Long cells (measurement, column, token) + schema (measurement, field, kind) -> kind, decimal_text, code.

    An unknown column stays numeric_text; a token outside the range of its kind is an error.
    """
    s = schema.select(
        F.col("measurement"), F.col("field").alias("column"), F.col("kind").alias("_kind")
    )
    joined = cells.join(bounded_broadcast(s), ["measurement", "column"], "left")
    kind = F.coalesce("_kind", F.lit("numeric_text"))
    typed = typed_cell(F.lit("number"), F.col("token"), kind, F.lit(False), F.lit(True))
    return joined.withColumn("_t", typed).select(
        *cells.columns,
        kind.alias("kind"),
        F.col("_t.cell.decimal_text").alias("decimal_text"),
        F.when(F.col("_t.bad"), PROTOCOL).alias("code"),
    )


def schema_from_rows(rows: DataFrame) -> DataFrame:
    """Tag-key and field-key answers -> measurement, name, role, kind, code.

    An answer with other columns, unknown types or an empty name is SCHEMA_DRIFT, and so is
    a field reported with two types.
    """
    first = F.col("cells")[0]["string_value"]
    is_tag = F.col("columns") == F.array(F.lit("tagKey"))
    is_field = F.col("columns") == F.array(F.lit("fieldKey"), F.lit("fieldType"))
    type_map = F.create_map(*[F.lit(x) for pair in FIELD_TYPE_KIND.items() for x in pair])
    kind = F.when(is_field, F.try_element_at(type_map, F.get("cells", F.lit(1))["string_value"]))
    flat = rows.select(
        "measurement",
        first.alias("name"),
        F.when(is_tag, "tag").when(is_field, "field").alias("role"),
        kind.alias("kind"),
        (
            ~(is_tag | is_field) | (is_field & kind.isNull()) | (F.size("tags") > 0)
            | first.isNull() | (first == "") | first.rlike(r"[\r\n\x00]") | F.col("code").isNotNull()
        ).alias("bad"),
    )
    return flat.groupBy("measurement", "name", "role").agg(
        F.max("kind").alias("kind"),
        F.when(F.bool_or("bad") | (F.count_distinct("kind") > 1), SCHEMA_DRIFT).alias("code"),
    )


def read_query_responses(
    spark: SparkSession, path, statement_count: int = 1, time_column: str = "time",
    schema: DataFrame | None = None, limit: int = MAX_CHUNK_BYTES, split_bytes: int = framing.SPLIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts). Rows of files with a bad verdict are for inspection only: one bad row or number fails its file."""
    chunks = read_chunks(spark, path, limit, split_bytes)
    rows = result_rows(chunks, time_column, schema)
    bad = rows.where(F.col("code").isNotNull()).groupBy("source_file").agg(F.min("code").alias("_row_code"))
    verdicts = reconcile_statements(chunks, statement_count).join(bad, "source_file", "left")
    return rows, verdicts.withColumn("code", F.coalesce("code", "_row_code")).drop("_row_code")


def read_schema_responses(spark: SparkSession, path, statement_count: int | None = None, **how) -> DataFrame:
    """Schema rows of tag-key and field-key answers; with `statement_count`, what a failed or unfinished answer says is drift."""
    if statement_count is None:
        return schema_from_rows(result_rows(read_chunks(spark, path, **how)))
    rows, verdicts = read_query_responses(spark, path, statement_count, **how)
    judged = verdicts.select("source_file", F.col("code").alias("_answer"))
    rows = rows.join(judged, "source_file", "left")
    return schema_from_rows(rows.withColumn("code", F.coalesce("code", "_answer")).drop("_answer"))
