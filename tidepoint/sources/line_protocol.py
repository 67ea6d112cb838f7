"""Line protocol: measurement[,tag=value...] field=value[,...] timestamp_ns.

The grammar is regular, so the whole parser is native expressions. All patterns use
possessive quantifiers: they neither backtrack nor recurse, which keeps them linear
and safe for lines of many megabytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions import numbers, points, text
from tidepoint.model import (
    INVALID_GZIP,
    GZIP_LIMIT_EXCEEDED,
    INVALID_INPUT,
    MAX_GZIP_BYTES,
    MAX_LP_LINE_BYTES,
    POINT_TOO_LARGE,
    RejectedInput,
    TIMESTAMP_REQUIRED,
)
from tidepoint.sources import artifacts, lines

# --- Fixed values: patterns of the grammar --------------------------------------
# Text up to the first space that no backslash protects.
SERIES_PART = r"(?s)^(?:[^\\ ]++|\\.)++(?= )"
# Text up to the first space outside quotes.
FIELDS_PART = r'(?s)^(?:[^\\ "]++|\\.|"(?:[^\\"]++|\\.)*+")++(?= )'
MEASUREMENT = r"(?:[^\\,]++|\\[ ,\\])++"
TAG_KEY = r"(?:[^\\,=]++|\\[ ,=\\])++"
TAG_VALUE = r"(?:[^\\,]++|\\[ ,=\\])++"
TAG = rf",({TAG_KEY})=({TAG_VALUE})"
FIELD_KEY = r'(?:[^\\,="]++|\\[ ,=\\]|"(?:[^\\"]++|\\[ ,=\\])*+")++'
FIELD_VALUE = r'(?:"(?:[^\\"]++|\\.)*+"|[^\\,"]++)'
FIELD = rf"(?s)(?:^|,)({FIELD_KEY})=({FIELD_VALUE})"


def _unescape(c: Column) -> Column:
    return F.when(c.contains("\\"), F.regexp_replace(c, r"\\(.)", "$1")).otherwise(c)


def _kind(value: Column) -> Column:
    """Kind that the spelling of a field value claims; whether it is a good number is seen later."""
    first, last = F.left(value, F.lit(1)), F.right(value, F.lit(1))
    return (
        F.when(first == '"', "string")
        .when(first.isin("t", "T", "f", "F") & F.lower(value).isin("t", "true", "f", "false"), "boolean")
        .when(last == "i", "int64")
        .when(last == "u", "uint64")
        .otherwise("float64")
    )


def _typed(e: Column) -> Column:
    """STRUCT<key, value, kind> of raw texts -> working field."""
    value, kind = e["value"], e["kind"]
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return points.raw_field(
        _unescape(e["key"]),
        kind,
        F.when(kind == "float64", value).when(
            kind.isin("int64", "uint64"), F.substring(value, F.lit(1), F.length(value) - 1)),
        F.when(
            kind == "string",
            F.when(inner.contains("\\"), F.regexp_replace(inner, r'\\([\\"])', "$1")).otherwise(inner),
        ),
        F.when(kind == "boolean", F.lower(F.left(value, F.lit(1))) == "t"),
    )


def parse_line_protocol(df: DataFrame, raw: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """Lines in column `raw` -> point columns plus `code` (NULL for a good point).

    Empty lines and lines that start with '#' give no row.
    """
    keep = list(keep or [])
    line = F.col("_line")
    df = df.select(*keep, F.col(raw).alias("_line"))
    df = points.evaluate_once(df.where((line != "") & ~F.startswith(line, F.lit("#"))))
    usable = (F.octet_length(line) <= MAX_LP_LINE_BYTES) & F.is_valid_utf8(line) & ~text.has_control(line)
    df = df.withColumn("_usable", usable)
    df = df.withColumn("_series", F.when(F.col("_usable"), F.regexp_extract(line, SERIES_PART, 0)))
    df = points.evaluate_once(df)
    rest = F.when(F.col("_series") != "", F.substring(line, F.length("_series") + 2, F.length(line)))
    df = points.evaluate_once(df.withColumn("_rest", rest))
    df = points.evaluate_once(df.withColumn("_fields", F.regexp_extract("_rest", FIELDS_PART, 0)))
    df = df.withColumn(
        "_time",
        F.when(F.col("_fields") != "", F.substring("_rest", F.length("_fields") + 2, F.length("_rest"))),
    )
    df = points.evaluate_once(df.withColumn("_time", numbers.canonical_int64(F.col("_time"))))
    time_text = F.col("_time")
    series, fields = F.col("_series"), F.col("_fields")
    df = points.evaluate_once(df.withColumns({
        "_name": F.regexp_extract(series, "^" + MEASUREMENT, 0),
        "_tag_keys": F.regexp_extract_all(series, F.lit(TAG), F.lit(1)),
        "_tag_values": F.regexp_extract_all(series, F.lit(TAG), F.lit(2)),
        "_field_keys": F.regexp_extract_all(fields, F.lit(FIELD), F.lit(1)),
        "_field_values": F.regexp_extract_all(fields, F.lit(FIELD), F.lit(2)),
    }))

    def total(column):
        return F.aggregate(column, F.lit(0), lambda acc, t: acc + F.length(t))

    # Matches that leave nothing of the text over prove that all of it is well formed.
    series_used = (
        F.length("_name") + total("_tag_keys") + total("_tag_values") + 2 * F.size("_tag_keys")
    )
    fields_used = total("_field_keys") + total("_field_values") + 2 * F.size("_field_keys") - 1
    well_formed = (
        (F.col("_name") != "") & (series_used == F.length(series)) & (fields_used == F.length(fields))
        & time_text.isNotNull()
    )
    code = (
        F.when(F.octet_length(line) > MAX_LP_LINE_BYTES, POINT_TOO_LARGE)
        .when(~F.col("_usable"), INVALID_INPUT)
        .when((series == "") | (fields == ""), TIMESTAMP_REQUIRED)
        .when(~F.coalesce(well_formed, F.lit(False)), INVALID_INPUT)
    )
    df = points.evaluate_once(df.withColumn("code", code))
    good = F.col("code").isNull()
    df = df.select(
        *keep,
        "code",
        _unescape(F.col("_name")).alias("measurement"),
        F.zip_with(
            F.when(good, F.col("_tag_keys")), F.col("_tag_values"),
            lambda k, v: F.struct(_unescape(k).alias("key"), _unescape(v).alias("value")),
        ).alias("tags"),
        F.transform(
            F.zip_with(
                F.when(good, F.col("_field_keys")), F.col("_field_values"),
                lambda k, v: F.struct(k.alias("key"), v.alias("value"), _kind(v).alias("kind")),
            ),
            _typed,
        ).alias("fields"),
        F.when(good, time_text).try_cast("bigint").alias("time_ns"),
    )
    return points.assemble(points.evaluate_once(df), keep)


def split_rejects(parsed: DataFrame, scan: DataFrame, fail_on_reject: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of a parsed table that carries the place of its rows in `scan`, raw and code.

    Points keep their place; only rejects are looked up by line number, and keep their whole text.
    """
    good = parsed.where(F.col("code").isNull()).drop("code", "raw")
    rejects = lines.with_line_numbers(parsed.where(F.col("code").isNotNull()).select(*lines.PLACE, "raw", "code"), scan).select(
        "source_file", "line_no", "raw", "code"
    )
    if fail_on_reject:
        fail_on_first(rejects)
    return good, rejects


def fail_on_first(rejects: DataFrame) -> None:
    first = rejects.orderBy("source_file", "line_no").limit(1).collect()
    if first:
        raise RejectedInput(first[0]["code"], f"{first[0]['source_file']}:{first[0]['line_no']}")


def read_line_protocol(
    spark: SparkSession, path, fail_on_reject: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of line protocol text files."""
    raw = lines.read_lines(spark, path)
    return split_rejects(parse_line_protocol(raw, keep=[*lines.PLACE, "raw"]), raw, fail_on_reject)


def read_line_protocol_gz(
    spark: SparkSession, path, limit: int = MAX_GZIP_BYTES, fail_on_reject: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of gzip files, each of which must be exactly one sound member.

    Files that fail the check give one reject row each and no points. Every file is
    one task: gzip cannot be split.
    """
    limit = min(limit, MAX_GZIP_BYTES)
    verdicts = artifacts.verify_artifacts(spark, path, limit)
    bad = (
        (~F.col("valid")) | (F.col("uncompressed_size") > limit)
    )
    failed = verdicts.where(bad).select(
        F.col("path").alias("source_file"),
        F.lit(None).cast("bigint").alias("line_no"),
        F.lit(None).cast("string").alias("raw"),
        F.when(F.col("uncompressed_size") > limit, GZIP_LIMIT_EXCEEDED).otherwise(INVALID_GZIP).alias("code"),
    )
    sound = [r["path"] for r in verdicts.where(~bad).select("path").toLocalIterator()]
    if fail_on_reject:
        first = failed.orderBy("source_file").limit(1).collect()
        if first:
            raise RejectedInput(first[0]["code"], first[0]["source_file"])
    if not sound:
        raw = spark.createDataFrame([], "source_file string, split_start bigint, row_id bigint, raw string")
        good, rejects = split_rejects(parse_line_protocol(raw, keep=[*lines.PLACE, "raw"]), raw)
    else:
        good, rejects = read_line_protocol(spark, sound, fail_on_reject)
    return good, rejects.unionByName(failed)
