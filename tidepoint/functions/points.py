"""Building canonical points out of typed parts, all in native expressions.

The working shape of a row under construction:
    measurement STRING, tags ARRAY<STRUCT<key, value>>,
    fields ARRAY<STRUCT<key, kind, text, string_value, bool_value>>, time_ns BIGINT,
    code STRING (first problem found so far, or NULL)
`text` holds the number text as it was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.functions import numbers, text
from tidepoint.model import INVALID_INPUT, MAX_POINT_BYTES, POINT_TOO_LARGE


def evaluate_once(df: DataFrame) -> DataFrame:
    """Fence: the columns so far are computed once per row and reused above.

    The optimiser rewrites a chain of projections by pasting each column into all its uses;
    for staged text parsing that multiplies both planning time and work. A generator is a
    border it does not paste across.
    """
    row = F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.select(row.alias("_row")).select("_row.*")


def scalar(kind, decimal_text=None, string_value=None, bool_value=None) -> Column:
    """One scalar struct; kind may be a str or a Column."""
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        (F.lit(None).cast("string") if decimal_text is None else decimal_text).alias("decimal_text"),
        (F.lit(None).cast("string") if string_value is None else string_value).alias("string_value"),
        (F.lit(None).cast("boolean") if bool_value is None else bool_value).alias("bool_value"),
    )


def raw_field(key, kind, text_=None, string_value=None, bool_value=None) -> Column:
    """One member of the working `fields` array."""
    return F.struct(
        key.alias("key"),
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        (F.lit(None).cast("string") if text_ is None else text_).alias("text"),
        (F.lit(None).cast("string") if string_value is None else string_value).alias("string_value"),
        (F.lit(None).cast("boolean") if bool_value is None else bool_value).alias("bool_value"),
    )


def null_scalar() -> Column:
    return scalar("null")


def lp_value(value: Column) -> Column:
    """Scalar struct -> field value text; NULL when the kind cannot be written."""
    kind = value["kind"]
    return (
        F.when(kind == "string", text.quote_string(value["string_value"]))
        .when(kind == "boolean", value["bool_value"].cast("string"))
        .when(kind == "int64", F.concat(value["decimal_text"], F.lit("i")))
        .when(kind == "uint64", F.concat(value["decimal_text"], F.lit("u")))
        .when(kind == "float64", value["decimal_text"])
    )


def scalar_text(value: Column) -> Column:
    """Scalar struct -> exact display text; NULL for a null scalar."""
    kind = value["kind"]
    return (
        F.when(kind == "string", value["string_value"])
        .when(kind == "boolean", value["bool_value"].cast("string"))
        .when(kind != "null", value["decimal_text"])
    )


def series_key(measurement: Column, sorted_tags: Column) -> Column:
    """Escaped measurement and tags: the part of a line before the first free space."""
    parts = F.transform(
        sorted_tags,
        lambda t: F.concat(
            F.lit(","), text.escape_token(t["key"]), F.lit("="), text.escape_token(t["value"])
        ),
    )
    return F.concat(text.escape_measurement(measurement), F.array_join(parts, ""))


def field_set(sorted_fields: Column) -> Column:
    """Sorted ARRAY<STRUCT<key, value SCALAR>> -> 'k=v,k=v'."""
    return F.array_join(
        F.transform(
            sorted_fields,
            lambda f: F.concat(text.escape_token(f["key"]), F.lit("="), lp_value(f["value"])),
        ),
        ",",
    )


def _with_numbers(df: DataFrame) -> DataFrame:
    """Replace the working `fields` by ARRAY<STRUCT<key, value SCALAR, slow DOUBLE>>.

    Floats of at most 15 digits are settled by a pattern test; only the others are
    handed to the Arrow stage that knows the shortest text of a double.
    """

    def settle(e):
        f, easy = e["f"], e["easy"]
        kind = f["kind"]
        decimal = (
            F.when(kind == "int64", numbers.canonical_int64(f["text"]))
            .when(kind == "uint64", numbers.canonical_uint64(f["text"]))
            .when((kind == "float64") & easy, f["text"])
        )
        slow = F.when((kind == "float64") & ~easy, numbers.finite_double(f["text"]))
        return F.struct(
            f["key"].alias("key"),
            scalar(kind, decimal, f["string_value"], f["bool_value"]).alias("value"),
            slow.alias("slow"),
        )

    tested = F.transform("fields", lambda f: F.struct(
        f.alias("f"), ((f["kind"] == "float64") & f["text"].rlike(numbers.PLAIN_FLOAT)).alias("easy")))
    staged = evaluate_once(df.withColumn("fields", F.transform(tested, settle)))
    slow = numbers.shortest_each(F.transform("fields", lambda f: f["slow"]))
    staged = evaluate_once(staged.withColumn("_slow", slow))

    def merge(f, s):
        v = f["value"]
        return F.struct(
            f["key"].alias("key"),
            scalar(
                v["kind"], F.coalesce(v["decimal_text"], F.nullif(s, F.lit(""))), v["string_value"], v["bool_value"]
            ).alias("value"),
        )

    merged = F.zip_with("fields", F.coalesce("_slow", F.array().cast("array<string>")), merge)
    return evaluate_once(staged.withColumn("fields", merged).drop("_slow"))


def reject_oversize(df: DataFrame, limit: int = MAX_POINT_BYTES) -> DataFrame:
    """`df` with POINT_TOO_LARGE as `code` where there is none yet and the canonical line has more than `limit` bytes."""
    too_large = F.octet_length("canonical_lp") > limit
    return df.withColumn("code", F.coalesce("code", F.when(too_large, F.lit(POINT_TOO_LARGE))))


def assemble(df: DataFrame, keep: list[str]) -> DataFrame:
    """Working rows -> points with a `code`; `keep` names columns carried along."""
    df = _with_numbers(df)
    number = F.exists(
        "fields",
        lambda f: f["value"]["kind"].isin("int64", "uint64", "float64")
        & f["value"]["decimal_text"].isNull(),
    )
    tag_keys = F.transform("tags", lambda t: t["key"])
    field_keys = F.transform("fields", lambda f: f["key"])
    problem = F.coalesce(
        number
        | (F.size(F.array_distinct(tag_keys)) < F.size("tags"))
        | (F.size(F.array_distinct(field_keys)) < F.size("fields"))
        | (F.size("fields") == 0)
        | F.arrays_overlap(tag_keys, field_keys),
        F.lit(True),
    )
    df = evaluate_once(df.withColumn("code", F.coalesce("code", F.when(problem, F.lit(INVALID_INPUT)))))
    good = F.col("code").isNull()
    # Keys are unique here, so the struct order is the byte order of the keys.
    df = df.withColumn("tags", F.when(good, F.sort_array("tags"))).withColumn(
        "fields", F.when(good, F.sort_array("fields"))
    )
    df = evaluate_once(df)
    df = evaluate_once(df.withColumns({
        "series_key": series_key(F.col("measurement"), F.col("tags")), "_set": field_set(F.col("fields")),
    }))
    df = df.withColumn("canonical_lp", F.concat_ws(" ", "series_key", "_set", F.col("time_ns").cast("string")))
    df = evaluate_once(reject_oversize(df))
    good = F.col("code").isNull()
    return df.select(
        *keep,
        F.when(good, F.col("measurement")).alias("measurement"),
        F.map_from_entries(F.when(good, F.col("tags"))).alias("tags"),
        F.map_from_entries(F.when(good, F.col("fields"))).alias("fields"),
        F.when(good, F.col("time_ns")).alias("time_ns"),
        F.when(good, F.col("series_key")).alias("series_key"),
        F.when(good, F.col("canonical_lp")).alias("canonical_lp"),
        "code",
    )
