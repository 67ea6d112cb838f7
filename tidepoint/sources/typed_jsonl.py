"""Typed JSON lines, version 1: one point per line, every value a tagged scalar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions import numbers, points, text
from tidepoint.functions.joins import bounded_broadcast
from tidepoint.model import (
    INVALID_INPUT,
    MAX_JSONL_LINE_BYTES,
    NUMERIC_TYPE_REQUIRED,
    POINT_TOO_LARGE,
    RejectedInput,
    TIMESTAMP_REQUIRED,
)
from tidepoint.sources import lines
from tidepoint.sources.line_protocol import split_rejects

# --- Fixed values: member names -------------------------------------------------
POINT_MEMBERS = ("schemaVersion", "measurement", "tags", "fields", "timestamp")
SCALAR_MEMBERS = ("kind", "decimalText", "value")
MAPPABLE = ("int64", "uint64", "float64")

# A member name in another spelling than the fixed one. Few lines have one, so all others cost this look alone.
_NAMES = "|".join(POINT_MEMBERS + SCALAR_MEMBERS)
OTHER_CASE = rf'"(?!(?:{_NAMES})")(?iu:{_NAMES})"\s*+:'
TEXT_MAP = "map<string,string>"  # its entries keep the order and the repeats of the text


def check_numeric_mapping(mapping: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(measurement, field, kind) rows: known kinds, no duplicate (measurement, field)."""
    seen = set()
    for measurement, field, kind in mapping:
        if not measurement or not field or kind not in MAPPABLE or (measurement, field) in seen:
            raise RejectedInput(INVALID_INPUT, f"numeric mapping {measurement!r} {field!r} {kind!r}")
        seen.add((measurement, field))
    return sorted(mapping)


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _object(v: Column) -> Column:
    """VARIANT object -> MAP<STRING, VARIANT>; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _member(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def _folded(name: Column) -> Column:
    return F.lower(F.upper(name))


def _text_entries(json: Column) -> Column:
    """The members of a JSON object as (key, value text), in the order of the text."""
    return F.map_entries(F.from_json(json, TEXT_MAP))


def _last_text(entries: Column, name: Column) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]


def _last_folded(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: _folded(e["key"]) == name.lower()), F.lit(-1))["value"]


def _spelled(m: Column, entries: Column, names: tuple[str, ...], plain: tuple[str, ...]) -> Column:
    """MAP<STRING, VARIANT> with `names` in their own spelling, whatever the case in the text.

    Of several spellings of one member the last in the text counts; for `plain` members the last that is not JSON null.
    """
    def last(name):
        same = F.filter(entries, lambda e: _folded(e["key"]) == name.lower())
        if name in plain:
            same = F.filter(same, lambda e: ~F.is_variant_null(F.try_element_at(m, e["key"])))
        return F.try_element_at(m, F.try_element_at(same, F.lit(-1))["key"])

    known = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), last(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    folded = F.array(*[F.lit(n.lower()) for n in names])
    unknown = F.filter(F.map_entries(m), lambda e: ~F.array_contains(folded, _folded(e["key"])))
    return F.map_from_entries(F.concat(known, unknown))


def _present(v: Column) -> Column:
    """Set and not JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def _string(v: Column) -> Column:
    return F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _only(m: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, names)))) == 0


def _members(m: Column) -> Column:
    """Tagged scalar as a map -> STRUCT<known, kind, decimal, value>, still variants."""
    return F.struct(
        F.coalesce(_only(m, SCALAR_MEMBERS), F.lit(False)).alias("known"),
        _member(m, "kind").alias("kind"), _member(m, "decimalText").alias("decimal"), _member(m, "value").alias("value"),
    )


def _scalar_parts(p: Column) -> Column:
    """_members -> STRUCT<ok, kind, decimal, value>."""
    decimal = _string(p["decimal"])
    kind = _string(p["kind"])
    return F.struct(
        F.coalesce(p["known"] & (kind != "") & (~_present(p["decimal"]) | decimal.isNotNull()), F.lit(False)).alias("ok"),
        kind.alias("kind"),
        decimal.alias("decimal"),
        p["value"].alias("value"),
    )


def parse_typed_jsonl(
    df: DataFrame,
    raw: str = "raw",
    keep: list[str] | None = None,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Lines in column `raw` -> point columns plus `code`.

    `mapping` (measurement, field, kind) names the type of numeric_text fields. It is
    folded to one row per measurement and joined on the measurement.
    """
    keep = list(keep or [])
    df = df.select(*keep, F.col(raw).alias("_line")).where(F.col("_line") != "")
    in_size = F.octet_length("_line") <= MAX_JSONL_LINE_BYTES
    in_list = F.try_parse_json(F.concat(F.lit("["), F.col("_line"), F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"line":'), F.col("_line"), F.lit("}")))
    df = points.evaluate_once(df.withColumns({
        "_list": F.when(in_size, in_list), "_object": F.when(in_size, in_object)
    }))
    # The parser stops at the end of the first value, so the line is parsed inside brackets
    # and inside braces: no trailing text can close both too early.
    alone = F.col("_list").isNotNull() & F.try_variant_get("_list", "$[1]", "variant").isNull()
    df = points.evaluate_once(
        df.withColumn("_json", F.when(alone, F.try_variant_get("_object", "$.line", "variant"))).drop("_list", "_object")
    )
    df = points.evaluate_once(df.withColumn("_root", _object(F.col("_json"))).drop("_json"))
    # Members in any case: only lines that have such names are read a second time.
    df = points.evaluate_once(df.withColumn(
        "_entries", F.when(F.col("_root").isNotNull() & F.col("_line").rlike(OTHER_CASE), _text_entries(F.col("_line")))))
    entries, root = F.col("_entries"), F.col("_root")
    df = points.evaluate_once(df.withColumns({
        "_root": F.when(entries.isNotNull(), _spelled(root, entries, POINT_MEMBERS, ("schemaVersion", "measurement"))).otherwise(root),
        "_inner": F.when(entries.isNotNull(), _text_entries(_last_folded(entries, "fields"))),
        "_time_inner": F.when(entries.isNotNull(), _text_entries(_last_folded(entries, "timestamp"))),
    }))
    df = df.select(
        *keep, "_root", "_inner", "_time_inner", F.octet_length("_line").alias("_bytes"),
        _member(root, "schemaVersion").alias("_version"),
        _string(_member(root, "measurement")).alias("measurement"),
        _member(root, "tags").alias("_tags"),
        _object(_member(root, "fields")).alias("_fields"),
        _member(root, "timestamp").alias("_timestamp"),
    )
    tags = F.coalesce(
        F.when(~_present(F.col("_tags")), F.create_map().cast("map<string,variant>")),
        _object(F.col("_tags")),
    )
    df = points.evaluate_once(df)
    df = df.withColumn("_tag_entries", F.map_entries(tags))
    # Each step is an array of its own, so a member is looked up once and not once per use.
    as_maps = F.transform(F.map_entries("_fields"), lambda e: F.struct(e["key"].alias("key"), _object(e["value"]).alias("m")))
    def spelled_field(e):
        inner = _text_entries(_last_text(F.col("_inner"), e["key"]))
        return F.when(F.col("_inner").isNotNull(), _spelled(e["m"], inner, SCALAR_MEMBERS, ("kind",))).otherwise(e["m"])

    as_maps = F.transform(as_maps, lambda e: F.struct(e["key"].alias("key"), spelled_field(e).alias("m")))
    as_members = F.transform(as_maps, lambda e: F.struct(e["key"].alias("key"), _members(e["m"]).alias("p")))
    time_map = _object(F.col("_timestamp"))
    df = df.withColumn("_time_map", F.when(
        F.col("_time_inner").isNotNull(), _spelled(time_map, F.col("_time_inner"), SCALAR_MEMBERS, ("kind",))).otherwise(time_map))
    df = points.evaluate_once(df.withColumns({
        "_time_members": _members(F.col("_time_map")),
        "_staged": F.transform(as_members, lambda e: F.struct(e["key"].alias("key"), _scalar_parts(e["p"]).alias("s"))),
    }).drop("_time_map", "_inner", "_time_inner"))
    df = df.withColumn("_time", _scalar_parts(F.col("_time_members"))).drop("_time_members")
    df = points.evaluate_once(df)
    if mapping is not None:
        folded = mapping.groupBy(F.col("measurement").alias("_m")).agg(
            F.map_from_entries(F.collect_list(F.struct("field", "kind"))).alias("_kinds")
        )
        folded = bounded_broadcast(folded, mapping)
        df = df.join(folded, df["measurement"] == folded["_m"], "left").drop("_m")
    else:
        df = df.withColumn("_kinds", F.lit(None).cast("map<string,string>"))

    def field(e):
        s = e["s"]
        given = s["kind"]
        untyped = (given == "numeric_text")
        mapped = F.when(
            untyped & s["decimal"].isNotNull() & s["value"].isNull(),
            F.try_element_at(F.col("_kinds"), e["key"]),
        )
        kind = F.when(untyped, mapped).otherwise(given)
        is_number = kind.isin(*MAPPABLE)
        string_value = F.when(F.is_variant_null(s["value"]), "").otherwise(_string(s["value"]))
        bool_value = F.when(F.is_variant_null(s["value"]), F.lit(False)).when(
            _type(s["value"]) == "BOOLEAN", F.try_variant_get(s["value"], "$", "boolean")
        )
        no_decimal = s["decimal"].isNull() & s["value"].isNotNull()
        string_ok = no_decimal & string_value.isNotNull() & ~text.has_control(string_value)
        bool_ok = no_decimal & bool_value.isNotNull()
        number_ok = s["decimal"].isNotNull() & s["value"].isNull()
        code = (
            F.when(~s["ok"] | ~text.valid_name(e["key"]), INVALID_INPUT)
            .when(untyped & mapped.isNull(), NUMERIC_TYPE_REQUIRED)
            .when(
                F.coalesce(
                    ((kind == "string") & string_ok)
                    | ((kind == "boolean") & bool_ok)
                    | (is_number & number_ok),
                    F.lit(False),
                ),
                F.lit(None),
            )
            .otherwise(INVALID_INPUT)
        )
        return F.struct(
            points.raw_field(
                e["key"], kind, F.when(is_number, s["decimal"]),
                F.when(kind == "string", string_value), F.when(kind == "boolean", bool_value),
            ).alias("f"),
            code.alias("code"),
        )

    df = points.evaluate_once(df.withColumn("_checked", F.transform("_staged", field)))
    time = F.col("_time")
    time_text = numbers.canonical_int64(time["decimal"])
    codes = F.transform("_checked", lambda c: c["code"])
    bad_tag = F.exists(
        "_tag_entries",
        lambda t: ~F.coalesce(text.valid_name(t["key"]) & text.valid_name(_string(t["value"])), F.lit(False)),
    )
    header_ok = F.coalesce(
        _only(F.col("_root"), POINT_MEMBERS)
        & (_type(F.col("_version")) == "BIGINT")
        & (F.try_variant_get("_version", "$", "bigint") == 1)
        & text.valid_name(F.col("measurement"))
        & (F.size("_fields") > 0)
        & (F.col("_tag_entries").isNotNull()),
        F.lit(False),
    )
    time_ok = time["ok"] & (time["kind"] == "timestamp_ns") & time["decimal"].isNotNull() & time["value"].isNull()
    df = df.withColumn(
        "code",
        F.when(F.col("_bytes") > MAX_JSONL_LINE_BYTES, POINT_TOO_LARGE)
        .when(~header_ok, INVALID_INPUT)
        .when(F.col("_timestamp").isNull(), TIMESTAMP_REQUIRED)
        .when(F.coalesce(bad_tag, F.lit(True)), INVALID_INPUT)
        .when(~F.coalesce(time_ok, F.lit(False)), TIMESTAMP_REQUIRED)
        .when(time_text.isNull(), INVALID_INPUT)
        .when(F.array_contains(codes, INVALID_INPUT), INVALID_INPUT)
        .when(F.array_contains(codes, NUMERIC_TYPE_REQUIRED), NUMERIC_TYPE_REQUIRED),
    )
    df = points.evaluate_once(df)
    good = F.col("code").isNull()
    df = df.select(
        *keep, "code", "measurement",
        F.transform(
            F.when(good, F.col("_tag_entries")),
            lambda t: F.struct(t["key"].alias("key"), _string(t["value"]).alias("value")),
        ).alias("tags"),
        F.transform(F.when(good, F.col("_checked")), lambda c: c["f"]).alias("fields"),
        F.when(good, time_text).try_cast("bigint").alias("time_ns"),
    )
    return points.assemble(points.evaluate_once(df), keep)


def read_typed_jsonl(
    spark: SparkSession, path, numeric_map: list[tuple[str, str, str]] | None = None,
    fail_on_reject: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of typed JSONL files."""
    mapping = None
    if numeric_map:
        mapping = spark.createDataFrame(
            check_numeric_mapping(numeric_map), "measurement string, field string, kind string"
        )
    raw = lines.read_lines(spark, path)
    parsed = parse_typed_jsonl(raw, keep=[*lines.PLACE, "raw"], mapping=mapping)
    return split_rejects(parsed, raw, fail_on_reject)
