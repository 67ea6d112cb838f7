"""Relational tables seen as time-series points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepoint.functions import numbers, points


@dataclass(frozen=True)
class PointShape:
    """How a table maps to points. `fields` gives the scalar kind of every field column."""

    measurement: str
    time: str
    tags: tuple[str, ...]
    fields: dict[str, str]


def wide_points(df: DataFrame, shape: PointShape) -> DataFrame:
    """points_wide: measurement, time (display TIMESTAMP_NTZ), time_ns, tags, typed fields.

    `time` stays beside the exact key because range operators turn a nanosecond range into
    a coarse predicate on it, and that one reaches the Parquet scan.
    """
    stamp = F.col(shape.time)
    return df.select(
        F.lit(shape.measurement).alias("measurement"),
        stamp.cast("timestamp_ntz").alias("time"),
        (F.unix_micros(stamp.cast("timestamp")) * F.lit(1000)).alias("time_ns"),
        *shape.tags,
        *shape.fields,
    )


def tag_entries(tags: tuple[str, ...]) -> Column:
    """Sorted ARRAY<STRUCT<key, value>> of the non-empty tag columns."""
    entries = F.array(*[
        F.struct(F.lit(t).alias("key"), F.col(f"`{t}`").alias("value")) for t in sorted(tags)
    ])
    return F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != ""))


def wide_series_key(measurement: Column, tags: tuple[str, ...]) -> Column:
    return points.series_key(measurement, tag_entries(tags))


def field_scalar(name: str, kind: str, text: Column | None = None) -> Column:
    """Typed column -> scalar struct (NULL column -> NULL struct). `text` is a float's settled text."""
    c = F.col(f"`{name}`")
    if kind == "string":
        value = points.scalar(kind, string_value=c)
    elif kind == "boolean":
        value = points.scalar(kind, bool_value=c)
    elif kind == "float64":
        value = points.scalar(kind, numbers.float_text(c) if text is None else text)
    else:
        value = points.scalar(kind, c.cast("string"))
    return F.when(c.isNotNull(), value)


def _settled_floats(df: DataFrame, names: list[str]) -> DataFrame:
    """Add `_t_<name>`, the canonical text of each float column, with one trip to Python for all."""
    if not names:
        return df
    plain = {n: numbers.plain_text(F.col(f"`{n}`")) for n in names}
    df = points.evaluate_once(df.withColumns({f"_t_{n}": c for n, c in plain.items()}))
    slow = F.array(*[F.when(F.col(f"`_t_{n}`").isNull(), F.col(f"`{n}`")) for n in names])
    any_slow = F.lit(False)
    for n in names:
        any_slow = any_slow | (F.col(f"`_t_{n}`").isNull() & F.col(f"`{n}`").isNotNull())
    df = points.evaluate_once(df.withColumn("_slow", numbers.shortest_each(F.when(any_slow, slow))))
    return df.withColumns({
        f"_t_{n}": F.coalesce(F.col(f"`_t_{n}`"), F.nullif(F.get("_slow", F.lit(i)), F.lit("")))
        for i, n in enumerate(names)
    }).drop("_slow")


def points_from_wide(df: DataFrame, shape: PointShape, keep: tuple[str, ...] = ()) -> DataFrame:
    """points_wide -> canonical long points; NULL fields are absent, rows without a field are dropped.

    The shape is known, so lines are built by plain concatenation in key order.
    """
    from tidepoint.functions import text

    fields = sorted(shape.fields.items(), key=lambda f: f[0].encode())
    df = df.select(*keep, "measurement", "time_ns", *shape.tags, *shape.fields)
    df = df.where(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in shape.fields]).isNotNull())
    df = _settled_floats(df, [n for n, k in fields if k == "float64"])
    df = points.evaluate_once(df)

    def settled(name, kind):
        return F.col(f"`_t_{name}`") if kind == "float64" else None

    pairs = []
    for name, kind in fields:
        c = F.col(f"`{name}`")
        shown = {
            "float64": lambda: settled(name, kind), "string": lambda: text.quote_string(c),
            "boolean": lambda: c.cast("string"), "int64": lambda: F.concat(c.cast("string"), F.lit("i")),
            "uint64": lambda: F.concat(c.cast("string"), F.lit("u")),
        }[kind]()
        pairs.append(F.concat(text.escape_token(F.lit(name)), F.lit("="), shown))
    tags = [
        F.when(F.col(f"`{t}`") != "", F.concat(
            F.lit(","), text.escape_token(F.lit(t)), F.lit("="), text.escape_token(F.col(f"`{t}`"))))
        for t in sorted(shape.tags, key=str.encode)
    ]
    entries = F.filter(
        F.array(*[
            F.struct(F.lit(n).alias("key"), field_scalar(n, k, settled(n, k)).alias("value")) for n, k in fields
        ]),
        lambda e: e["value"].isNotNull(),
    )
    return df.select(
        *keep,
        "measurement",
        F.map_from_entries(tag_entries(shape.tags)).alias("tags"),
        F.map_from_entries(entries).alias("fields"),
        "time_ns",
        F.concat(text.escape_measurement(F.col("measurement")), F.concat_ws("", *tags)).alias("series_key"),
        F.concat_ws(
            " ",
            F.concat(text.escape_measurement(F.col("measurement")), F.concat_ws("", *tags)),
            F.concat_ws(",", *pairs),
            F.col("time_ns").cast("string"),
        ).alias("canonical_lp"),
    )


def keys_from_wide(df: DataFrame, shape: PointShape) -> DataFrame:
    """points_wide -> measurement, tags, fields (kinds only), series_key, for listings and cardinalities.

    Nothing stands between these columns and the scan, so a listing reads the columns it needs.
    """
    kinds = F.array(*[
        F.struct(F.lit(n).alias("key"), F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.lit(k).alias("kind"))).alias("value"))
        for n, k in sorted(shape.fields.items())
    ])
    return df.select(
        "measurement", F.map_from_entries(tag_entries(shape.tags)).alias("tags"),
        F.map_from_entries(F.filter(kinds, lambda e: e["value"].isNotNull())).alias("fields"),
        wide_series_key(F.col("measurement"), shape.tags).alias("series_key"),
    )


def points_line() -> Column:
    """Canonical line of a long point; NULL when a field has a kind that cannot be written."""
    fields = F.array_sort(F.map_entries("fields"), lambda a, b: F.when(a["key"] < b["key"], -1)
                          .when(a["key"] > b["key"], 1).otherwise(0))
    writable = F.forall(fields, lambda f: points.lp_value(f["value"]).isNotNull())
    return F.when(
        writable,
        F.concat_ws(" ", "series_key", points.field_set(fields), F.col("time_ns").cast("string")),
    )
