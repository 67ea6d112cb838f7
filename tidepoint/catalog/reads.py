"""Read queries: filters, aggregates, buckets, listings, slices."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidepoint.catalog.registry import (
    DAY, E, EVENTS, FEB_1, HOUR, JAN_1, O, SECOND, event_keys, event_points, events, lineitem, orders, query, rounded, shared_dir, table,
)
from tidepoint.functions import points
from tidepoint.operators import aggregate, key_catalog, mutate, schema, select
from tidepoint.plans import slices
from tidepoint.sources import tables

LOW, HIGH = JAN_1 + 5 * DAY, JAN_1 + 20 * DAY + 12345
NOW = JAN_1 + 25 * DAY


@query("time_range", f"SELECT time_ns, event_type, user_id, value FROM {E} WHERE time_ns >= {LOW} AND time_ns < {HIGH}")
def time_range(spark, sf):
    return select.time_range(events(spark, sf), LOW, HIGH).select("time_ns", "event_type", "user_id", "value")


@query("since", f"SELECT time_ns, event_type, value FROM {E} WHERE time_ns > {NOW} - {7 * DAY}")
def since(spark, sf):
    return select.since(events(spark, sf), NOW, "7d").select("time_ns", "event_type", "value")


@query("since_inclusive", f"SELECT time_ns, event_type, value FROM {E} WHERE time_ns >= {NOW} - {6 * HOUR}")
def since_inclusive(spark, sf):
    return select.since(events(spark, sf), NOW, "6h", inclusive=True).select("time_ns", "event_type", "value")


@query("tag_equals", f"SELECT time_ns, user_id, value FROM {E} WHERE event_type = 'click'")
def tag_equals(spark, sf):
    return select.tag_equals(events(spark, sf), "event_type", "click").select("time_ns", "user_id", "value")


@query("project", 'SELECT value AS "usage %", user_id AS "user" FROM events')
def project(spark, sf):
    return select.project(events(spark, sf), ["value", "user_id"], {"value": "usage %", "user_id": "user"})


@query(
    "where",
    f"SELECT time_ns, event_type, value FROM {E} "
    f"WHERE (event_type = 'click' OR value > 50) AND NOT user_id < 10 AND time_ns >= {LOW}",
)
def where(spark, sf):
    predicate = (
        ((F.col("event_type") == "click") | (F.col("value") > 50)) & ~(F.col("user_id") < 10) & (F.col("time_ns") >= LOW)
    )
    return select.where(events(spark, sf), predicate).select("time_ns", "event_type", "value")


def _agg(fn, sql_fn):
    @query(
        f"agg_{fn}",
        f"SELECT event_type, {sql_fn} AS value FROM events GROUP BY event_type",
    )
    def run(spark, sf):
        out = aggregate.aggregate(events(spark, sf), fn, "value", ["event_type"])
        return rounded(out, "value") if fn in ("mean", "sum") else out


for _fn, _sql in (
    ("mean", "round(avg(value), 6)"), ("max", "max(value)"), ("min", "min(value)"),
    ("sum", "round(sum(value), 6)"), ("count", "count(value)"),
):
    _agg(_fn, _sql)


@query(
    "agg_many",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_qty, max(l_extendedprice) AS max_price, "
    "min(l_discount) AS min_discount, round(sum(l_tax), 6) AS sum_tax, count(l_orderkey) AS n "
    "FROM lineitem GROUP BY 1, 2",
)
def agg_many(spark, sf):
    out = aggregate.aggregate_many(
        lineitem(spark, sf),
        [("mean", "l_quantity", "mean_qty"), ("max", "l_extendedprice", "max_price"),
         ("min", "l_discount", "min_discount"), ("sum", "l_tax", "sum_tax"), ("count", "l_orderkey", "n")],
        ["l_returnflag", "l_linestatus"],
    )
    return rounded(out, "mean_qty", "sum_tax")


HOURLY = [("mean", "value", "mean_value"), ("sum", "user_id", "sum_user"), ("count", "value", "n")]


@query(
    "group_by_time",
    f"SELECT time_ns - time_ns % {HOUR} AS bucket_ns, event_type, round(avg(value), 6) AS mean_value, "
    f"CAST(sum(user_id) AS BIGINT) AS sum_user, count(value) AS n FROM {E} GROUP BY 1, 2",
)
def group_by_time(spark, sf):
    return rounded(aggregate.group_by_time(events(spark, sf), "1h", HOURLY, ["event_type"]), "mean_value")


@query(
    "group_by_time_tags",
    f"SELECT time_ns - time_ns % {7 * DAY} AS bucket_ns, o_orderstatus, o_orderpriority, "
    f"round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM {O} GROUP BY 1, 2, 3",
)
def group_by_time_tags(spark, sf):
    out = aggregate.group_by_time(
        orders(spark, sf), "1w", [("sum", "o_totalprice", "total"), ("max", "o_totalprice", "top")],
        ["o_orderstatus", "o_orderpriority"],
    )
    return out.withColumn("total", F.round("total", 2))


WIDTH = 15 * 60 * SECOND


@query(
    "fill_null",
    f"""
    WITH b AS (SELECT time_ns - time_ns % {WIDTH} AS bucket_ns, event_type, max(value) AS top, count(value) AS n
               FROM {E} WHERE time_ns >= {JAN_1} AND time_ns < {FEB_1} GROUP BY 1, 2),
         g AS (SELECT event_type, unnest(generate_series({JAN_1}, {FEB_1} - {WIDTH}, {WIDTH})) AS bucket_ns
               FROM (SELECT DISTINCT event_type FROM b))
    SELECT g.bucket_ns, g.event_type, b.top, b.n FROM g LEFT JOIN b USING (bucket_ns, event_type)
    """,
)
def fill_null(spark, sf):
    inside = select.time_range(events(spark, sf), JAN_1, FEB_1)
    buckets = aggregate.group_by_time(inside, "15m", [("max", "value", "top"), ("count", "value", "n")], ["event_type"])
    return aggregate.fill_null(buckets, JAN_1, FEB_1, "15m", ["event_type"])


@query(
    "subquery",
    f"SELECT event_type, round(max(mean_value), 6) AS peak FROM "
    f"(SELECT time_ns - time_ns % {HOUR} AS b, event_type, avg(value) AS mean_value FROM {E} GROUP BY 1, 2) "
    f"GROUP BY event_type",
)
def subquery(spark, sf):
    inner = aggregate.group_by_time(events(spark, sf), "1h", [("mean", "value", "mean_value")], ["event_type"])
    return rounded(aggregate.aggregate(inner, "max", "mean_value", ["event_type"], "peak"), "peak")


def _keyed(df):
    return df.withColumn("series_key", tables.wide_series_key(F.col("measurement"), EVENTS.tags))


KEY = "'events,event_type=' || event_type AS series_key"


@query("select_all_by_series", f"SELECT {KEY}, time_ns, user_id, value FROM {E}")
def select_all_by_series(spark, sf):
    key = tables.wide_series_key(F.col("measurement"), EVENTS.tags)
    return select.select_all_by_series(events(spark, sf), key).select("series_key", "time_ns", "user_id", "value")


@query("limit_offset", f"SELECT {KEY}, time_ns, value FROM {E} ORDER BY time_ns DESC, series_key LIMIT 100 OFFSET 40")
def limit_offset(spark, sf):
    return select.limit_offset(_keyed(events(spark, sf)), 100, 40, descending=True).select("series_key", "time_ns", "value")


@query(
    "slimit",
    f"SELECT {KEY}, time_ns, value FROM {E} WHERE 'events,event_type=' || event_type IN "
    "(SELECT DISTINCT 'events,event_type=' || event_type AS k FROM events ORDER BY k LIMIT 2 OFFSET 1)",
)
def slimit(spark, sf):
    return select.series_limit(_keyed(events(spark, sf)), 2, 1).select("series_key", "time_ns", "value")


def _cardinality(of, sql, key=None):
    @query(f"cardinality_{of}", sql)
    def run(spark, sf):
        return aggregate.cardinality(event_keys(spark, sf), of, key)


_cardinality("measurement", "SELECT count(DISTINCT m) AS cardinality FROM (SELECT 'events' AS m FROM events)")
_cardinality("series", "SELECT count(DISTINCT event_type) AS cardinality FROM events")
_cardinality("tag_key", "SELECT count(DISTINCT k) AS cardinality FROM (SELECT 'event_type' AS k FROM events)")
_cardinality("tag_value", "SELECT count(DISTINCT event_type) AS cardinality FROM events", "event_type")
_cardinality(
    "field_key",
    "SELECT count(DISTINCT k) AS cardinality FROM (SELECT 'value' AS k FROM events WHERE value IS NOT NULL "
    "UNION ALL SELECT 'user_id' FROM events WHERE user_id IS NOT NULL)",
)


@query("show_measurements", "SELECT DISTINCT 'lineitem' AS name FROM lineitem UNION SELECT DISTINCT 'events' FROM events")
def show_measurements(spark, sf):
    both = lineitem(spark, sf).select("measurement").unionByName(events(spark, sf).select("measurement"))
    return aggregate.show_measurements(both)


@query("show_series", "SELECT DISTINCT 'events,event_type=' || event_type AS name FROM events")
def show_series(spark, sf):
    return aggregate.show_series(_keyed(events(spark, sf)))


@query("show_tag_keys", "SELECT DISTINCT unnest(['l_linestatus', 'l_returnflag']) AS name FROM lineitem")
def show_tag_keys(spark, sf):
    from tidepoint.catalog.registry import LINEITEM

    points = lineitem(spark, sf).select(
        "measurement", F.map_from_entries(tables.tag_entries(LINEITEM.tags)).alias("tags")
    )
    return aggregate.show_tag_keys(points, "lineitem")


@query("show_tag_values", "SELECT DISTINCT event_type AS value FROM events")
def show_tag_values(spark, sf):
    return aggregate.show_tag_values(event_keys(spark, sf), "event_type")


@query(
    "show_field_keys",
    "SELECT DISTINCT 'value' AS name, 'float64' AS kind FROM events WHERE value IS NOT NULL "
    "UNION SELECT DISTINCT 'user_id', 'int64' FROM events WHERE user_id IS NOT NULL",
)
def show_field_keys(spark, sf):
    return aggregate.show_field_keys(event_keys(spark, sf), "events")


def _documents_catalog(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("db"), F.col("lang").alias("rp"))


@query("show_databases", "SELECT DISTINCT source AS name FROM documents WHERE source <> ''")
def show_databases(spark, sf):
    return aggregate.show_databases(_documents_catalog(spark, sf))


@query("show_retention_policies", "SELECT DISTINCT lang AS name FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang <> ''")
def show_retention_policies(spark, sf):
    catalog = _documents_catalog(spark, sf)
    first = catalog.agg(F.min("db")).first()[0]
    return aggregate.show_retention_policies(catalog, first)


@query(
    "search_schema",
    """
    SELECT db, measurement, CASE WHEN hit THEN 'measurement' ELSE 'database' END AS match FROM (
      SELECT p_brand AS db, p_name AS measurement,
             lower(p_name || ' ' || p_type || ' ' || p_size) LIKE '%eco%' AS hit, lower(p_brand) LIKE '%eco%' AS db_hit
      FROM part) WHERE hit OR db_hit
    """,
)
def search_schema(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("db"), F.col("p_name").alias("measurement"),
        F.array("p_type").alias("fields"), F.array(F.col("p_size").cast("string")).alias("tags"),
    )
    return select.search_schema(rows, "  ECO ").select("db", "measurement", "match")


@query(
    "infer_schema",
    """
    SELECT DISTINCT 'events' AS measurement, 'event_type' AS name, 'tag' AS role, 'string' AS kind, NULL::VARCHAR AS code FROM events
    UNION SELECT DISTINCT 'events', 'value', 'field', 'float64', NULL FROM events
    UNION SELECT DISTINCT 'events', 'user_id', 'field', 'int64', NULL FROM events
    """,
)
def infer_schema(spark, sf):
    return schema.infer_schema(event_keys(spark, sf))


def _strict_schema(spark):
    # What an export would expect: user_id is unknown for error events, see below.
    rows = [("events", "event_type", "tag", "string"), ("events", "value", "field", "float64")]
    return spark.createDataFrame(rows, "measurement string, name string, role string, kind string")


def _mixed_points(spark, sf):
    """Event points where clicks carry only `value` and purchases an integer `value`."""
    from tidepoint.functions import points

    p = event_points(spark, sf)
    kind = F.try_element_at("tags", F.lit("event_type"))
    value = F.try_element_at("fields", F.lit("value"))
    only_value = F.create_map(F.lit("value"), value)
    integer = F.create_map(F.lit("value"), points.scalar("int64", F.try_element_at("fields", F.lit("user_id"))["decimal_text"]))
    return p.withColumn(
        "fields", F.when(kind.isin("click", "view"), only_value).when(kind == "purchase", integer).otherwise(F.col("fields"))
    )


@query(
    "validate_points",
    f"""
    SELECT event_type, CASE WHEN event_type IN ('error', 'signup') THEN 'UNKNOWN_FIELD'
                            WHEN time_ns < {LOW} OR time_ns >= {HIGH} OR event_type = 'purchase' THEN 'SCHEMA_DRIFT'
                            ELSE 'OK' END AS verdict, count(*) AS n
    FROM {E} GROUP BY 1, 2
    """,
)
def validate_points(spark, sf):
    checked = schema.validate_points(_mixed_points(spark, sf), _strict_schema(spark), LOW, HIGH)
    return checked.groupBy(
        F.try_element_at("tags", F.lit("event_type")).alias("event_type"), F.coalesce("code", F.lit("OK")).alias("verdict")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "unknown_keys",
    "SELECT DISTINCT 'events' AS measurement, 'user_id' AS name, 'field' AS role FROM events",
)
def unknown_keys(spark, sf):
    return schema.unknown_keys(event_keys(spark, sf), _strict_schema(spark))


SLICE = 6 * 3600 * SECOND


@query(
    "assign_slices",
    f"SELECT time_ns, event_type, (time_ns - {JAN_1 + 1}) // {SLICE} AS slice_ordinal FROM {E} "
    f"WHERE time_ns >= {JAN_1 + 1} AND time_ns < {FEB_1}",
)
def assign_slices(spark, sf):
    return slices.assign_slices(events(spark, sf), JAN_1 + 1, FEB_1, SLICE).select("time_ns", "event_type", "slice_ordinal")


@query(
    "assign_irregular_slices",
    f"""
    WITH b AS (SELECT row_number() OVER (ORDER BY low) - 1 AS slice_ordinal, low, lead(low) OVER (ORDER BY low) AS high
               FROM (SELECT DISTINCT epoch_us(date_trunc('hour', ts)) * 1000 + 1 AS low
                     FROM events WHERE event_type = 'signup' AND value > 40))
    SELECT e.time_ns, e.event_type, b.slice_ordinal FROM {E} e JOIN b ON e.time_ns >= b.low AND e.time_ns < b.high
    """,
)
def assign_irregular_slices(spark, sf):
    from pyspark.sql import Window

    w = events(spark, sf)
    hour = F.lit(HOUR).cast("bigint")
    # One border per hour at most, so one ordered pass over the borders is fine.
    lows = w.where((F.col("event_type") == "signup") & (F.col("value") > 40)).select(
        (F.col("time_ns") - F.pmod("time_ns", hour) + 1).alias("start_ns")
    ).distinct()
    order = Window.orderBy("start_ns")
    bounds = lows.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), "start_ns", F.lead("start_ns").over(order).alias("end_ns")
    ).where(F.col("end_ns").isNotNull())
    return slices.assign_irregular_slices(w, bounds).select("time_ns", "event_type", "slice_ordinal")


@query(
    "delete_points_preview",
    "SELECT 'events' AS measurement, count(*) AS points FROM events WHERE event_type = 'error' AND value > 10",
)
def delete_points_preview(spark, sf):
    return mutate.delete_preview(events(spark, sf), (F.col("event_type") == "error") & (F.col("value") > 10))


@query("apply_retention", f"SELECT time_ns, event_type, value FROM {E} WHERE time_ns >= {NOW} - {10 * DAY}")
def apply_retention(spark, sf):
    return mutate.apply_retention(events(spark, sf), "10d", NOW).select("time_ns", "event_type", "value")


@query(
    "delete_points",
    f"SELECT event_type, time_ns // {DAY} AS day_no, count(*) AS n, round(sum(value), 6) AS total FROM {E} "
    "WHERE NOT (event_type = 'error' AND value > 10) GROUP BY 1, 2",
)
def delete_points(spark, sf):
    path = _stored_events(spark, sf)
    mutate.delete_points(spark, path, (F.col("event_type") == "error") & (F.col("value") > 10), dry_run=False)
    return _daily(spark, path)


def _stored_events(spark, sf):
    """Points by event type: one measurement each."""
    path = shared_dir(spark, "points")
    wide = events(spark, sf).drop("time").withColumns({"db": F.lit("d"), "rp": F.lit("r"), "measurement": F.col("event_type")})
    mutate.write_points(wide, path)
    return path


def _daily(spark, path):
    left = spark.read.parquet(path)
    out = left.groupBy("event_type", F.unix_date("day").cast("bigint").alias("day_no")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return rounded(out, "total")


DAILY = f"SELECT event_type, time_ns // {DAY} AS day_no, count(*) AS n, round(sum(value), 6) AS total FROM {E} WHERE "


@query("drop_measurement", DAILY + "event_type <> 'view' GROUP BY 1, 2")
def drop_measurement(spark, sf):
    path = _stored_events(spark, sf)
    mutate.drop_measurement(spark, path, "view", dry_run=False)
    return _daily(spark, path)


@query("enforce_retention", DAILY + f"time_ns >= {NOW} - {10 * DAY + 5 * HOUR} GROUP BY 1, 2")
def enforce_retention(spark, sf):
    path = _stored_events(spark, sf)
    mutate.enforce_retention(spark, path, 10 * DAY + 5 * HOUR, NOW)
    return _daily(spark, path)


@query(
    "select_into",
    f"SELECT event_type, time_ns - time_ns % {HOUR} AS time_ns, round(avg(value), 6) AS mean_value FROM {E} GROUP BY 1, 2",
)
def select_into(spark, sf):
    """An hourly mean stored as a measurement, and read back from its own partitions."""
    path = shared_dir(spark, "into")
    hourly = aggregate.group_by_time(events(spark, sf), "1h", [("mean", "value", "mean_value")], ["event_type"])
    mutate.select_into(hourly.withColumnRenamed("bucket_ns", "time_ns"), path, "d", "r", "hourly")
    stored = spark.read.parquet(path).where((F.col("db") == "d") & (F.col("measurement") == "hourly"))
    return rounded(stored.select("event_type", "time_ns", "mean_value"), "mean_value")


@query(
    "dedupe_last",
    f"SELECT 'events,event_type=' || event_type AS series_key, time_ns - time_ns % {HOUR} AS time_ns, arg_max(value, event_id) AS value, max(event_id) AS event_id "
    "FROM (SELECT *, epoch_us(ts) * 1000 AS time_ns FROM events) GROUP BY 1, 2",
)
def dedupe_last(spark, sf):
    """Points sent again for the same hour: the last one counts."""
    e = table(spark, sf, "events").select(
        F.concat(F.lit("events,event_type="), "event_type").alias("series_key"),
        aggregate.bucket_ns(HOUR, F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"), "value", "event_id",
    )
    return select.dedupe_last(e, ["event_id"])


def _tagged_events(spark, sf):
    """Events as points whose measurements, tag keys and field keys come from the data."""
    shard = F.concat(F.lit("shard_"), F.pmod("user_id", F.lit(5)).cast("string"))
    entries = F.array(
        F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value")),
        F.struct(shard.alias("key"), F.col("user_id").cast("string").alias("value")),
    )
    e = table(spark, sf, "events")
    field = F.when(F.col("value") < 10, F.lit("low")).otherwise(F.lit("high"))
    return e.select(
        F.col("event_type").alias("measurement"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
        F.map_from_entries(entries).alias("tags"), F.create_map(field, F.struct(F.lit("float64").alias("kind"))).alias("fields"),
        points.series_key(F.col("event_type"), entries).alias("series_key"),
    )


_TAGGED = """
    SELECT event_type AS measurement, ts, json_extract_string(props, '$.k') AS k, 'shard_' || (user_id % 5) AS shard,
           CAST(user_id AS VARCHAR) AS u, CASE WHEN value < 10 THEN 'low' ELSE 'high' END AS field FROM events
"""


@query(
    "catalog_counts",
    f"""
    WITH e AS ({_TAGGED}), v AS (SELECT measurement, 'k' AS name, k AS value FROM e UNION SELECT measurement, shard, u FROM e)
    SELECT measurement, series, tag_keys, tag_values, field_keys, points, true AS sketch_close
    FROM (SELECT measurement, count(DISTINCT (k, u)) AS series, count(DISTINCT field) AS field_keys, count(*) AS points FROM e GROUP BY measurement)
    JOIN (SELECT measurement, count(DISTINCT name) AS tag_keys, count(DISTINCT (name, value)) AS tag_values FROM v GROUP BY measurement) USING (measurement)
    """,
)
def catalog_counts(spark, sf):
    """Cardinalities from the stored key sets; the sketches' own estimate lies within a tenth."""
    folder = shared_dir(spark, "keys")
    key_catalog.refresh(_tagged_events(spark, sf), folder)
    counts = key_catalog.measurements(spark, folder).withColumnRenamed("name", "measurement")
    for of, name in (("series", "series"), ("tag_key", "tag_keys"), ("tag_value", "tag_values"), ("field_key", "field_keys")):
        counts = counts.join(key_catalog.cardinality(spark, folder, of).withColumnRenamed("cardinality", name), "measurement")
    about = key_catalog.cardinality(spark, folder, "series", approximate=True).withColumnRenamed("cardinality", "about")
    close = F.abs(F.col("about") - F.col("series")) * 10 <= F.col("series")
    return counts.join(about, "measurement").withColumn("sketch_close", close).drop("about")


@query(
    "catalog_after_delete",
    f"""
    WITH e AS ({_TAGGED}), left_ AS (
        SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-05' AND NOT (measurement = 'error' AND ts < TIMESTAMP '2024-01-20')
    )
    SELECT measurement, name, value, count(*) AS points
    FROM (SELECT measurement, 'k' AS name, k AS value FROM left_ UNION ALL SELECT measurement, shard, u FROM left_)
    GROUP BY measurement, name, value
    """,
)
def catalog_after_delete(spark, sf):
    """Tag values since a day, after the days before another one lost a measurement; only these days are read again."""
    folder = shared_dir(spark, "keys")
    events_ = _tagged_events(spark, sf)
    key_catalog.refresh(events_, folder)
    touched = events_.where(F.col("time_ns") < JAN_1 + 19 * DAY)
    days = touched.select(mutate.day_of(F.col("time_ns")).alias("day")).distinct()
    key_catalog.refresh(touched.where(F.col("measurement") != "error"), folder, days)
    return key_catalog.keys(spark, folder, "tag_value", since=datetime.date(2024, 1, 5))
