"""Result tables: pages, truncation, sorting, charts, text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepoint.catalog.registry import (
    DAY, E, EVENTS, JOB, events, event_points, length_prefixed, num, orders, query, series_sql, shared_dir, table,
)
from tidepoint.functions import identity, numbers, points, text
from tidepoint.operators import aggregate, chart, results, schema, select
from tidepoint.sinks import exports
from tidepoint.sources import responses

SERIES = series_sql("events", "event_type", "event_type")
NUMBERED = (
    f"(SELECT *, {SERIES} AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY time_ns, value, user_id) - 1 "
    f"AS row_index FROM {E})"
)


def event_result(spark, sf):
    return results.store_tabulated(events(spark, sf), "events", EVENTS.tags, EVENTS.fields, ties=["value", "user_id"])


def event_rows(spark, sf):
    return event_result(spark, sf).numbered()


def _flat(rows):
    cell = F.col("cells")
    return rows.select(
        "series_id", "row_index", cell[0]["decimal_text"].alias("time"),
        cell[1]["decimal_text"].alias("value"), cell[2]["decimal_text"].alias("user_id"),
    )


FLAT = f"series_id, row_index, CAST(time_ns AS VARCHAR) AS time, {num('value')} AS value, CAST(user_id AS VARCHAR) AS user_id"


@query("tabulate", f"SELECT {FLAT} FROM {NUMBERED}")
def tabulate(spark, sf):
    return _flat(event_rows(spark, sf))


@query("page_series", f"SELECT {FLAT} FROM {NUMBERED} WHERE event_type = 'view' AND row_index >= 120 AND row_index < 620")
def page_series(spark, sf):
    wanted = identity.series_id_of(0, "events", {"event_type": "view"})
    return _flat(event_result(spark, sf).page(0, wanted, 120, 500))


@query("select_rows", f"SELECT {FLAT} FROM {NUMBERED} WHERE event_type = 'view' AND row_index IN (0, 3, 17, 99)")
def select_rows(spark, sf):
    wanted = identity.series_id_of(0, "events", {"event_type": "view"})
    return _flat(event_result(spark, sf).pick(0, wanted, [17, 3, 0, 99]))


@query(
    "series_summary",
    f"SELECT {SERIES} AS series_id, count(*) AS row_count, event_type, 'time,value,user_id' AS columns FROM events GROUP BY event_type",
)
def series_summary(spark, sf):
    s = aggregate.series_summary(event_rows(spark, sf))
    return s.select(
        "series_id", "row_count", F.try_element_at("tags", F.lit("event_type")).alias("event_type"),
        F.array_join("columns", ",").alias("columns"),
    )


@query(
    "statement_summary",
    "SELECT conv_id % 7 AS statement_id, count(DISTINCT conv_id) AS series_count, bool_and(text <> '') AS complete, "
    "bool_or(role = 'system') AS has_error FROM conversations GROUP BY 1",
)
def statement_summary(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.pmod("conv_id", F.lit(7)).alias("statement_id"), F.col("conv_id").cast("string").alias("series_id"),
        (F.col("text") != "").alias("complete"), (F.col("role") == "system").alias("has_error"),
    )
    return aggregate.statement_summary(rows)


@query(
    "column_kinds",
    "SELECT DISTINCT 'time' AS \"column\", 'timestamp_ns' AS kind FROM events UNION ALL "
    "SELECT 'value', CASE WHEN count(DISTINCT event_type = 'error') > 1 THEN 'mixed' ELSE 'float64' END FROM events "
    "UNION ALL SELECT DISTINCT 'user_id', 'int64' FROM events",
)
def column_kinds(spark, sf):
    rows = event_rows(spark, sf)
    is_error = F.try_element_at("tags", F.lit("event_type")) == "error"
    mixed = F.transform("cells", lambda c, i: F.when(
        is_error & (i == 1), points.scalar("string", string_value=c["decimal_text"])).otherwise(c))
    return aggregate.column_kinds(rows.withColumn("cells", mixed)).select("column", "kind")


@query(
    "truncate_result",
    f"""
    WITH r AS (SELECT *, sum(strlen(CAST(time_ns AS VARCHAR)) + strlen({num('value')}) + strlen(CAST(user_id AS VARCHAR)))
                      OVER (ORDER BY event_id) AS total FROM {E})
    SELECT event_id AS arrival, {num('value')} AS value FROM r
    WHERE event_id < 100000 AND total <= 150000
    """,
)
def truncate_result(spark, sf):
    w = table(spark, sf, "events").select(
        F.col("event_id").alias("arrival"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("time"),
        numbers.float_text(F.col("value")).alias("value"), F.col("user_id").cast("string").alias("user_id"),
    )
    size = F.octet_length("time") + F.octet_length("value") + F.octet_length("user_id")
    kept, _ = results.truncate_result(w, max_rows=100_000, max_bytes=150_000, size=size.cast("bigint"))
    return kept.select("arrival", "value")


@query(
    "truncate_verdict",
    f"""
    WITH r AS (SELECT sum(strlen(CAST(time_ns AS VARCHAR))) OVER (ORDER BY event_id) AS total FROM {E})
    SELECT count(*) AS row_count, CAST(max(total) AS BIGINT) AS byte_count, true AS truncated FROM r WHERE total <= 100000
    """,
)
def truncate_verdict(spark, sf):
    w = table(spark, sf, "events").select(
        F.col("event_id").alias("arrival"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("time"),
    )
    return results.truncate_result(w, max_bytes=100_000, size=F.octet_length("time").cast("bigint"))[1]


@query(
    "sort_result",
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) - 1 AS position FROM orders",
)
def sort_result(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"), "o_custkey")
    ordered = results.sort_result(df, "key", "int64", descending=True, ties=["o_orderkey"]).select("o_orderkey", "o_custkey")
    # The sorted rows are stored in order; a row's place is that of its partition plus its place in it.
    path = shared_dir(spark, "sorted")
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # One row for each partition of the sort.
    return rows.join(F.broadcast(counts), "_part").select(
        "o_orderkey", "o_custkey", (F.col("_base") + F.col("_at") - F.col("_first")).alias("position"))


CHART = [("time", "timestamp_ns"), ("user_id", "int64")]


@query(
    "project_chart",
    f"""
    WITH o AS (SELECT min(time_ns) + (max(time_ns) - min(time_ns)) // 2 AS x0,
                      min(user_id) + (max(user_id) - min(user_id)) // 2 AS y0 FROM {E})
    SELECT event_id, 'exact' AS status, CAST(time_ns - x0 AS DOUBLE) AS x, CAST(user_id - y0 AS DOUBLE) AS y FROM {E}, o
    """,
)
def project_chart(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("time"),
        F.col("user_id").cast("string").alias("user_id"),
    )
    return chart.project_chart(df, CHART, keep=["event_id"])


@query(
    "chart_verdict",
    """
    SELECT 'exact' AS status, CAST(NULL AS VARCHAR) AS reason, false AS approximate_available,
           CAST(min(l_orderkey) + (max(l_orderkey) - min(l_orderkey)) // 2 AS VARCHAR) AS x_origin, CAST(NULL AS VARCHAR) AS y_origin
    FROM lineitem
    """,
)
def chart_verdict(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("k"), numbers.float_text(F.col("l_tax")).alias("t")
    )
    v = chart.chart_verdict(df, [("k", "int64"), ("t", "float64")])
    return v.withColumns({c: F.col(c).cast("string") for c in ("x_origin", "y_origin")})


@query(
    "format_timestamp",
    f"""
    SELECT event_id, strftime(make_timestamp(epoch_us(ts) + 28800000000), '%Y-%m-%d %H:%M:%S') ||
           CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
                ELSE '.' || rtrim(printf('%06d', epoch_us(ts) % 1000000), '0') END AS shown
    FROM events
    """,
)
def format_timestamp(spark, sf):
    e = table(spark, sf, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select("event_id", text.format_time_ns(ns, 480).alias("shown"))


@query(
    "neutralise_formula",
    "SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS cell FROM "
    "(SELECT doc_id, CASE WHEN lang = 'en' THEN '=' || text WHEN source < 'm' THEN '-' || text ELSE text END AS t FROM documents)",
)
def neutralise_formula(spark, sf):
    t = F.when(F.col("lang") == "en", F.concat(F.lit("="), "text")).when(
        F.col("source") < "m", F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.neutralise_formula(t).alias("cell"))


@query(
    "result_csv",
    f"""
    SELECT series_id, row_index, strftime(make_timestamp(time_ns // 1000), '%Y-%m-%d %H:%M:%S') ||
           CASE WHEN time_ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(printf('%09d', time_ns % 1000000000), '0') END
           || ',' || {num('value')} || ',' || user_id AS record FROM {NUMBERED}
    """,
)
def result_csv(spark, sf):
    return event_rows(spark, sf).select("series_id", "row_index", exports.result_csv_record(F.col("cells"), 3, 0).alias("record"))


@query(
    "exact_csv_text",
    "SELECT page_id, url || ',' || '\"' || replace(html, '\"', '\"\"') || '\"' AS record FROM pages",
)
def exact_csv_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", exports.csv_record([F.col("url"), F.col("html")]).alias("record"))


@query(
    "typed_jsonl_out",
    f"""
    SELECT series_id, row_index, '{{"time":{{"kind":"timestamp_ns","decimalText":"' || time_ns ||
      '"}},"user_id":{{"kind":"int64","decimalText":"' || user_id || '"}},"value":{{"kind":"float64","decimalText":"' ||
      {num('value')} || '"}}}}' AS record FROM {NUMBERED}
    """,
)
def typed_jsonl_out(spark, sf):
    return event_rows(spark, sf).select("series_id", "row_index", exports.typed_json(F.col("columns"), F.col("cells")).alias("record"))


@query(
    "series_id",
    "SELECT DISTINCT " + series_sql("documents", "lang", "lang") + " AS series_id, lang FROM documents",
)
def series_id(spark, sf):
    d = table(spark, sf, "documents").select("lang").distinct()
    return d.select(
        identity.series_id(F.lit(0), F.lit("documents"), F.create_map(F.lit("lang"), F.col("lang"))).alias("series_id"), "lang"
    )


@query(
    "fragment_id",
    f"""
    SELECT o_orderkey AS ordinal, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
           translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS fragment_id
    FROM (SELECT o_orderkey, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('{JOB}') || unhex('00') || encode('DATA')
                 || unhex('00') || encode(CAST(o_orderkey AS VARCHAR))) AS h FROM orders)
    """,
)
def fragment_id(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ordinal"), identity.fragment_id(F.lit(JOB), F.col("o_orderkey")).alias("fragment_id"))


@query(
    "target_digest",
    """SELECT doc_id, sha256('{"schemaVersion":1,"database":"' || source || '","retentionPolicy":"' || lang || '"}') AS digest FROM documents""",
)
def target_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", identity.target_digest(F.col("source"), F.col("lang")).alias("digest"))


@query(
    "escape_text",
    r"""
    SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), ' ', '\ '), ',', '\,'), '=', '\=') AS token,
           replace(replace(replace(text, '\', '\\'), ' ', '\ '), ',', '\,') AS measurement,
           '"' || replace(replace(text, '\', '\\'), '"', '\"') || '"' AS quoted FROM documents
    """,
)
def escape_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.escape_token(t).alias("token"), text.escape_measurement(t).alias("measurement"),
        text.quote_string(t).alias("quoted"),
    )


@query(
    "canonical_numbers",
    """
    SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS i, CAST(l_partkey AS VARCHAR) AS u,
           CAST(NULL AS VARCHAR) AS bad, CAST(l_suppkey + 1 AS VARCHAR) AS next FROM lineitem
    """,
)
def canonical_numbers(spark, sf):
    key, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numbers.canonical_int64(F.concat(F.lit("+000"), key)).alias("i"),
        numbers.canonical_uint64(F.concat(F.lit("00"), part)).alias("u"),
        numbers.canonical_uint64(F.concat(F.lit("-"), part)).alias("bad"),
        numbers.increment_decimal(F.col("l_suppkey").cast("string")).alias("next"),
    )


@query(
    "float_text",
    f"SELECT l_orderkey, l_linenumber, {num('l_extendedprice')} AS price, {num('l_discount')} AS discount FROM lineitem",
)
def float_text(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.float_text(F.col("l_extendedprice")).alias("price"),
        numbers.float_text(F.col("l_discount")).alias("discount"),
    )


@query(
    "resolve_numeric_kind",
    """
    SELECT l_orderkey, l_linenumber, "column",
           CASE "column" WHEN 'qty' THEN 'float64' WHEN 'key' THEN 'uint64' ELSE 'numeric_text' END AS kind,
           CASE "column" WHEN 'qty' THEN token WHEN 'key' THEN token ELSE token END AS decimal_text
    FROM (SELECT l_orderkey, l_linenumber, unnest(['qty', 'key', 'tax']) AS "column",
                 unnest([CAST(l_quantity AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_tax AS VARCHAR)]) AS token FROM lineitem)
    """,
)
def resolve_numeric_kind(spark, sf):
    li = table(spark, sf, "lineitem")
    cells = li.select(
        "l_orderkey", "l_linenumber", F.lit("lineitem").alias("measurement"),
        F.explode(F.map_from_arrays(
            F.array(F.lit("qty"), F.lit("key"), F.lit("tax")),
            F.array(F.col("l_quantity").cast("string"), F.col("l_partkey").cast("string"), F.col("l_tax").cast("string")),
        )).alias("column", "token"),
    )
    kinds = spark.createDataFrame(
        [("lineitem", "qty", "float64"), ("lineitem", "key", "uint64")], "measurement string, field string, kind string"
    )
    out = responses.resolve_numeric_kind(cells, kinds)
    return out.select("l_orderkey", "l_linenumber", "column", "kind", "decimal_text")


@query(
    "column_drift",
    """
    SELECT measurement, count(DISTINCT shape) AS shapes, CASE WHEN count(DISTINCT shape) > 1 THEN 'SCHEMA_DRIFT' END AS code
    FROM (SELECT CAST(conv_id AS VARCHAR) AS measurement, role AS shape FROM conversations) GROUP BY 1
    """,
)
def column_drift(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("measurement"), F.array(F.lit("time"), F.col("role")).alias("columns")
    )
    return schema.column_drift(rows)
