"""Ingest and export: line protocol, typed JSON lines, mapped CSV, batches, packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepoint.catalog.registry import (
    DAY, E, EVENT_LINE, EVENTS, FEB_1, JAN_1, JOB, LINEITEM, SECOND, event_points, events, num, query,
    shared_dir, spread_table, table,
)
from tidepoint.functions import identity
from tidepoint.functions.work import stored
from tidepoint.operators import aggregate, batches, results
from tidepoint.plans import exports as packages
from tidepoint.plans import slices
from tidepoint.sinks import exports
from tidepoint.sources import line_protocol, mapped_csv, responses, tables, typed_jsonl

LI_LINE = (
    "'lineitem,l_linestatus=' || l_linestatus || ',l_returnflag=' || l_returnflag || ' l_discount=' || "
    + num("l_discount") + " || ',l_extendedprice=' || " + num("l_extendedprice")
    + " || ',l_orderkey=' || l_orderkey || 'i,l_quantity=' || " + num("l_quantity")
    + " || ',l_tax=' || " + num("l_tax") + " || ' ' || epoch_us(l_shipdate) * 1000"
)


def _lineitem_points(spark, sf):
    return tables.points_from_wide(tables.wide_points(spread_table(spark, sf, "lineitem"), LINEITEM), LINEITEM)


@query("canonical_lp", f"SELECT {LI_LINE} AS canonical_lp FROM lineitem")
def canonical_lp(spark, sf):
    return _lineitem_points(spark, sf).select("canonical_lp")


def _event_lines(spark, sf):
    """Lines as a sloppy writer sends them: unsorted, odd spellings, and every kind of defect."""
    e = spread_table(spark, sf, "events")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    kind, value, user = F.col("event_type"), F.col("value").cast("string"), F.col("user_id").cast("string")
    line = (
        F.when(kind == "view", F.concat(F.lit("events,event_type=view value="), value, F.lit("00,user_id=00"), user, F.lit("i 0"), ns))
        .when(kind == "click", F.concat(F.lit("events,z\\ one=a\\,b,event_type=click ok=T,user_id=+"), user, F.lit('i,note="a \\"b\\" c, d=e",value='), value, F.lit(" "), ns))
        .when(kind == "error", F.concat(F.lit("events,event_type=error value="), value))
        .when(kind == "signup", F.concat(F.lit("events,event_type=signup user_id="), user, F.lit("i,event_type=1i "), ns))
        .otherwise(F.concat(F.lit("events,event_type=purchase big="), user, F.lit("u,value=1e"), user, F.lit(" "), ns))
    )
    return e.select("event_id", "user_id", line.alias("raw"))


# Text of the double 1e<user>: an exponent from 1e6 on, overflow past 308.
BIG = "CASE WHEN user_id < 6 THEN '1' || repeat('0', CAST(user_id AS INTEGER)) ELSE '1e+' || CASE WHEN user_id < 10 THEN '0' ELSE '' END || user_id END"


@query(
    "parse_line_protocol",
    f"""
    SELECT event_id,
      CASE event_type
        WHEN 'view' THEN 'events,event_type=view user_id=' || user_id || 'i,value=' || {num('value')} || ' ' || time_ns
        WHEN 'click' THEN 'events,event_type=click,z\\ one=a\\,b note="a \\"b\\" c, d=e",ok=true,user_id=' || user_id || 'i,value=' || {num('value')} || ' ' || time_ns
        WHEN 'purchase' THEN CASE WHEN user_id <= 308 THEN 'events,event_type=purchase big=' || user_id || 'u,value=' || {BIG} || ' ' || time_ns END
      END AS canonical_lp,
      CASE WHEN event_type = 'error' THEN 'TIMESTAMP_REQUIRED' WHEN event_type = 'signup' THEN 'INVALID_INPUT'
           WHEN event_type = 'purchase' AND user_id > 308 THEN 'INVALID_INPUT' END AS code
    FROM {E}
    """,
)
def parse_line_protocol(spark, sf):
    return line_protocol.parse_line_protocol(_event_lines(spark, sf), keep=["event_id"]).select("event_id", "canonical_lp", "code")


@query(
    "parse_line_protocol_values",
    "SELECT l_returnflag, l_linestatus, epoch_us(l_shipdate) * 1000 AS time_ns, l_quantity, l_extendedprice, l_orderkey FROM lineitem",
)
def parse_line_protocol_values(spark, sf):
    lines = _lineitem_points(spark, sf).select(F.col("canonical_lp").alias("raw"))
    p = line_protocol.parse_line_protocol(lines)

    def field(name, to):
        return F.try_element_at("fields", F.lit(name))["decimal_text"].cast(to).alias(name)

    return p.select(
        F.try_element_at("tags", F.lit("l_returnflag")).alias("l_returnflag"),
        F.try_element_at("tags", F.lit("l_linestatus")).alias("l_linestatus"),
        "time_ns", field("l_quantity", "double"), field("l_extendedprice", "double"), field("l_orderkey", "bigint"),
    )


@query(
    "ingest_stats",
    f"""
    SELECT code, count(*) AS row_count, CAST(coalesce(sum(strlen(line) + 1), 0) AS BIGINT) AS logical_bytes FROM (
      SELECT CASE WHEN event_type = 'error' THEN 'TIMESTAMP_REQUIRED' WHEN event_type = 'signup' THEN 'INVALID_INPUT'
                  WHEN event_type = 'purchase' AND user_id > 308 THEN 'INVALID_INPUT' ELSE '' END AS code,
        CASE event_type
        WHEN 'view' THEN 'events,event_type=view user_id=' || user_id || 'i,value=' || {num('value')} || ' ' || time_ns
        WHEN 'click' THEN 'events,event_type=click,z\\ one=a\\,b note="a \\"b\\" c, d=e",ok=true,user_id=' || user_id || 'i,value=' || {num('value')} || ' ' || time_ns
        WHEN 'purchase' THEN CASE WHEN user_id <= 308 THEN 'events,event_type=purchase big=' || user_id || 'u,value=' || {BIG} || ' ' || time_ns END
        END AS line FROM {E}) GROUP BY code
    """,
)
def ingest_stats(spark, sf):
    return aggregate.ingest_stats(line_protocol.parse_line_protocol(_event_lines(spark, sf)))


@query(
    "line_protocol_files",
    f"SELECT {EVENT_LINE} AS canonical_lp FROM {E}",
)
def line_protocol_files(spark, sf):
    """Points written as text files and read back."""
    path = shared_dir(spark, "lp")
    event_points(spark, sf).select("canonical_lp").write.text(path)
    good, _ = line_protocol.read_line_protocol(spark, path)
    return good.select("canonical_lp")


@query(
    "typed_jsonl",
    f"""
    SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN
        'events,event_type=' || event_type || ' note="' || event_type || '",user_id=' || user_id || 'i,value=' || {num('value')} || ' ' || time_ns END AS canonical_lp,
      CASE event_type WHEN 'error' THEN 'NUMERIC_TYPE_REQUIRED' WHEN 'signup' THEN 'INVALID_INPUT' END AS code
    FROM {E}
    """,
)
def typed_jsonl_in(spark, sf):
    e = spread_table(spark, sf, "events")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    kind = F.col("event_type")
    extra = F.when(kind == "error", F.lit('"odd":{"kind":"numeric_text","decimalText":"1"},')).when(
        kind == "signup", F.lit('"odd":{"kind":"int64","decimalText":"1","unit":"s"},')).otherwise(F.lit(""))
    line = F.concat(
        F.lit('{"schemaVersion":1,"measurement":"events","tags":{"event_type":"'), kind, F.lit('"},"fields":{'), extra,
        F.lit('"value":{"kind":"numeric_text","decimalText":"'), F.col("value").cast("string"),
        F.lit('"},"user_id":{"kind":"int64","decimalText":"'), F.col("user_id").cast("string"),
        F.lit('"},"note":{"kind":"string","value":"'), kind,
        F.lit('"}},"timestamp":{"kind":"timestamp_ns","decimalText":"'), ns, F.lit('"}}'),
    )
    mapping = spark.createDataFrame([("events", "value", "float64")], "measurement string, field string, kind string")
    parsed = typed_jsonl.parse_typed_jsonl(e.select("event_id", line.alias("raw")), keep=["event_id"], mapping=mapping)
    return parsed.select("event_id", "canonical_lp", "code")


@query(
    "mapped_csv",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' THEN
        'orders,status=' || o_orderstatus || ' customer=' || o_custkey || 'u,note="' || o_orderpriority || '",price=' || {num('o_totalprice')} || ',urgent=false ' ||
        epoch_us(o_orderdate) * 1000 END AS canonical_lp,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'TIMESTAMP_REQUIRED' WHEN o_orderstatus = 'P' THEN 'INVALID_INPUT' END AS code
    FROM orders
    """,
)
def mapped_csv_in(spark, sf):
    o = spread_table(spark, sf, "orders")
    rows = o.select(
        "o_orderkey", F.col("o_orderstatus").alias("st"),
        F.when(F.col("o_orderpriority") != "1-URGENT",
               (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")).alias("t"),
        F.col("o_totalprice").cast("string").alias("pr"), F.col("o_custkey").cast("string").alias("cu"),
        F.col("o_orderpriority").alias("no"), F.when(F.col("o_orderstatus") == "P", "maybe").otherwise("0").alias("ur"),
    )
    mapping = mapped_csv.CsvMapping(
        timestamp_column="t", static_measurement="orders", tag_columns={"st": "status"},
        field_columns={"pr": ("price", "float64"), "cu": ("customer", "uint64"), "no": ("note", "string"), "ur": ("urgent", "boolean")},
    )
    mapped_csv.check_csv_mapping(["st", "t", "pr", "cu", "no", "ur"], mapping)
    return mapped_csv.points_from_csv(rows, mapping, keep=["o_orderkey"]).select("o_orderkey", "canonical_lp", "code")


MAX_POINTS, MAX_BYTES = 100, 6000


def _indexed_lines(spark, sf):
    p = event_points(spark, sf).withColumn("fragment", F.col("series_key"))
    return results.number_rows(
        p.select("fragment", "time_ns", "canonical_lp"), ["fragment"], ["time_ns", "canonical_lp"], "line_index")


BATCHES = f"""
    WITH RECURSIVE l AS (
      SELECT 'events,event_type=' || event_type AS fragment, {EVENT_LINE} AS line,
             row_number() OVER (PARTITION BY event_type ORDER BY time_ns, {EVENT_LINE}) - 1 AS i FROM {E}),
    p AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY fragment ORDER BY i) AS BIGINT) AS e,
                 CAST(sum(strlen(line) + 1) OVER (PARTITION BY fragment ORDER BY i) - strlen(line) - 1 AS BIGINT) AS o FROM l),
    nx AS (SELECT a.fragment, a.i AS s, max(b.i) + 1 AS nxt FROM p a JOIN p b ON a.fragment = b.fragment
             AND b.i >= a.i AND b.i < a.i + {MAX_POINTS} AND (b.i = a.i OR b.e - a.o - 1 <= {MAX_BYTES}) GROUP BY 1, 2),
    b AS (SELECT fragment, CAST(0 AS BIGINT) AS s FROM l WHERE i = 0
          UNION ALL SELECT nx.fragment, CAST(nx.nxt AS BIGINT) FROM b JOIN nx ON nx.fragment = b.fragment AND nx.s = b.s
                    WHERE nx.nxt IN (SELECT i FROM l WHERE l.fragment = nx.fragment))
"""


@query(
    "plan_batches",
    BATCHES + """
    SELECT b.fragment, b.s AS batch_start, nx.nxt - b.s AS points, p.o AS start_offset
    FROM b JOIN nx ON nx.fragment = b.fragment AND nx.s = b.s JOIN p ON p.fragment = b.fragment AND p.i = b.s
    """,
)
def plan_batches(spark, sf):
    plan = batches.plan_batches(_indexed_lines(spark, sf), MAX_POINTS, MAX_BYTES)
    return plan.groupBy("fragment", "batch_start", "start_offset").agg(F.count(F.lit(1)).alias("points"))


@query(
    "batch_payloads",
    BATCHES + """
    SELECT b.fragment, b.s AS batch_start, p.o AS start_offset, p.o + strlen(string_agg(q.line, chr(10) ORDER BY q.i)) + 1 AS end_offset,
           count(*) AS points, sha256(string_agg(q.line, chr(10) ORDER BY q.i)) AS payload_digest
    FROM b JOIN nx ON nx.fragment = b.fragment AND nx.s = b.s JOIN p ON p.fragment = b.fragment AND p.i = b.s
    JOIN p q ON q.fragment = b.fragment AND q.i >= b.s AND q.i < nx.nxt GROUP BY b.fragment, b.s, p.o
    """,
)
def batch_payloads(spark, sf):
    lines = _indexed_lines(spark, sf)
    return batches.batch_payloads(lines, batches.plan_batches(lines, MAX_POINTS, MAX_BYTES)).drop("payload")


@query(
    "export_plan",
    f"""
    WITH r AS (SELECT min(time_ns) AS lo, max(time_ns) + 1 AS hi FROM {E}),
         s AS (SELECT unnest(generate_series(0, (hi - lo - 1) // {DAY})) AS ordinal, lo, hi FROM r)
    SELECT ordinal, 'slice/' || printf('%06d', ordinal) AS quantum_id, 'data-' || printf('%06d', ordinal) || '.lp.gz' AS file,
           lo + ordinal * {DAY} AS start_ns, least(lo + (ordinal + 1) * {DAY}, hi) AS end_ns,
           (SELECT count(*) FROM {E} e WHERE e.time_ns >= lo + ordinal * {DAY} AND e.time_ns < least(lo + (ordinal + 1) * {DAY}, hi)) AS points
    FROM s
    """,
)
def export_plan(spark, sf):
    w = events(spark, sf)
    low, high = w.agg(F.min("time_ns"), F.max("time_ns") + 1).first()
    plan = slices.plan_slices(spark, JOB, low, high, DAY)
    counts = slices.assign_slices(w, low, high, DAY).groupBy("slice_ordinal").agg(F.count(F.lit(1)).alias("points"))
    return plan.join(counts, plan["ordinal"] == counts["slice_ordinal"], "left").select(
        "ordinal", "quantum_id", "file", "start_ns", "end_ns", F.coalesce("points", F.lit(0)).alias("points")
    )


SLICE_POINTS, SLICES = 2000, 10_000


@query("export_package", f"SELECT {EVENT_LINE} AS canonical_lp FROM {E} WHERE time_ns >= {JAN_1} AND time_ns < {FEB_1}")
def export_package(spark, sf):
    """Plan, write, verify, list in a manifest, and read the package back."""
    directory = shared_dir(spark, "package")
    found = stored(event_points(spark, sf), "points")  # made once for the plan, the files and the schema
    plan = slices.plan_bounded_slices(found, JOB, JAN_1, FEB_1, max(SLICE_POINTS, table(spark, sf, "events").count() // SLICES))
    parts = exports.write_canonical_lp(slices.assign_bounded_slices(found, plan), plan, directory)
    spec = {"database": "d", "retention_policy": "r", "measurement": "events", "start_ns": JAN_1, "end_ns": FEB_1}
    from tidepoint.operators.schema import infer_schema

    ranges = [(r["start_ns"], r["end_ns"]) for r in plan.orderBy("ordinal").collect()]
    digest = slices.plan_digest("d", "r", "events", JAN_1, FEB_1, ranges=ranges)
    exports.write_manifest(spark, parts, infer_schema(found), spec, digest, directory + "/manifest.json")
    if packages.verify_manifest(packages.read_manifest(spark, directory + "/manifest.json"), plan, spec, digest).count():
        raise ValueError("the manifest differs from the plan")
    good, _ = packages.read_export_package(spark, directory)
    return good.select("canonical_lp")


@query(
    "plan_restart",
    """
    SELECT o_orderkey AS ordinal, CASE WHEN o_orderstatus = 'P' THEN 'WRITE'
        WHEN o_orderpriority = '1-URGENT' THEN 'REDO'
        WHEN o_orderpriority = '2-HIGH' THEN 'BLOCK'
        WHEN o_orderpriority = '3-MEDIUM' THEN 'REDO' ELSE 'REUSE' END AS action
    FROM orders
    """,
)
def plan_restart(spark, sf):
    o = table(spark, sf, "orders")
    plan = o.select(
        F.col("o_orderkey").alias("ordinal"), identity.fragment_id(F.lit(JOB), F.col("o_orderkey")).alias("fragment_id"),
        F.concat(F.lit("data-"), F.col("o_orderkey"), F.lit(".lp.gz")).alias("file"), "o_orderstatus", "o_orderpriority", "o_custkey",
    )
    priority = F.col("o_orderpriority")
    known = plan.where(F.col("o_orderstatus") != "P").select(
        "fragment_id",
        F.when(priority == "1-URGENT", "CORRUPT").when(priority == "2-HIGH", "FINALIZING").otherwise("COMPLETE").alias("state"),
        F.col("o_custkey").alias("compressed_size"), F.col("o_custkey").alias("uncompressed_size"),
        F.sha2(F.col("file"), 256).alias("sha256"),
    )
    verdicts = plan.select(
        "file", F.lit(True).alias("valid"),
        F.when(priority == "3-MEDIUM", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("compressed_size"),
        F.col("o_custkey").alias("uncompressed_size"), F.sha2(F.col("file"), 256).alias("sha256"),
    )
    return packages.plan_restart(plan.select("ordinal", "fragment_id", "file"), known, verdicts).select("ordinal", "action")


@query(
    "reconcile_statements",
    """
    WITH c AS (SELECT conv_id, turn, turn // 2 AS id, turn % 2 = 0 AS partial, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS source_file, count(*) AS chunk_count,
           CASE WHEN max(last) >= 6 THEN 'FAILED_PROTOCOL'
                WHEN max(last) % 2 = 0 THEN 'FAILED_INCOMPLETE_RESPONSE'
                WHEN max(last) // 2 < 2 THEN 'FAILED_PROTOCOL' END AS code
    FROM c GROUP BY conv_id
    """,
)
def reconcile_statements(spark, sf):
    chunks = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("chunk_no"),
        F.lit(None).cast("string").alias("code"), F.floor(F.col("turn") / 2).cast("bigint").alias("statement_id"),
        (F.pmod("turn", F.lit(2)) == 0).alias("partial"),
    )
    return responses.reconcile_statements(chunks, 3)


ANSWERS = 32  # files; each holds many hosts and is read in ranges


@query(
    "query_responses",
    f"""
    SELECT CAST(user_id AS VARCHAR) AS host, row_number() OVER (PARTITION BY user_id ORDER BY time_ns, event_id) - 1 AS row_index,
           CAST(time_ns AS VARCHAR) AS time, 'uint64' AS id_kind, CAST(event_id AS VARCHAR) AS id, 'numeric_text' AS value_kind,
           CAST(value AS VARCHAR) || 'e0' AS value, event_type AS type,
           CASE user_id % {ANSWERS} WHEN 3 THEN 'FAILED_INCOMPLETE_RESPONSE' WHEN 5 THEN 'FAILED_PROTOCOL' WHEN 7 THEN 'FAILED_SERVER'
               WHEN 9 THEN 'FAILED_PROTOCOL' END AS answer
    FROM {E}
    """,
)
def query_responses(spark, sf):
    """Answers written as files of chunk objects, closed, unfinished or broken, then decoded with exact number tokens and judged."""
    path = shared_dir(spark, "responses")
    e = table(spark, sf, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    row = F.concat(F.lit("["), ns, F.lit(","), F.col("event_id"), F.lit(","), F.col("value").cast("string"), F.lit('e0,"'), F.col("event_type"), F.lit('"]'))
    keyed = e.select(F.col("user_id").alias("host"), ns.alias("t"), "event_id", row.alias("r"))
    numbered = results.number_rows(keyed, ["host"], ["t", "event_id"])
    # A chunk holds at most 50 rows of one series.
    chunked = numbered.withColumn("chunk", F.floor(F.col("row_index") / 50)).groupBy("host", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "r"))), lambda x: x["r"]), ",").alias("rows")
    )
    body = F.concat(
        F.lit('{"results":[{"statement_id":0,"partial":true,"series":[{"name":"events","tags":{"host":"'), "host",
        F.lit('"},"columns":["time","id","value","type"],"values":['), "rows", F.lit("]}]}]}"),
    )
    file = F.pmod("host", F.lit(ANSWERS)).cast("int")
    chunks = chunked.select(file.alias("file"), F.lit(0).alias("last"), "host", "chunk", body.alias("value"))
    # What ends each file: nothing, a statement that was not asked for, an error, half a chunk, or the proper end.
    closing = F.when(F.col("file") == 5, '{"results":[{"statement_id":1}]}').when(F.col("file") == 7, '{"error":"engine \\"}{\\" stopped"}').when(
        F.col("file") == 9, '{"results":[{"statement_id":0}]').otherwise('{"results":[{"statement_id":0}]}')
    ends = chunks.select("file").distinct().where("file <> 3").select(
        "file", F.lit(1).alias("last"), F.lit(None).cast("long").alias("host"), F.lit(None).cast("long").alias("chunk"), closing.alias("value"))
    place = ["file", "last", "host", "chunk"]
    chunks.unionByName(ends).repartition("file").sortWithinPartitions(*place).select("file", "value").write.partitionBy("file").text(path)
    kinds = spark.createDataFrame([("events", "id", "uint64")], "measurement string, field string, kind string")
    rows, verdicts = responses.read_query_responses(spark, path, 1, schema=kinds)
    c = F.col("cells")
    flat = rows.select(
        F.try_element_at("tags", F.lit("host")).alias("host"), "source_file", "row_index", c[0]["decimal_text"].alias("time"),
        c[1]["kind"].alias("id_kind"), c[1]["decimal_text"].alias("id"), c[2]["kind"].alias("value_kind"),
        c[2]["decimal_text"].alias("value"), c[3]["string_value"].alias("type"),
    )
    return flat.join(verdicts.select("source_file", F.col("code").alias("answer")), "source_file", "left").drop("source_file")


@query(
    "schema_responses",
    """
    WITH t AS (SELECT DISTINCT o_orderpriority AS measurement, 's' || o_orderstatus AS name FROM orders),
    f AS (SELECT DISTINCT o_orderpriority AS measurement, 'y' || year(o_orderdate) AS name,
          CASE WHEN o_orderpriority = '5-LOW' AND year(o_orderdate) = 1994 THEN o_orderstatus ELSE CAST(year(o_orderdate) % 5 AS VARCHAR) END AS k FROM orders),
    g AS (SELECT measurement, name, max(CASE k WHEN '0' THEN 'float64' WHEN '1' THEN 'int64' WHEN '2' THEN 'uint64' WHEN '3' THEN 'string' WHEN '4' THEN 'boolean'
          WHEN 'F' THEN 'int64' WHEN 'O' THEN 'string' END) AS kind, bool_or(k = 'P') OR count(DISTINCT k) > 1 AS bad FROM f GROUP BY measurement, name)
    SELECT measurement, name, 'tag' AS role, CAST(NULL AS VARCHAR) AS kind, CASE WHEN measurement = '4-NOT SPECIFIED' THEN 'SCHEMA_DRIFT' END AS code FROM t
    UNION ALL SELECT measurement, name, 'field', kind, CASE WHEN bad THEN 'SCHEMA_DRIFT' END FROM g
    """,
)
def schema_responses(spark, sf):
    """Tag-key and field-key answers, one file a measurement and kind, read back as a schema. One measurement's tag answer is not finished,
    one field comes with several types or an unknown one."""
    path = shared_dir(spark, "schema-responses")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), "o_orderstatus", F.year("o_orderdate").alias("year"))
    odd = (F.col("name") == "5-LOW") & (F.col("year") == 1994)
    types = F.array(*map(F.lit, ["float", "integer", "unsigned", "string", "boolean"]))
    kind = F.when(odd, F.expr("element_at(map('F', 'integer', 'O', 'string', 'P', 'complex'), o_orderstatus)")).otherwise(F.get(types, F.col("year") % 5))
    tags = o.select("name", F.array(F.concat(F.lit("s"), "o_orderstatus")).alias("row"), F.array(F.lit("tagKey")).alias("columns"))
    fields = o.select("name", F.array(F.concat(F.lit("y"), F.col("year").cast("string")), kind).alias("row"),
                      F.array(F.lit("fieldKey"), F.lit("fieldType")).alias("columns"))
    answer = tags.union(fields).groupBy("name", "columns").agg(F.collect_set("row").alias("values"))
    unfinished = (F.col("name") == "4-NOT SPECIFIED") & (F.size("columns") == 1)
    series = F.array(F.struct("name", "columns", "values"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("statement_id"), unfinished.alias("partial"), series.alias("series"))).alias("results")))
    file = F.concat(F.substring("name", 1, 1), F.size("columns").cast("string"))
    answer.select(file.alias("file"), body.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return responses.read_schema_responses(spark, path, 1)


@query("line_protocol_gz", f"SELECT {EVENT_LINE} AS canonical_lp FROM {E}")
def line_protocol_gz(spark, sf):
    """Points written as gzip files, checked and read back."""
    path = shared_dir(spark, "lp-gz")
    event_points(spark, sf).select("canonical_lp").write.option("compression", "gzip").text(path)
    good, _ = line_protocol.read_line_protocol_gz(spark, path)
    return good.select("canonical_lp")


@query(
    "exact_csv_files",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS key, '  ' || o_orderpriority || ' "q",' || chr(10) || 'x  ' AS text, CASE o_orderstatus WHEN 'P' THEN '' ELSE '\\.' END AS mark,
           CAST(o_custkey AS VARCHAR) AS number FROM orders
    """,
)
def exact_csv_files(spark, sf):
    """Awkward cells written exactly and read back by Spark's own reader."""
    path = shared_dir(spark, "csv")
    o = table(spark, sf, "orders")
    exports.write_exact_csv(o.select(
        F.col("o_orderkey").alias("key"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit(' "q",\nx  ')).alias("text"),
        F.when(F.col("o_orderstatus") != "P", F.lit("\\.")).alias("mark"), F.col("o_custkey").alias("number"),
    ), path)
    back = spark.read.schema("key string, text string, mark string, number string").option("multiLine", True).option(
        "quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    # One header for all parts.
    return back.where("key <> 'key'").select("key", "text", F.coalesce("mark", F.lit("")).alias("mark"), "number")


@query(
    "mapped_csv_files",
    f"""
    SELECT 'orders,o_orderpriority=' || replace(o_orderpriority, ' ', '\\ ') || ' note="' || o_orderstatus || ', ok",o_custkey=' || o_custkey || 'i,o_totalprice='
           || {num("o_totalprice")} || ' ' || epoch_us(o_orderdate) * 1000 AS canonical_lp, 1 AS n
    FROM orders WHERE o_orderstatus = 'O' OR o_orderkey % 2 = 0
    UNION ALL SELECT 'rejected', count(*) FROM orders WHERE NOT (o_orderstatus = 'O' OR o_orderkey % 2 = 0)
    UNION ALL SELECT 'large record on line 2', 15 + sum(strlen(epoch_us(o_orderdate) * 1000 || ',"O, ok",' || CAST(o_totalprice AS VARCHAR) || ',' || o_orderpriority
              || ',' || o_custkey) + 1) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority
    """,
)
def mapped_csv_files(spark, sf):
    """Orders in files of two column orders. Odd orders that are not open carry a line break or a bare pair of quotes.

    Open orders also stand in files whose first record opens a quote by mistake, which makes one record of the rest of the file.
    """
    path = shared_dir(spark, "orders-csv")
    o = table(spark, sf, "orders").withColumn("ns", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string"))
    spoiled = (F.col("o_orderstatus") != "O") & (F.pmod("o_orderkey", F.lit(2)) == 1)
    note = F.concat("o_orderstatus", F.lit(", ok"), F.when(spoiled & (F.col("o_orderstatus") == "F"), F.lit("\nnext")).otherwise(F.lit("")))
    cells = {"ns": F.col("ns"), "note": note, "price": F.col("o_totalprice").cast("string"), "prio": F.col("o_orderpriority"),
             "cust": F.concat(F.col("o_custkey").cast("string"), F.when(spoiled & (F.col("o_orderstatus") == "P"), F.lit('""')).otherwise(F.lit("")))}
    for k, order in enumerate((["ns", "note", "price", "prio", "cust"], ["cust", "prio", "ns", "price", "note"])):
        rows = o.where(F.pmod(F.floor(F.col("o_orderkey") / 2), F.lit(2)) == k)
        # The customer cell is written as it stands, so its quotes are bare.
        record = F.concat_ws(",", *[cells[c] if c == "cust" else exports.csv_record([cells[c]]) for c in order])
        # The first row of each part file brings the header.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        numbered = rows.select(record.alias("value"), first.alias("first"))
        lines_ = F.when(F.col("first"), F.array(F.lit(",".join(order)), "value")).otherwise(F.array("value"))
        numbered.select(F.explode(lines_).alias("value")).write.text(f"{path}/{k}")
    mapping = mapped_csv.CsvMapping(
        timestamp_column="ns", static_measurement="orders", tag_columns={"prio": "o_orderpriority"},
        field_columns={"cust": ("o_custkey", "int64"), "price": ("o_totalprice", "float64"), "note": ("note", "string")},
    )
    opened = o.where("o_orderstatus = 'O'").select("o_orderpriority", F.lit(2).alias("place"), F.concat_ws(
        ",", *[cells[c] if c == "cust" else exports.csv_record([cells[c]]) for c in ("ns", "note", "price", "prio", "cust")]).alias("value"))
    heads = opened.select("o_orderpriority").distinct()
    for place, line in enumerate(("ns,note,price,prio,cust", '0,"open,1,high')):
        opened = opened.unionByName(heads.select("o_orderpriority", F.lit(place).alias("place"), F.lit(line).alias("value")))
    opened.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "place").drop("place").write.partitionBy("o_orderpriority").text(f"{path}/2")
    good, rejects = mapped_csv.read_mapped_csv(spark, [f"{path}/0", f"{path}/1", f"{path}/2/*"], mapping, limit=1024)
    large = F.col("code") == "POINT_TOO_LARGE"
    lost = rejects.where(~large).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("canonical_lp"), "n")
    named = rejects.where(large).select(F.concat(F.lit("large record on line "), "line_no").alias("canonical_lp"), F.col("size").alias("n"))
    return good.select("canonical_lp", F.lit(1).cast("bigint").alias("n")).unionByName(lost).unionByName(named)
