"""Answer decoding, pages, CSV and chart rules."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tidepoint.functions import identity, numbers, points, text
from tidepoint.model import RejectedInput
from tidepoint.operators import aggregate, chart, results, schema, select
from tidepoint.sinks import exports
from tidepoint.sources import responses


def chunk(**result):
    return json.dumps({"results": [result]})


def decode(spark, tmp_path, wires, statements=2, **kw):
    for name, wire in wires.items():
        (tmp_path / f"{name}.json").write_text(wire)
    rows, verdicts = responses.read_query_responses(spark, str(tmp_path), statements, **kw)
    return rows, {r["source_file"].split("/")[-1][:-5]: r["code"] for r in verdicts.collect()}


def test_statement_reconciliation(spark, tmp_path):
    series = {"name": "cpu", "columns": ["time", "value"], "values": [[1]]}
    wires = {
        "empty": "", "missing": "{}", "two": '{"results":[{"statement_id":0},{"statement_id":1}]}', "first": chunk(statement_id=1),
        "partial": chunk(statement_id=0, partial=True), "closed": chunk(statement_id=0) + "\n" + chunk(statement_id=0),
        "top": '{"error":"database not found"}', "width": chunk(statement_id=0, series=[series]),
        "error": chunk(statement_id=0, error="bad field") + "\n" + chunk(statement_id=1), "no_newline": chunk(statement_id=0) + chunk(statement_id=1),
        "unfinished": chunk(statement_id=0, partial=True) + chunk(statement_id=1), "half": chunk(statement_id=0)[:-2],
        "error_data": chunk(statement_id=0, error="x", partial=True), "list": "[1]",
    }
    _, codes = decode(spark, tmp_path, wires)
    assert codes == {
        "empty": "FAILED_EMPTY_RESPONSE", "missing": "FAILED_PROTOCOL", "two": "FAILED_PROTOCOL", "first": "FAILED_PROTOCOL",
        "partial": "FAILED_INCOMPLETE_RESPONSE", "closed": "FAILED_PROTOCOL", "top": "FAILED_SERVER", "width": "FAILED_PROTOCOL",
        "error": None, "no_newline": None, "unfinished": "FAILED_INCOMPLETE_RESPONSE", "half": "FAILED_PROTOCOL",
        "error_data": "FAILED_PROTOCOL", "list": "FAILED_PROTOCOL",
    }


def test_exact_tokens_and_kinds(spark, tmp_path):
    head = '{"results":[{"statement_id":0,"partial":%s,"series":[{"name":"cpu","tags":{"host":"a"},"columns":["time","signed","unsigned","ratio","unknown"],"values":[%s]}]}]}'
    wire = (head % ("true", '[1,-9007199254740993,18446744073709551615,0.10000000000000001,1e20]')
            + head % ("false", '[2,7,8,-0.0,"a }{ b"]'))
    kinds = spark.createDataFrame([("cpu", "signed", "int64"), ("cpu", "unsigned", "uint64"), ("cpu", "ratio", "float64")],
                                  "measurement string, field string, kind string")
    rows, codes = decode(spark, tmp_path, {"a": wire}, 1, schema=kinds)
    assert codes == {"a": None}
    out = rows.orderBy("row_index").collect()
    assert [r["row_index"] for r in out] == [0, 1] and len({r["series_id"] for r in out}) == 1
    assert [(c["kind"], c["decimal_text"] or c["string_value"]) for c in out[0]["cells"]] == [
        ("timestamp_ns", "1"), ("int64", "-9007199254740993"), ("uint64", "18446744073709551615"),
        ("float64", "0.10000000000000001"), ("numeric_text", "1e20")]
    assert [(c["kind"], c["decimal_text"] or c["string_value"]) for c in out[1]["cells"]][3:] == [("float64", "-0.0"), ("string", "a }{ b")]
    assert out[0]["series_id"] == identity.series_id_of(0, "cpu", {"host": "a"})
    wrong = spark.createDataFrame([("cpu", "unsigned", "int64")], "measurement string, field string, kind string")
    rows, _ = responses.read_query_responses(spark, str(tmp_path), 1, schema=wrong)
    assert {r["row_index"]: r["code"] for r in rows.collect()}[0] == "FAILED_PROTOCOL"
    _, codes = decode(spark, tmp_path, {"b": chunk(statement_id=0) + " " * 200}, 1, limit=64)
    assert codes["a"] == "FAILED_RESPONSE_TOO_LARGE"


def test_schema_answers(spark, tmp_path):
    tags = {"name": "cpu", "columns": ["tagKey"], "values": [["host"], ["zone"]]}
    fields = {"name": "cpu", "columns": ["fieldKey", "fieldType"], "values": [["v", "float"], ["n", "unsigned"], ["odd", "complex"]]}
    (tmp_path / "a.json").write_text(chunk(statement_id=0, series=[tags]) + chunk(statement_id=1, series=[fields]))
    got = {(r["name"], r["role"]): (r["kind"], r["code"]) for r in responses.read_schema_responses(spark, str(tmp_path)).collect()}
    assert got == {("host", "tag"): (None, None), ("zone", "tag"): (None, None), ("v", "field"): ("float64", None),
                   ("n", "field"): ("uint64", None), ("odd", "field"): (None, "SCHEMA_DRIFT")}


def test_series_id_boundaries(spark):
    assert identity.series_id_of(0, "cpu", {"host": "a", "zone": "b"}) == identity.series_id_of(0, "cpu", {"zone": "b", "host": "a"})
    assert identity.series_id_of(0, "cpu", {"host": "a"}) != identity.series_id_of(0, "cpuhost", {"": "a"})
    got = spark.range(1).select(
        identity.series_id(F.lit(0), F.lit("cpu"), F.create_map(F.lit("zone"), F.lit("b"), F.lit("host"), F.lit("a"))),
        identity.series_id(F.lit(0), F.lit("cpu"), F.create_map().cast("map<string,string>"))).first()
    assert list(got) == [identity.series_id_of(0, "cpu", {"host": "a", "zone": "b"}), identity.series_id_of(0, "cpu", {})]


def test_row_numbers_do_not_depend_on_partitions(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 997, i) for i in range(1000)]
    expected = {}
    for k, t, i in sorted(rows):
        expected[i] = sum(1 for k2, t2, i2 in rows if k2 == k and (t2, i2) < (t, i))
    for parts in (1, 4, 16):
        df = spark.createDataFrame(rows, "k string, t bigint, i bigint").repartition(parts)
        out = results.number_rows(df, ["k"], ["t", "i"])
        assert {r["i"]: r["row_index"] for r in out.collect()} == expected


def test_truncation_borders(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "arrival bigint, t string")
    size = F.octet_length("t").cast("bigint")

    def run(**limits):
        kept, verdict = results.truncate_result(df, size=size, **limits)
        return sorted(r["arrival"] for r in kept.collect()), verdict.first()["truncated"]

    assert run() == (list(range(10)), False)
    assert run(max_rows=10) == (list(range(10)), True)
    assert run(max_rows=4) == ([0, 1, 2, 3], True)
    assert run(max_bytes=100) == (list(range(10)), True)
    assert run(max_bytes=39) == ([0, 1, 2], True)


def test_selection_and_pages(spark):
    df = spark.createDataFrame([(0, "s", i) for i in range(20)], "statement_id int, series_id string, row_index bigint")
    assert [r["row_index"] for r in results.page_series(df, 0, "s", 18, 5).collect()] == [18, 19]
    with pytest.raises(RejectedInput):
        results.page_series(df, 0, "s", 0, 5001)
    assert select.select_rows(df, [3, 1]).count() == 2
    for bad in ([1, 1], [20], []):
        with pytest.raises(RejectedInput):
            select.select_rows(df, bad)


def test_result_csv_document(spark, tmp_path):
    def row(i, *cells):
        return spark.range(1).select(F.lit(i).cast("bigint").alias("row_index"), F.array(*cells).alias("cells"))

    t = points.scalar("timestamp_ns", F.lit("1700000015123456788"))
    df = row(0, t, points.scalar("string", string_value=F.lit("=1+1")), points.scalar("int64", F.lit("-42"))).unionByName(
        row(1, points.null_scalar(), points.scalar("string", string_value=F.lit('a,"b"\nc')), points.scalar("boolean", bool_value=F.lit(True))))
    exports.write_result_csv(df, ["time", "=host", "value"], str(tmp_path / "out"), 480, single_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().decode() == (
        "\N{ZERO WIDTH NO-BREAK SPACE}time,'=host,value\r\n2023-11-15 06:13:35.123456788,'=1+1,-42\r\n,\"a,\"\"b\"\"\r\nc\",true\r\n")
    exports.write_result_csv(df, ["time", "=host", "value"], str(tmp_path / "parts"), 480)
    joined = b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert joined == part.read_bytes()


def test_exact_csv_and_typed_json(spark, tmp_path):
    df = spark.createDataFrame([(9007199254740993, 'x,"y"', None)], "a bigint, b string, c string")
    exports.write_exact_csv(df.coalesce(1), str(tmp_path / "csv"))
    document = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    rows = list(csv.reader(io.StringIO(document)))
    assert rows == [["a", "b", "c"], ["9007199254740993", 'x,"y"', ""]]
    cells = F.array(points.scalar("uint64", F.lit("18446744073709551615")), points.null_scalar(),
                    points.scalar("string", string_value=F.lit('q"<\n')), points.scalar("boolean", bool_value=F.lit(False)))
    out = spark.range(1).select(F.array(*map(F.lit, ["z", "b", "a", "c"])).alias("columns"), cells.alias("cells"))
    line = out.select(exports.typed_json(F.col("columns"), F.col("cells"))).first()[0]
    assert line == r'{"a":{"kind":"string","value":"q\"<\n"},"b":{"kind":"null"},"c":{"kind":"boolean","value":false},"z":{"kind":"uint64","decimalText":"18446744073709551615"}}'


@pytest.mark.parametrize("ns,offset,shown", [
    ("-1", 0, "1969-12-31 23:59:59.999999999"), ("0", 0, "1970-01-01 00:00:00"), ("1700000000120000000", 480, "2023-11-15 06:13:20.12"),
    ("9223372036854775807", 0, "2262-04-11 23:47:16.854775807"), ("-9223372036854775808", 0, "1677-09-21 00:12:43.145224192"),
    ("bad", 0, "bad"), ("99999999999999999999", 0, "99999999999999999999"),
])
def test_timestamps(spark, ns, offset, shown):
    assert spark.range(1).select(text.format_time_text(F.lit(ns), offset)).first()[0] == shown


def test_decimals(spark):
    cases = {"0": "1", "9": "10", "199": "200", "18446744073709551615": "18446744073709551616", "9" * 30: "1" + "0" * 30}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", numbers.increment_decimal(F.col("s"))).collect()} == cases
    df = spark.createDataFrame([("18446744073709551616", "9999999999999999999", 1), ("2", "10", -1), ("7", "7", 0)], "a string, b string, c int")
    assert all(r[0] == r[1] for r in df.select("c", numbers.compare_decimal(F.col("a"), F.col("b"))).collect())


XY = [("x", "timestamp_ns"), ("y", "uint64")]


def project(spark, rows, columns=XY, approx=False):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string")
    v = chart.chart_verdict(df, columns, approx).first()
    return v, [(r["x"], r["y"]) for r in chart.project_chart(df, columns, approx, ["i"]).orderBy("i").collect()]


def test_chart(spark):
    safe = 2**53 - 1
    v, out = project(spark, [(f"170000000000000000{i}", str(9007199254740991 + i)) for i in (1, 2, 3)])
    assert v["status"] == "exact" and out == [(-1.0, -1.0), (0.0, 0.0), (1.0, 1.0)] and str(v["y_origin"]) == "9007199254740993"
    assert project(spark, [("0", "0"), (str(2 * safe), "1")])[0]["status"] == "exact"
    v, out = project(spark, [("0", "0"), (str(2 * safe + 1), "1")])
    assert (v["status"], v["reason"], v["approximate_available"], out) == ("blocked", "UNSAFE_X_DELTA", True, [])
    assert project(spark, [("0", "0"), (str(2 * safe + 1), "1")], approx=True)[0]["status"] == "approximate"
    v, out = project(spark, [("1", "0"), ("2", None)])
    assert v["status"] == "exact" and out[1][1] is None
    assert project(spark, [("1", "01")])[0]["reason"] == "INVALID_Y_VALUE"
    assert project(spark, [("1", None)])[0]["reason"] == "INVALID_Y_VALUE"
    floats = [("x", "timestamp_ns"), ("y", "float64")]
    assert project(spark, [("1", "1e999")], floats, True)[0]["reason"] == "INVALID_Y_VALUE"
    assert project(spark, [("1", "1.5")], floats)[0]["status"] == "exact"
    textual = [("x", "timestamp_ns"), ("y", "numeric_text")]
    assert project(spark, [("1", "1")], textual)[0]["reason"] == "UNSAFE_Y_DELTA"
    assert project(spark, [("1", "1")], textual, True)[0]["status"] == "approximate"
    assert project(spark, [("1", "1")], [("x", "string"), ("y", "int64")])[0]["reason"] == "NO_NUMERIC_AXES"


def test_sort_and_aggregates(spark):
    df = spark.createDataFrame([("10",), ("9",), (None,), ("18446744073709551615",)], "v string")
    assert [r[0] for r in results.sort_result(df, "v", "uint64").collect()] == [None, "9", "10", "18446744073709551615"]
    assert [r[0] for r in results.sort_result(df, "v", "uint64", True).collect()][-1] is None
    with pytest.raises(RejectedInput):
        aggregate.aggregate(df, "mean", "v")
    assert aggregate.aggregate(df, "count", "v").first()[0] == 3


def test_fill_null_covers_the_range(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("a", 30, 2.0), ("b", 0, 3.0)], "k string, bucket_ns bigint, v double")
    out = sorted((r["k"], r["bucket_ns"], r["v"]) for r in aggregate.fill_null(df, 0, 41, 10, ["k"]).collect())
    assert out == [("a", 0, None), ("a", 10, 1.0), ("a", 20, None), ("a", 30, 2.0), ("a", 40, None),
                   ("b", 0, 3.0), ("b", 10, None), ("b", 20, None), ("b", 30, None), ("b", 40, None)]
    wide = spark.createDataFrame([("a", 50_000, 1.0)], "k string, bucket_ns bigint, v double")
    got = aggregate.fill_null(wide, 0, 100_000, 10, ["k"])
    assert got.count() == 10_000 and got.select("bucket_ns").distinct().count() == 10_000


def test_schema_conflicts(spark):
    from tidepoint.sources.line_protocol import parse_line_protocol

    lines = ["m,t=a v=1i 1", "m,t=a v=1 2", "m,v=a w=1 3", "n,t=a v=1i 4"]
    p = parse_line_protocol(spark.createDataFrame([(l,) for l in lines], "raw string"))
    got = {(r["measurement"], r["name"]): (r["role"], r["kind"], r["code"]) for r in schema.infer_schema(p).collect()}
    assert got[("m", "v")] == ("field|tag", "float64|int64", "TAG_FIELD_CONFLICT")
    assert got[("n", "v")] == ("field", "int64", None) and got[("m", "t")] == ("tag", "string", None)
