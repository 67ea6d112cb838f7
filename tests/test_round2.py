"""Ties, roles, escapes, exact CSV, replies, and the plans of scans and joins."""

import json

import pytest
from pyspark.sql import functions as F

from tidepoint.catalog import reads
from tidepoint.functions import identity, text
from tidepoint.operators import mutate, schema, select
from tidepoint.plans import events, transfers
from tidepoint.sinks import exports
from tidepoint.sources import line_protocol, responses, write_replies

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_arrivals_have_one_owner(spark):
    rows = spark.createDataFrame([("s", "d", "b", 1), ("s", "d", "a", 1), ("s", "e", "c", 1)], "scope string, request_digest string, resource_id string, arrival int")
    ledger = spark.createDataFrame([], "scope string, request_digest string, resource_id string")
    got = {r["resource_id"]: (r["decision"], r["owner_id"]) for r in transfers.admit_once(rows, ledger).collect()}
    assert got == {"a": ("NEW", "a"), "b": ("REPLAY", "a"), "c": ("CONFLICT", None)}


def test_a_name_used_both_ways_is_a_conflict(spark):
    points, _ = line_protocol.parse_line_protocol(
        spark.createDataFrame([("m,host=a v=1i 1",), ("m v=1i,host=2i 2",)], "raw string")), None
    found = schema.infer_schema(points)
    assert {r["name"]: r["code"] for r in found.collect()}["host"] == "TAG_FIELD_CONFLICT"
    assert {r["code"] for r in schema.validate_points(points, found, 0, 10).collect()} == {"TAG_FIELD_CONFLICT"}


def test_json_escapes_are_lower_case(spark):
    raw = "".join(map(chr, range(32))) + "\\u001F\\\x1f  "
    df = spark.createDataFrame([(raw,)], "c string")
    shown = df.select(text.standard_json(F.to_json(F.struct("c"))).alias("j")).first()["j"]
    assert json.loads(shown)["c"] == raw
    assert "\\u001f" in shown and "\\u000b" in shown and " " not in shown and "\\\\u001F" in shown and "\\\\\\u001f" in shown
    want = '{"schemaVersion":1,"database":"\\u001f\\u2028","retentionPolicy":""}'
    import hashlib

    digest = df.select(identity.target_digest(F.lit("\x1f "), F.lit(None).cast("string")).alias("d")).first()["d"]
    assert digest == hashlib.sha256(want.encode()).hexdigest()


def test_exact_csv_parts_form_one_document(spark, tmp_path):
    df = spark.createDataFrame([("  lead", "a"), ("trail  ", None), ("\\.", 'q"q'), ("x\ny", "z,")], "one string, two string").repartition(2)
    exports.write_exact_csv(df, str(tmp_path / "csv"))
    document = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert document.startswith("one,two\n") and document.count("one,two") == 1
    assert set(document[8:].replace("x\ny", "x|y").splitlines()) == {'"  lead",a', "trail  ,", '"\\.","q""q"', '"x|y","z,"'}


def test_a_bad_row_fails_its_answer(spark, tmp_path):
    def answer(value):
        return json.dumps({"results": [{"statement_id": 0, "series": [{"name": "m", "columns": ["time", "v"], "values": [[1, 2]]}]}]}).replace("2]]", value + "]]")

    for name, value in (("good", "2"), ("bad", "99999999999999999999")):
        (tmp_path / f"{name}.json").write_text(answer(value))
    kinds = spark.createDataFrame([("m", "v", "int64")], "measurement string, field string, kind string")
    _, verdicts = responses.read_query_responses(spark, str(tmp_path), 1, schema=kinds)
    assert {r["source_file"].rsplit("/", 1)[1]: r["code"] is None for r in verdicts.collect()} == {"good.json": True, "bad.json": False}


def test_captured_replies(spark, tmp_path):
    replies = [
        {"batch_id": "1", "status": 204, "body": "", "contentLength": 0}, {"batch_id": "2", "status": 400, "body": '{"error":"partial write: x"}'},
        {"batch_id": "3", "status": 413, "body": "{}"}, {"batch_id": "4", "status": 400, "body": '{"a":[{"Partial":1}]}'},
        {"batch_id": "5", "status": 401, "body": '{"error":null,"deep":[{"ERROR":"no"}]}'}, {"batch_id": "6", "status": 200, "body": "NaN"}, {"batch_id": "7"},
        {"batch_id": "8", "status": 400, "body": "[1]"}, {"batch_id": "9", "status": 400, "body": '{"x":NaN}'},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, replies)) + "\nbroken\n")
    got = {r["batch_id"]: r["outcome"] for r in write_replies.read_write_responses(spark, str(tmp_path)).collect()}
    assert got == {"1": "ACKED", "2": "PARTIAL", "3": "REJECTED_TOO_LARGE", "4": "UNKNOWN", "5": "REJECTED", "6": "UNKNOWN",
                   "7": "UNKNOWN", "8": "UNKNOWN", "9": "UNKNOWN", None: "UNKNOWN"}


def test_limits_are_not_bent(spark):
    jobs = spark.createDataFrame([], "job_id string, retained boolean, state string, profile_id string, created_at long")
    log = spark.createDataFrame([], "seq string")
    for call in (lambda: select.list_recoverable_jobs(jobs, limit=501), lambda: events.read_task_events(log, "0", 1001)):
        with pytest.raises(ValueError):
            call()


def test_good_lines_are_neither_joined_nor_shuffled(spark, tmp_path):
    (tmp_path / "a.lp").write_text("m v=1i 1\nbroken\n")
    good, _ = line_protocol.read_line_protocol(spark, str(tmp_path))
    assert "Join" not in plan(good) and "Exchange" not in plan(good)


def test_listings_and_deletes_read_what_they_need(spark):
    shown = plan(reads.aggregate.cardinality(reads.event_keys(spark, SF), "series"))
    assert "ReadSchema: struct<event_type:string>" in shown
    path = reads._stored_events(spark, SF)
    shown = plan(mutate.drop_measurement(spark, path, "view"))
    assert "PartitionFilters: [isnotnull(measurement" in shown


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_frames_do_not_depend_on_blocks(step):
    docs = [b'{"a":"}{\\"]"}', b'{"b":[{"c":"\\\\"},[]]}', b"{}", '{"ü":"{"}'.encode()]
    raw = b" \r\n".join(docs) + b"\n"

    class Stream:
        at = 0

        def read(self, _):
            self.at += step
            return raw[self.at - step : self.at]

    assert list(responses._frames(Stream(), 30)) == [(d, None) for d in docs]
    assert list(responses._frames(Stream(), 13))[-1] == (None, responses.TOO_LARGE)
    raw = raw[:-2]
    assert list(responses._frames(Stream(), 30))[-1] == (None, responses.PROTOCOL)
    raw = b"{} x"
    assert list(responses._frames(Stream(), 30)) == [(b"{}", None), (None, responses.PROTOCOL)]


def test_spec_digests(spark):
    import hashlib

    def digest(*args):
        return spark.range(1).select(identity.spec_digest(*args).alias("d")).first()["d"]

    head = '{"schemaVersion":1,"format":"%s","normalizationVersion":"canonical-lp-v1","adaptiveMaxPoints":"5000","adaptiveMaxBytes":"5242880"'
    assert digest("LP") == hashlib.sha256((head % "LP" + "}").encode()).hexdigest()
    csv = {"timestamp_column": "t", "static_measurement": "m", "tag_columns": {"b": "y", "a": "x"}, "field_columns": {"v": ("w", "int64")}}
    want = head % "CSV" + (',"csv":{"staticMeasurement":"m","timestampColumn":"t","tags":[{"source":"a","target":"x"},{"source":"b","target":"y"}],'
                           '"fields":[{"source":"v","target":"w","kind":"int64"}]},"numericMappings":[{"measurement":"m","field":"v","kind":"uint64"}]}')
    assert digest("CSV", csv, [("m", "v", "uint64")]) == hashlib.sha256(want.encode()).hexdigest()
