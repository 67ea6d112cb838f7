"""Settlement, incidents, recovery, admission, retention, event logs: scenario tables."""

import pytest
from pyspark.sql import functions as F

from tidepoint.functions import identity
from tidepoint.operators import aggregate, select
from tidepoint.plans import events as logs
from tidepoint.plans import transfers

RESPONSES = [
    (413, '{"error":"request too large"}', "REJECTED_TOO_LARGE"),
    (413, '{"error":"partial write: x"}', "PARTIAL"),
    (413, "not json", "UNKNOWN"),
    (400, '{"error":"partial write: field type conflict dropped=1"}', "PARTIAL"),
    (400, '{"a":[{"PARTIAL":true}]}', "PARTIAL"),
    (400, '{"partial":"yes"}', "UNKNOWN"),
    (401, '{"error":"denied"}', "REJECTED"),
    (401, '{"error":5}', "UNKNOWN"),
    (401, "", "REJECTED"),
    (503, '{"error":"unavailable"}', "UNKNOWN"),
    (204, "", "ACKED"),
    (204, "{}", "UNKNOWN"),
    (200, "", "ACKED"),
    (200, '{"results":[]}', "ACKED"),
    (200, '{"results":', "UNKNOWN"),
    (200, '{"error":"x"}', "UNKNOWN"),
    (200, '{"error":null}', "ACKED"),
    (200, "[]", "UNKNOWN"),
    (200, "{} {}", "UNKNOWN"),
    (202, "", "UNKNOWN"),
    (None, None, "UNKNOWN"),
]


def test_write_responses(spark):
    df = spark.createDataFrame([(i, s, b, 0) for i, (s, b, _) in enumerate(RESPONSES)], "i int, status int, body string, content_length bigint")
    got = {r["i"]: r["outcome"] for r in transfers.classify_write_responses(df, (200,)).collect()}
    assert got == {i: o for i, (_, _, o) in enumerate(RESPONSES)}


def settle(spark, rows, points=8, size=100):
    jobs = spark.createDataFrame([("j", 0, 0, points, 1000, size)], "job_id string, sequence bigint, logical_offset bigint, adaptive_max_points bigint, adaptive_max_bytes bigint, staging_size bigint")
    settled = spark.createDataFrame([("j", n + 1, f"b{n + 1}", *r) for n, r in enumerate(rows)], "job_id string, n bigint, batch_id string, start_offset bigint, end_offset bigint, outcome string")
    return transfers.apply_settlements(jobs, settled).first()


def test_settlements(spark):
    r = settle(spark, [(0, 40, "ACKED"), (40, 100, "ACKED")])
    assert (r["sequence"], r["logical_offset"], r["state"], r["last_settled_batch_id"]) == (2, 100, "SUCCEEDED", "b2")
    r = settle(spark, [(0, 40, "REJECTED_TOO_LARGE"), (0, 20, "ACKED"), (20, 60, "REJECTED_TOO_LARGE")])
    assert (r["sequence"], r["logical_offset"], r["adaptive_max_points"], r["adaptive_max_bytes"], r["state"]) == (3, 20, 2, 250, "RUNNING")
    r = settle(spark, [(0, 40, "ACKED"), (40, 60, "PARTIAL"), (60, 100, "ACKED")])
    assert (r["sequence"], r["logical_offset"], r["state"], r["stopped_at"]) == (1, 40, "NEEDS_PARTIAL_DECISION", 2)
    assert settle(spark, [(0, 40, "UNKNOWN")])["state"] == "NEEDS_UNKNOWN_DECISION"
    assert settle(spark, [(0, 40, "REJECTED")])["state"] == "FAILED"
    r = settle(spark, [(0, 40, "ACKED"), (50, 60, "ACKED")])
    assert (r["logical_offset"], r["state"], r["code"]) == (40, "RUNNING", "IMPORT_OFFSET_CONFLICT")
    r = settle(spark, [(0, 40, "REJECTED_TOO_LARGE")] * 3, points=2)
    assert (r["adaptive_max_points"], r["state"], r["stopped_at"]) == (1, "FAILED", 2)
    assert settle(spark, [])["state"] == "RUNNING"


def test_limit_reduction(spark):
    jobs = spark.createDataFrame([(k, 0, 7, 5000, 5242880) for k in "abc"], "job_id string, sequence bigint, logical_offset bigint, adaptive_max_points bigint, adaptive_max_bytes bigint")
    cuts = spark.createDataFrame([("a", 1), ("b", 12), ("c", 13)], "job_id string, too_large_count bigint")
    got = {r["job_id"]: (r["adaptive_max_points"], r["adaptive_max_bytes"], r["logical_offset"], r["state"]) for r in transfers.reduce_batch_limits(jobs, cuts).collect()}
    assert got == {"a": (2500, 2621440, 7, "RUNNING"), "b": (1, 1280, 7, "RUNNING"), "c": (1, 1280, 7, "FAILED")}


def test_incident_decisions(spark):
    cases = [("REPLAY_EXACT", "UNKNOWN", None), ("REPLAY_EXACT", "PARTIAL", None), ("ASSUME_COMMITTED", "UNKNOWN", None), ("ABORT", "PARTIAL", None),
             ("ACCEPT_PARTIAL", "PARTIAL", None), ("ASSUME_COMMITTED", "PARTIAL", "IMPORT_STATE_CONFLICT"), ("ACCEPT_PARTIAL", "UNKNOWN", "IMPORT_STATE_CONFLICT")]
    jobs = spark.createDataFrame([(str(i), f"NEEDS_{k}_DECISION", 3, 10, "d", False) for i, (_, k, _) in enumerate(cases)], "job_id string, state string, sequence bigint, logical_offset bigint, checkpoint_digest string, lossy boolean")
    incidents = spark.createDataFrame([(f"i{i}", str(i), k, "OPEN", "d", "b", 10, 30) for i, (_, k, _) in enumerate(cases)], "incident_id string, job_id string, kind string, status string, parent_checkpoint_digest string, batch_id string, start_offset bigint, end_offset bigint")
    decisions = spark.createDataFrame([(f"i{i}", d, "CONTINUE") for i, (d, _, _) in enumerate(cases)], "incident_id string, decision string, after_resolution string")
    got = {int(r["job_id"]): r for r in transfers.resolve_incidents(jobs, incidents, decisions).collect()}
    assert [got[i]["code"] for i in range(len(cases))] == [c for _, _, c in cases]
    assert [got[i]["logical_offset"] for i in range(5)] == [10, 10, 30, 10, 30]
    assert (got[3]["state"], got[3]["incident_status"], got[4]["lossy"], got[2]["lossy"]) == ("ABORTED", "ABORTED", True, False)
    stale = incidents.withColumn("parent_checkpoint_digest", F.lit("old"))
    assert {r["code"] for r in transfers.resolve_incidents(jobs, stale, decisions).collect()} == {"IMPORT_CHECKPOINT_CONFLICT"}


def test_recovery(spark):
    jobs = spark.createDataFrame([("a", "STAGING"), ("b", "RUNNING"), ("c", "RUNNING"), ("d", "READY")], "job_id string, state string")
    attempts = spark.createDataFrame([("b", "x", "b1", "s", "SENDING", "d", 0, 5, "p"), ("c", "y", "b1", "s", "ACKED", "d", 0, 5, "p")],
                                     "job_id string, attempt_id string, batch_id string, run_segment_id string, state string, parent_checkpoint_digest string, start_offset bigint, end_offset bigint, payload_digest string")
    states, opened = transfers.recover_imports(jobs, attempts)
    assert {r["job_id"]: (r["state"], r["code"]) for r in states.collect()} == {
        "a": ("PAUSED_RESTAGE", "RESTAGE_REQUIRED"), "b": ("NEEDS_UNKNOWN_DECISION", "UNKNOWN_ON_RESTART"),
        "c": ("PAUSED_SAFE", "LOST_ON_RESTART"), "d": ("READY", None)}
    assert [(r["job_id"], r["kind"], r["end_offset"]) for r in opened.collect()] == [("b", "UNKNOWN", 5)]


def test_admission(spark):
    ledger = spark.createDataFrame([("old", "d1", "r0")], "scope string, request_digest string, resource_id string")
    requests = spark.createDataFrame([("old", "d1", "r1", 1), ("old", "d2", "r2", 2), ("new", "d3", "r3", 4), ("new", "d3", "r4", 5), ("new", "d9", "r5", 6)],
                                     "scope string, request_digest string, resource_id string, arrival bigint")
    out = transfers.admit_once(requests, ledger)
    assert {r["arrival"]: (r["decision"], r["owner_id"]) for r in out.collect()} == {
        1: ("REPLAY", "r0"), 2: ("CONFLICT", None), 4: ("NEW", "r3"), 5: ("REPLAY", "r3"), 6: ("CONFLICT", None)}
    again = transfers.admit_once(requests, transfers.ledger_after(ledger, out))
    assert {r["decision"] for r in again.collect()} == {"REPLAY", "CONFLICT"}


def test_retention_borders(spark):
    hour = 3600 * 10**9
    ages = {"young": 24 * hour - 1, "day": 24 * hour, "late": 90 * 24 * hour - 1, "gone": 90 * 24 * hour}
    now = 10**18
    rows = [(k, "p", True, True, False, False, now - a) for k, a in ages.items()] + [("live", "p", False, True, False, False, None)]
    df = spark.createDataFrame(rows, "session_id string, profile_id string, terminal boolean, complete boolean, closed boolean, archived boolean, terminal_at_ns bigint")
    kept, purged = transfers.sweep_retention(df, now)
    assert {r["session_id"]: (r["profile_id"], r["archived"]) for r in kept.collect()} == {
        "young": ("p", False), "day": (None, True), "late": (None, True), "live": ("p", False)}
    assert [r[0] for r in purged.collect()] == ["gone"]


def test_event_sequence(spark):
    def ev(seq, log="a", version=1, rid="r"):
        return (log, version, seq, "IMPORT", rid, seq if seq.isdigit() else "1", "S")

    rows = [ev("18446744073709551614"), ev("18446744073709551615"), ev("18446744073709551616"), ev("18446744073709551619"), ev("18446744073709551616"),
            ev("05"), ev("1", "b"), ev("2", "b"), ev("3", "c"), ev("4", "c", 2), ev("5", "c", rid="")]
    df = spark.createDataFrame(rows, "log_id string, schema_version int, seq string, kind string, resource_id string, resource_revision string, state string").repartition(4)
    got = {(r["log_id"], r["seq"], r["problem"]) for r in logs.verify_event_sequence(df).collect()}
    assert got == {("a", "18446744073709551617", "GAP"), ("a", "18446744073709551616", "DUPLICATE"), ("a", "05", "INVALID"), ("c", "4", "INVALID"), ("c", "5", "INVALID")}
    after = spark.createDataFrame([("b", "0"), ("c", "0")], "log_id string, seq string")
    got = {(r["log_id"], r["seq"], r["problem"]) for r in logs.verify_event_sequence(df, after).collect()}
    assert ("c", "1", "GAP") in got and not any(g[0] == "b" for g in got)
    page = logs.read_task_events(df.where("log_id = 'a' and seq != '05'"), "18446744073709551615", 2).collect()
    assert [r["seq"] for r in page] == ["18446744073709551616", "18446744073709551616"]


def chain(spark, rows):
    """rows: (sequence, offset, points, bytes) -> chained checkpoints with real digests."""
    out, parent = [], None
    for seq, offset, pts, size in rows:
        cols = dict(job_id="j", sequence=str(seq), parent_digest=parent, logical_offset=str(offset), last_settled_batch_id="b", last_disposition="ACKED",
                    adaptive_max_points=str(pts), adaptive_max_bytes=str(size), source_sha256="s", staging_sha256="t", normalization_version="v",
                    spec_digest="p", target_digest="q", lossy=False)
        schema = ", ".join(f"{k} {'boolean' if k == 'lossy' else 'string'}" for k in cols)
        parent = spark.createDataFrame([tuple(cols.values())], schema).select(identity.checkpoint_digest()).first()[0]
        out.append((*cols.values(), parent))
    return spark.createDataFrame(out, schema + ", digest string")


def test_checkpoint_chain(spark):
    c = chain(spark, [(0, 0, 10, 100), (1, 40, 10, 100), (2, 40, 5, 50), (3, 90, 5, 50)])
    d = [r["digest"] for r in c.orderBy("sequence").collect()]
    t = spark.createDataFrame([("j", "ACK", d[0], d[1], "a1", None), ("j", "BATCH_LIMIT_REDUCED", d[1], d[2], None, None), ("j", "ASSUME_COMMITTED", d[2], d[3], None, "i1")],
                              "job_id string, cause string, parent_checkpoint_digest string, child_checkpoint_digest string, attempt_id string, incident_id string")
    a = spark.createDataFrame([("a1", "40")], "attempt_id string, end_offset string")
    i = spark.createDataFrame([("i1", "90")], "incident_id string, end_offset string")
    assert logs.verify_checkpoint_chain(c, t, a, i).count() == 0
    moved = spark.createDataFrame([("a1", "41")], "attempt_id string, end_offset string")
    assert [(r["sequence"], r["problem"]) for r in logs.verify_checkpoint_chain(c, t, moved, i).collect()] == [("1", "OFFSET")]
    forged = c.withColumn("lossy", F.col("sequence") == "2")
    assert [(r["sequence"], r["problem"]) for r in logs.verify_checkpoint_chain(forged, t, a, i).collect()] == [("2", "DIGEST")]
    cut = c.where("sequence != '1'")
    assert [(r["sequence"], r["problem"]) for r in logs.verify_checkpoint_chain(cut, t, a, i).collect()] == [("2", "PARENT_MISSING")]


def test_lists_and_search(spark):
    jobs = spark.createDataFrame([(str(i), i % 2 == 0, s, "p" if i < 4 else "q", i // 2) for i, s in enumerate(["RUNNING", "RUNNING", "FAILED", "READY", "READY", "READY", "CLEANING"])],
                                 "job_id string, retained boolean, state string, profile_id string, created_at int")
    assert [r["job_id"] for r in select.list_recoverable_jobs(jobs).collect()] == ["6", "4", "0"]
    assert [r["job_id"] for r in select.list_recoverable_jobs(jobs, "q", 1).collect()] == ["6"]
    rows = spark.createDataFrame([("Tele", "cpu", ["Usage"], ["host"]), ("other", "mem", ["free"], [])], "db string, measurement string, fields array<string>, tags array<string>")
    assert [r["measurement"] for r in select.search_schema(rows, " USAGE ").collect()] == ["cpu"]
    assert [(r["measurement"], r["match"]) for r in select.search_schema(rows, "tele").collect()] == [("cpu", "database")]
