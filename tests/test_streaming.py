"""Streams give the batch answer, also across restarts."""

from pyspark.sql import functions as F

from tidepoint.operators import aggregate
from tidepoint.streaming import downsample, ingest, task_state

LOG = "log_id string, schema_version int, seq string, kind string, resource_id string, resource_revision string, state string"


def test_ingest_restart_keeps_one_copy(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    for turn in range(2):
        (tmp_path / "in" / f"f{turn}.lp").write_text("".join(f"m v={i}i {i}\n" for i in range(turn * 10, turn * 10 + 10)) + "broken" * 2000 + "\n# note\n\n")
        ingest.stream_ingest(spark, source, out, state).awaitTermination()
    ingest.stream_ingest(spark, source, out, state).awaitTermination()
    points, rejects = ingest.ingested(spark, out)
    assert sorted(r[0] for r in points.select("time_ns").collect()) == list(range(20))
    assert [(r["code"], r["raw"]) for r in rejects.collect()] == [("TIMESTAMP_REQUIRED", "broken" * 2000)] * 2


def run_tasks(spark, tmp_path, **kw):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    task_state.stream_task_state(stream, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def write_events(spark, tmp_path, seqs, valid=1):
    rows = [("a", valid, str(s), "IMPORT", f"r{int(s) % 2}", str(s), f"S{s}") for s in seqs]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(str(tmp_path / "in"))


def test_task_state_waits_for_gaps(spark, tmp_path):
    write_events(spark, tmp_path, [2, 1, 1, 4])
    first = {(r["action"], r["seq"]) for r in run_tasks(spark, tmp_path)}
    assert first == {("APPLY", "1"), ("APPLY", "2"), ("GAP", "3")}
    write_events(spark, tmp_path, [3, 2, 5])
    both = {(r["action"], r["seq"], r["state"]) for r in run_tasks(spark, tmp_path)}
    # Resource r1 is reported once for 3 and 5, resource r0 for 4.
    assert {b for b in both if b[0] == "APPLY"} == {("APPLY", "1", "S1"), ("APPLY", "2", "S2"), ("APPLY", "4", "S4"), ("APPLY", "5", "S5")}


def test_task_state_keeps_all_that_waits(spark, tmp_path):
    write_events(spark, tmp_path, [1, *range(3, 1503)])
    got = {(r["action"], r["seq"]) for r in run_tasks(spark, tmp_path)}
    assert got == {("APPLY", "1"), ("GAP", "2")}
    write_events(spark, tmp_path, [2])
    rows = {(r["action"], r["seq"], r["state"]) for r in run_tasks(spark, tmp_path)}
    assert {("APPLY", "1502", "S1502"), ("APPLY", "1501", "S1501")} <= rows


def test_task_state_names_invalid_events(spark, tmp_path):
    write_events(spark, tmp_path, [1, 3])
    write_events(spark, tmp_path, ["02", 2], valid=1)
    write_events(spark, tmp_path, [9], valid=2)
    got = {(r["action"], r["seq"]) for r in run_tasks(spark, tmp_path)}
    assert {("INVALID", "02"), ("INVALID", "9")} <= got and {s for a, s in got if a == "APPLY"} == {"1", "2", "3"}


def test_task_state_starts_anew_at_a_head(spark, tmp_path):
    write_events(spark, tmp_path, [1, 3, 5, 7, 8])
    rows = [("a", 1, "6", task_state.HEAD, "-", "0", None)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = [(r["action"], r["seq"]) for r in run_tasks(spark, tmp_path)]
    assert ("HEAD", "6") in got and ("APPLY", "8") in got and not {a for a in got if a[0] == "GAP"} - {("GAP", "2")}


def test_downsample_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(path + "/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(path)
    out = downsample.continuous_downsample(stream, "1h", [("max", "value", "top"), ("count", "value", "n")], ["event_type"], "1 hour", "ts")
    downsample.write_downsample(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["bucket_ns"], r["event_type"]): (r["top"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    timed = events.withColumn("time_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    batch = {(r["bucket_ns"], r["event_type"]): (r["top"], r["n"])
             for r in aggregate.group_by_time(timed, "1h", [("max", "value", "top"), ("count", "value", "n")], ["event_type"]).collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(batch) - len(got) < 20
