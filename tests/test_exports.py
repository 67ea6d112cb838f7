"""Slices, batches, export packages, table mutations."""

import gzip
import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidepoint.model import RejectedInput
from tidepoint.operators import batches, mutate
from tidepoint.operators.schema import infer_schema
from tidepoint.plans import exports as packages
from tidepoint.plans import slices
from tidepoint.sinks import exports, files
from tidepoint.sources import artifacts
from tidepoint.sources.line_protocol import parse_line_protocol

JOB = "8f14e45f-ceea-467f-a8c1-2b5d3f0a9e11"


def test_plan_slices(spark):
    rows = slices.plan_slices(spark, JOB, 0, 10, 4).orderBy("ordinal").collect()
    assert [(r["start_ns"], r["end_ns"], r["file"], r["quantum_id"]) for r in rows] == [
        (0, 4, "data-000000.lp.gz", "slice/000000"), (4, 8, "data-000001.lp.gz", "slice/000001"), (8, 10, "data-000002.lp.gz", "slice/000002")]
    assert rows[1]["fragment_id"] == str(uuid.uuid5(uuid.NAMESPACE_OID, f"{JOB}\0DATA\0001".replace("001", "1")))
    assert slices.plan_slices(spark, JOB, -(2**63), 2**63 - 1).count() == 1
    for bad in [(5, 5, 1), (0, 10, 0), (0, 2_000_000, 1)]:
        with pytest.raises(RejectedInput):
            slices.plan_slices(spark, JOB, *bad)
    assert slices.plan_digest("d", "r", "m", 0, 10, 4) == slices.plan_digest("d", "r", "m", 0, 10, 4)


def greedy(sizes, max_points, max_bytes):
    out, start = [], 0
    while start < len(sizes):
        end, total = start + 1, sizes[start]
        while end < len(sizes) and end - start < max_points and total + 1 + sizes[end] <= max_bytes:
            total += 1 + sizes[end]
            end += 1
        out.append((start, end, sum(s + 1 for s in sizes[:start])))
        start = end
    return out


@pytest.mark.parametrize("block", [8, 64, 65536])
def test_batches_equal_the_sequential_rule(spark, block, monkeypatch):
    monkeypatch.setattr(batches, "SUPER_BLOCKS", 3)
    rng = random.Random(block)
    data = {f: [rng.choice([1, 5, 20, 90, 130]) for _ in range(n)] for f, n in (("hot", 700), ("small", 3), ("one", 1), ("edge", 64))}
    rows = [(f, i, "x" * s) for f, sizes in data.items() for i, s in enumerate(sizes)]
    lines = spark.createDataFrame(rows, "fragment string, line_index bigint, canonical_lp string").repartition(5)
    plan = batches.plan_batches(lines, 8, 100, block_lines=block)
    got = {}
    for r in plan.collect():
        got.setdefault((r["fragment"], r["batch_start"], r["start_offset"]), []).append(r["line_index"])
    expected = {(f, s, o): list(range(s, e)) for f, sizes in data.items() for s, e, o in greedy(sizes, 8, 100)}
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_payloads_and_replay(spark):
    text = [f"m v={i}i {i}" for i in range(20)]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "fragment string, line_index bigint, canonical_lp string")
    out = batches.batch_payloads(lines, batches.plan_batches(lines, 6, 1000)).orderBy("batch_start").collect()
    assert [r["payload"] for r in out] == ["\n".join(text[i:i + 6]) for i in range(0, 20, 6)]
    assert out[-1]["end_offset"] == sum(len(t) + 1 for t in text)
    assert all(hashlib.sha256(r["payload"].encode()).hexdigest() == r["payload_digest"] for r in out)
    placed = batches.line_offsets(lines, F.octet_length("canonical_lp"))
    good, cut = out[1], out[2]
    incidents = spark.createDataFrame(
        [("f", "same", good["start_offset"], good["end_offset"], good["payload_digest"].upper()),
         ("f", "cut", cut["start_offset"] + 1, cut["end_offset"], cut["payload_digest"]),
         ("f", "other", cut["start_offset"], cut["end_offset"], good["payload_digest"])],
        "fragment string, incident_id string, start_offset bigint, end_offset bigint, payload_digest string")
    got = {r["incident_id"]: (r["code"], r["payload"]) for r in batches.replay_batches(placed, incidents).collect()}
    assert got["same"] == (None, good["payload"])
    assert got["cut"][0] == "IMPORT_OFFSET_CONFLICT" and got["other"][0] == "IMPORT_CHECKPOINT_CONFLICT"


def make_points(spark, count=60):
    return parse_line_protocol(spark.createDataFrame([(f"cpu,host={'ab'[i % 2]} n={i}i,r=0.5 {i}",) for i in range(count)], "raw string")).drop("code")


SPEC = {"database": "d", "retention_policy": "r", "measurement": "cpu", "start_ns": 0, "end_ns": 100}


def export(spark, directory):
    p = make_points(spark)
    plan = slices.plan_slices(spark, JOB, 0, 100, 25)
    parts = exports.write_canonical_lp(slices.assign_slices(p, 0, 100, 25), plan, directory)
    digest = slices.plan_digest("d", "r", "cpu", 0, 100, 25)
    manifest = exports.write_manifest(spark, parts, infer_schema(p), SPEC, digest, directory + "/manifest.json")
    return p, plan, digest, manifest


def test_export_package_round_trip(spark, tmp_path):
    directory = str(tmp_path / "pkg")
    p, plan, digest, manifest = export(spark, directory)
    assert sorted(f.name for f in (tmp_path / "pkg").iterdir() if not f.name.startswith(".")) == [f"data-{i:06d}.lp.gz" for i in range(4)] + ["manifest.json"]
    first = gzip.decompress((tmp_path / "pkg" / "data-000000.lp.gz").read_bytes()).decode().splitlines()
    assert first == sorted(first, key=lambda l: (l.split(" ")[0], int(l.split(" ")[2]))) and len(first) == 25
    assert [f["pointCount"] for f in manifest["fragments"]] == ["25", "25", "10", "0"]
    assert manifest["schema"] == {"tagKeys": ["host"], "fields": [{"name": "n", "kind": "int64"}, {"name": "r", "kind": "float64"}]}
    assert packages.verify_manifest(packages.read_manifest(spark, directory + "/manifest.json"), plan, SPEC, digest).count() == 0
    good, bad = packages.read_export_package(spark, directory)
    assert sorted(r[0] for r in good.select("canonical_lp").collect()) == sorted(r[0] for r in p.select("canonical_lp").collect())
    assert bad.count() == 0
    changed = packages.verify_manifest(packages.read_manifest(spark, directory + "/manifest.json"), plan, {**SPEC, "database": "x"}, "0")
    assert {r["problem"] for r in changed.collect()} == {"database", "queryDigestSha256"}
    with pytest.raises(RejectedInput):
        exports.write_manifest(spark, exports.fragments(spark, plan, directory), infer_schema(p), SPEC, digest, directory + "/manifest.json")
    # A flipped byte is found, and the restart plan redoes exactly that slice.
    stored = spark.createDataFrame([
        (r["fragment_id"], "COMPLETE", r["compressed_size"], r["uncompressed_size"], r["sha256"])
        for r in exports.fragments(spark, plan, directory).collect()],
        "fragment_id string, state string, compressed_size bigint, uncompressed_size bigint, sha256 string")
    target = tmp_path / "pkg" / "data-000001.lp.gz"
    broken = bytearray(target.read_bytes())
    broken[len(broken) // 2] ^= 0xFF
    target.write_bytes(bytes(broken))
    crc = tmp_path / "pkg" / ".data-000001.lp.gz.crc"
    if crc.exists():
        crc.unlink()
    with pytest.raises(RejectedInput):
        packages.read_export_package(spark, directory)
    verdicts = exports.fragments(spark, plan, directory)
    actions = packages.plan_restart(plan, stored, verdicts).orderBy("ordinal").collect()
    assert [r["action"] for r in actions] == ["REUSE", "REDO", "REUSE", "REUSE"]


def test_fit_width(spark):
    assert slices.fit_width(make_points(spark), 0, 100, 100, 20) == 12


def stored_table(spark, path):
    day = 86_400 * 10**9
    rows = [(f"{k}", d * day + i, float(i)) for k in ("a", "b") for d in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "measurement string, time_ns bigint, v double").withColumns({"db": F.lit("d"), "rp": F.lit("r")})
    mutate.write_points(df, path)
    return day


def files_of(path):
    return {f.relative_to(path): f.read_bytes() for f in path.rglob("*.parquet")}


def test_delete_rewrites_only_touched_partitions(spark, tmp_path):
    path = tmp_path / "t"
    day = stored_table(spark, str(path))
    before = files_of(path)
    predicate = (F.col("measurement") == "a") & (((F.col("time_ns") >= day) & (F.col("v") > 1)) | (F.col("time_ns") < day))
    plan = mutate.delete_points(spark, str(path), predicate)
    assert sorted((r["matched"], r["total"]) for r in plan.collect()) == [(2, 4), (2, 4), (4, 4)] and files_of(path) == before
    mutate.delete_points(spark, str(path), predicate, dry_run=False)
    after = files_of(path)
    assert {k: v for k, v in after.items() if "measurement=b" in str(k)} == {k: v for k, v in before.items() if "measurement=b" in str(k)}
    left = spark.read.parquet(str(path)).groupBy("measurement").count().collect()
    assert {r[0]: r[1] for r in left} == {"a": 4, "b": 12}
    assert not (path / "db=d" / "rp=r" / "measurement=a" / "day=1970-01-01").exists()


def test_retention_and_select_into(spark, tmp_path):
    path = tmp_path / "t"
    day = stored_table(spark, str(path))
    mutate.enforce_retention(spark, str(path), "1d", 2 * day + 2)
    times = {r[0] for r in spark.read.parquet(str(path)).select("time_ns").collect()}
    assert times == {day + 2, day + 3, *(2 * day + i for i in range(4))}
    result = spark.read.parquet(str(path)).groupBy(F.lit(0).cast("bigint").alias("time_ns")).agg(F.sum("v").alias("v"))
    mutate.select_into(result, str(path), "d", "r", "sums")
    assert spark.read.parquet(str(path)).where("measurement = 'sums'").first()["v"] == 22.0
    assert mutate.drop_measurement(spark, str(path), "sums", dry_run=False).first()["total"] == 1
    assert spark.read.parquet(str(path)).where("measurement = 'sums'").count() == 0
