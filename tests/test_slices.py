"""As-of joins, irregular slices and slices of bounded depth."""

import bisect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepoint.operators import asof
from tidepoint.plans import slices

JOB = "8f14e45f-ceea-467f-a8c1-2b5d3f0a9e11"


def test_as_of_join_equals_a_search_for_each_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 50, *range(100)]), i) for i in range(3000)]
    borders = [(k, t, f"{k}@{t}") for k in ("hot", "b", None, "other") for t in sorted(rng.sample(range(100), 9))]
    left = spark.createDataFrame(rows, "k string, t long, i int")
    right = spark.createDataFrame(borders, "k string, start long, name string")
    got = asof.as_of_join(left, right, "t", "start", ["name"], ["k"]).collect()

    def want(k, t):
        known = sorted(s for x, s, _ in borders if x == k)
        at = bisect.bisect_right(known, t) - 1 if t is not None else -1
        return f"{k}@{known[at]}" if at >= 0 else None

    assert sorted((r.i, r.name) for r in got) == [(i, want(k, t)) for k, t, i in rows]
    alone = asof.as_of_join(left.where("k = 'hot'"), right.where("k = 'hot'").drop("k"), "t", "start", ["name"]).collect()
    assert sorted((r.i, r.name) for r in alone) == [(i, want(k, t)) for k, t, i in rows if k == "hot"]
    assert asof.as_of_join(left.limit(0), right, "t", "start", ["name"], ["k"]).collect() == []
    assert {r.name for r in asof.as_of_join(left, right.limit(0), "t", "start", ["name"], ["k"]).collect()} == {None}


def test_a_hot_moment_spreads_over_tasks(spark):
    left = spark.range(4000).select(F.lit(7).cast("long").alias("t"), "id")
    right = spark.createDataFrame([(7, "now"), (3, "early")], "start long, name string")
    got = asof.as_of_join(left, right, "t", "start", ["name"])
    assert got.count() == 4000 and {r.name for r in got.select("name").distinct().collect()} == {"now"}
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def at_times(spark, times):
    return spark.createDataFrame([(t, f"s{i % 50}", i) for i, t in enumerate(times)], "time_ns long, series_key string, i int")


@pytest.mark.parametrize("limit", [200_000, 0])
def test_many_short_slices_beside_a_long_one(spark, limit):
    borders = [(0, 0, 1_000_000)] + [(i, 1_000_000 + 3 * i, 1_000_000 + 3 * i + 2) for i in range(1, 400)]
    plan = spark.createDataFrame(borders, "ordinal long, start_ns long, end_ns long")
    times = [-1, 0, 999_999, 1_000_000, *range(1_000_001, 1_001_300)]
    got = slices.assign_irregular_slices(at_times(spark, times), plan, limit).collect()
    want = sorted((t, o) for t in times for o, low, high in borders if low <= t < high)
    assert sorted((r.time_ns, r.slice_ordinal) for r in got) == want


def test_a_skewed_range_gives_bounded_slices(spark):
    rng = random.Random(2)
    times = [int(rng.expovariate(1 / 2000)) for _ in range(6000)] + [777] * 3000 + [10**9 + rng.randrange(10**6) for _ in range(500)] + [-(2**62)]
    points = at_times(spark, times)
    low, high = -(2**62), 2**62
    plan = slices.plan_bounded_slices(points, JOB, low, high, 400)
    rows = plan.orderBy("ordinal").collect()
    ranges = sorted({(r.start_ns, r.end_ns) for r in rows})
    assert ranges[0][0] == low and ranges[-1][1] == high and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    met = slices.assign_bounded_slices(points, plan).collect()
    counts = Counter(r.slice_ordinal for r in met)
    assert len(met) == len(times) and max(counts.values()) <= 400 and len(rows) < 120
    by = {r.ordinal: r for r in rows}
    assert all(by[r.slice_ordinal].start_ns <= r.time_ns < by[r.slice_ordinal].end_ns for r in met)
    assert sum(r.shares > 1 for r in rows) == by[next(r.slice_ordinal for r in met if r.time_ns == 777)].shares
    assert [r.file for r in rows[:2]] == ["data-000000.lp.gz", "data-000001.lp.gz"]


def test_bounded_slices_of_no_points(spark):
    plan = slices.plan_bounded_slices(at_times(spark, [1]).limit(0), JOB, 0, 100, 10).collect()
    assert [(r.start_ns, r.end_ns, r.shares) for r in plan] == [(0, 100, 1)]


def lines_of(spark, n):
    from tidepoint.sources.line_protocol import parse_line_protocol

    return parse_line_protocol(spark.createDataFrame([(f"cpu,host={'ab'[i % 2]} n={i}i {i}",) for i in range(n)], "raw string")).drop("code")


def test_a_repeated_commit_changes_nothing_and_never_overwrites(spark, tmp_path):
    from tidepoint.model import RejectedInput
    from tidepoint.sinks import commit, exports

    root = tmp_path / "pkg"
    plan = slices.plan_slices(spark, JOB, 0, 100, 20)
    placed = slices.assign_slices(lines_of(spark, 50), 0, 100, 20)
    parts = exports.write_canonical_lp(placed, plan, str(root))
    assert [(r["point_count"], r["valid"]) for r in parts.orderBy("ordinal").collect()] == [(20, True), (20, True), (10, True), (0, True), (0, True)]
    assert not (root / "_attempts").exists()
    before = {f.name: f.read_bytes() for f in root.iterdir()}
    lines = placed.select(F.col("slice_ordinal").alias("ordinal"), F.col("canonical_lp").alias("line"), "series_key", "time_ns")
    lines = lines.repartition("ordinal").sortWithinPartitions("ordinal", "series_key", "time_ns", "line").select("ordinal", "line")
    again = commit.write_attempts(lines, str(root / "_attempts"))
    for _ in range(2):
        assert {r["state"] for r in commit.commit(plan, again, str(root)).collect()} == {"KEPT"}
    (root / "data-000001.lp.gz").unlink()  # a run that stopped half way
    states = {r["ordinal"]: r["state"] for r in commit.commit(plan, again, str(root)).collect()}
    assert states == {0: "KEPT", 1: "MOVED", 2: "KEPT", 3: "KEPT", 4: "KEPT"}
    assert before == {f.name: f.read_bytes() for f in root.iterdir() if f.is_file()}
    (root / "data-000002.lp.gz").write_bytes(b"other")
    with pytest.raises(RejectedInput, match="ARTIFACT_STATE"):
        commit.commit(plan, again, str(root))


def test_a_skewed_package_has_bounded_files(spark, tmp_path):
    from tidepoint.operators.schema import infer_schema
    from tidepoint.plans import exports as packages
    from tidepoint.sinks import exports

    p = lines_of(spark, 300)
    plan = slices.plan_bounded_slices(p, JOB, 0, 10**15, 40)
    parts = exports.write_canonical_lp(slices.assign_bounded_slices(p, plan), plan, str(tmp_path / "pkg"))
    counts = [r["point_count"] for r in parts.orderBy("ordinal").collect()]
    assert sum(counts) == 300 and max(counts) <= 40
    spec = {"database": "d", "retention_policy": "r", "measurement": "cpu", "start_ns": 0, "end_ns": 10**15}
    digest = slices.plan_digest("d", "r", "cpu", 0, 10**15, ranges=[(r["start_ns"], r["end_ns"]) for r in plan.orderBy("ordinal").collect()])
    exports.write_manifest(spark, parts, infer_schema(p), spec, digest, str(tmp_path / "pkg" / "manifest.json"))
    good, bad = packages.read_export_package(spark, str(tmp_path / "pkg"))
    assert good.count() == 300 and bad.count() == 0
