"""Stored key sets: exact listings, sketches, replaced days, and plans that read no points."""

import datetime

from tidepoint.operators import key_catalog

DAY = 86_400_000_000_000
POINTS = "measurement string, time_ns long, tags map<string,string>, fields map<string,struct<kind:string>>, series_key string"


def rows(spark, values):
    return spark.createDataFrame([
        (m, t, tags, None if fields is None else {k: (v,) for k, v in fields.items()}, f"{m},{sorted((tags or {}).items())}")
        for m, t, tags, fields in values], POINTS)


VALUES = [
    ("cpu", 0, {"host": "a", "": "b"}, {"v": "int64"}),
    ("cpu", 1, {"host": "a", "": "b"}, {"v": "float64"}),
    ("cpu", DAY, {"host": "b", "zone": None, "rack": ""}, {"w": "int64"}),
    ("mem", 2 * DAY - 1, None, None),
    ("mem", -1, {"host": "a"}, {}),
    (None, 5 * DAY, {"host": "z"}, {"v": "int64"}),
]


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_listings_count_real_keys_and_days(spark, tmp_path):
    folder = str(tmp_path / "keys")
    key_catalog.refresh(rows(spark, VALUES), folder)
    key_catalog.refresh(rows(spark, VALUES), folder)  # a day written again changes nothing
    assert listed(key_catalog.measurements(spark, folder)) == [("cpu", 3), ("mem", 2)]
    assert listed(key_catalog.keys(spark, folder, "tag_value", "host")) == [("cpu", "host", "a", 2), ("cpu", "host", "b", 1), ("mem", "host", "a", 1)]
    assert listed(key_catalog.keys(spark, folder, "field_key")) == [("cpu", "v", "float64", 1), ("cpu", "v", "int64", 1), ("cpu", "w", "int64", 1)]
    assert listed(key_catalog.cardinality(spark, folder, "tag_key")) == [("cpu", 2), ("mem", 1)]
    assert listed(key_catalog.cardinality(spark, folder, "field_key")) == [("cpu", 2)]
    for approximate in (False, True):
        assert listed(key_catalog.cardinality(spark, folder, "series", approximate=approximate)) == [("cpu", 2), ("mem", 2)]
    late = key_catalog.measurements(spark, folder, since=datetime.date(1970, 1, 2), until=datetime.date(1970, 1, 3))
    assert listed(late) == [("cpu", 1), ("mem", 1)]


def test_a_day_without_points_is_emptied(spark, tmp_path):
    folder = str(tmp_path / "keys")
    key_catalog.refresh(rows(spark, VALUES), folder)
    days = spark.createDataFrame([(datetime.date(1970, 1, 1),), (datetime.date(1970, 1, 2),)], "day date")
    key_catalog.refresh(rows(spark, VALUES[3:4]), folder, days)
    assert listed(key_catalog.measurements(spark, folder)) == [("mem", 2)]


def test_listings_scan_no_points_and_prune_days(spark, tmp_path):
    folder = str(tmp_path / "keys")
    key_catalog.refresh(rows(spark, VALUES), folder)
    found = key_catalog.keys(spark, folder, "tag_key", measurement="cpu", since=datetime.date(1970, 1, 2))
    assert all(f"{folder}/day=" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(what,tag)" in plan and plan.count("FileScan") == 1


def test_no_points(spark, tmp_path):
    folder = str(tmp_path / "keys")
    key_catalog.refresh(rows(spark, []), folder)
    assert listed(key_catalog.measurements(spark, folder)) == []
