"""Splittable framing of answers and bounded CSV records."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepoint.sources import artifacts, framing, responses


def plain_scan(raw: bytes, state: int):
    found, level = [], []
    for p, c in enumerate(raw):
        if state == framing.ESCAPED:
            state = framing.INSIDE
        elif state == framing.INSIDE:
            state = framing.ESCAPED if c == 0x5C else framing.OUTSIDE if c == 0x22 else state
        elif c == 0x22:
            state = framing.INSIDE
        elif c in b"{}[]":
            found.append(p)
            level.append(1 if c in b"{[" else -1)
    return found, level, state


def test_scan_equals_a_byte_by_byte_automaton():
    rng = random.Random(7)
    for _ in range(3000):
        raw = bytes(rng.choice(b'{}[]"\\"\\ab') for _ in range(rng.randrange(14)))
        for state in (framing.OUTSIDE, framing.INSIDE, framing.ESCAPED):
            at, steps, end = framing.scan(np.frombuffer(raw, np.uint8), state)
            assert (at.tolist(), steps.tolist(), end) == plain_scan(raw, state), (raw, state)


def piece(number, partial, rows, host="a", note='}{"\\]['):
    series = {"name": "cpu", "tags": {"host": host, "q": note}, "columns": ["time", "v"], "values": rows}
    return json.dumps({"results": [{"statement_id": number, "partial": partial, "series": [series]}]}, ensure_ascii=False)


def answers():
    rng = random.Random(3)
    whole = [piece(0, True, [[i * 10 + j, f'"{"\\" * (i % 4)}é{i}'] for j in range(rng.randrange(4))], "ab"[i % 2]) for i in range(40)]
    good = "\n \t".join(whole) + piece(0, False, []) + piece(1, False, [[1, None]])
    return {
        "good": good, "half": good[:-9], "empty": "", "blank": " \n\t ", "stray": "".join(whole[:7]) + ' x"{' + good, "closer": whole[0] + "}" + good,
        "error": whole[0] + '{"error":"\\\\\\"}"}' + whole[1], "long": whole[0] + piece(0, True, [[1, "y" * 3000]]) + good,
        "bad_json": whole[0] + '{"a":\\"}' + good, "open": whole[3] + '{"a":"' + good,
    }


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_answers_in_ranges_equal_answers_in_one_piece(spark, tmp_path, split):
    for name, text in answers().items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    if split == 1:  # every byte a range of its own
        for name in ("long", "good", "half", "stray", "closer", "open", "bad_json"):
            (tmp_path / f"{name}.json").unlink()
        (tmp_path / "good.json").write_text(piece(0, True, [[1, '\\"é']]) + piece(0, False, [[2, 3]]) + " " + piece(1, False, []), encoding="utf-8")

    def read(**how):
        rows, verdicts = responses.read_query_responses(spark, str(tmp_path), 2, limit=2000, **how)
        chunks = responses.read_chunks(spark, str(tmp_path), 2000, **how)
        flat = sorted(str((r.source_file, r.series_id, r.row_index, r.arrival, r.cells, r.code)) for r in rows.collect())
        return flat, sorted(map(str, verdicts.collect())), sorted(str((r.source_file, r.chunk_no, r.series_no, r.code, r.columns)) for r in chunks.collect())

    got, want = read(split_bytes=split), read()
    assert got == want
    codes = {v.split("/")[-1].split(".json")[0]: v.rsplit("code=", 1)[1][:-1] for v in got[1]}
    assert codes["good"] == "None" and codes["empty"] == codes["blank"] == "'FAILED_EMPTY_RESPONSE'"
    if split > 1:
        assert codes["long"] == "'FAILED_RESPONSE_TOO_LARGE'" and codes["error"] == "'FAILED_SERVER'"
        assert {codes[k] for k in ("half", "stray", "closer", "bad_json", "open")} <= {"'FAILED_PROTOCOL'", "'FAILED_RESPONSE_TOO_LARGE'"}


def test_a_large_file_is_cut_in_many_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text("".join(piece(0, i < 499, [[i, i]]) for i in range(500)))
    files = artifacts.list_files(spark, str(tmp_path))
    parts = framing.entered(files, 4096).collect()
    assert len(parts) == -(-(tmp_path / "one.json").stat().st_size // 4096) and sum(r["size"] for r in parts) == parts[0]["length"]
    chunks = responses.read_chunks(spark, str(tmp_path), split_bytes=4096)
    assert [r["chunk_no"] for r in chunks.orderBy("chunk_no").collect()] == list(range(500)) and chunks.select("part").distinct().count() > 10


def test_names_of_file_systems():
    from pyarrow import fs

    for uri in ("file:/tmp/x", "file:///tmp/x"):
        assert artifacts.file_system(uri)[1] == "/tmp/x"
    for uri in ("s3a://bucket/key", "s3n://bucket/key", "s3://bucket/key"):
        found, inner = artifacts.file_system(uri + "?region=us-east-1" if uri.startswith("s3://") else uri + "?region=us-east-1")
        assert isinstance(found, fs.S3FileSystem) and inner == "bucket/key"


def test_unfinished_schema_answers_are_drift(spark, tmp_path):
    tags = {"name": "cpu", "columns": ["tagKey"], "values": [["host"]]}
    for name, partial in (("a", False), ("b", True)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": [{"statement_id": 0, "partial": partial, "series": [{**tags, "name": name}]}]}))
    got = {r["measurement"]: r["code"] for r in responses.read_schema_responses(spark, str(tmp_path), 1).collect()}
    assert got == {"a": None, "b": "SCHEMA_DRIFT"}
    assert responses.read_schema_responses(spark, str(tmp_path)).where(F.col("code").isNotNull()).count() == 0


ONE = dict(timestamp_column="time", static_measurement="m", field_columns={"value": ("value", "string")})


def read_csv(spark, path, split, limit):
    from tidepoint.sources import mapped_csv

    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        good, bad = mapped_csv.read_mapped_csv(spark, str(path), mapped_csv.CsvMapping(**ONE), limit=limit)
        return ({(r["time_ns"], r["fields"]["value"]["string_value"]) for r in good.collect()},
                {(r["source_file"].rsplit("/", 1)[1], r["line_no"], r["size"], r["code"]) for r in bad.collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", [100, 10_000_000])
@pytest.mark.parametrize("few", [True, False])
def test_records_beyond_the_limit_are_named_and_never_gathered(spark, tmp_path, monkeypatch, split, few):
    from tidepoint.sources import mapped_csv

    monkeypatch.setattr(mapped_csv, "BROADCAST_ROWS", 200_000 if few else 0)
    rows = "".join(f"{i},v{i}\n" for i in range(1, 40))
    (tmp_path / "stray.csv").write_text("time,value\n" + rows + '77,"oops\n' + rows)
    (tmp_path / "row.csv").write_text("time,value\n1," + "x" * 64 + "\n41,y\n")
    (tmp_path / "quoted.csv").write_text('time,value\r\n1,"' + "x\r\n" * 40 + '"\r\n42,"a,b"\r\n')
    (tmp_path / "fits.csv").write_text('time,value\n43,"' + "z" * 40 + '"\n')
    good, bad = read_csv(spark, tmp_path, split, 64)
    assert good == {(i, f"v{i}") for i in range(1, 40)} | {(41, "y"), (42, "a,b"), (43, "z" * 40)}
    assert bad == {("stray.csv", 41, len('77,"oops\n' + rows), "POINT_TOO_LARGE"), ("row.csv", 2, 67, "POINT_TOO_LARGE"),
                   ("quoted.csv", 2, 126, "POINT_TOO_LARGE")}


def test_a_header_beyond_the_limit(spark, tmp_path):
    from tidepoint.model import RejectedInput

    (tmp_path / "a.csv").write_text("h" * 65 + ",value\n1,text\n")
    with pytest.raises(RejectedInput, match="POINT_TOO_LARGE"):
        read_csv(spark, tmp_path, 1000, 64)


def test_files_without_odd_quotes_meet_no_python(spark, tmp_path):
    from tidepoint.sources import mapped_csv

    (tmp_path / "a.csv").write_text('time,value\n1,"a,b"\n2,c\n')
    good, _ = mapped_csv.read_mapped_csv(spark, str(tmp_path), mapped_csv.CsvMapping(**ONE))
    shown = good._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in shown and "Exchange hash" not in shown and good.count() == 2


def result_of(spark, rows):
    from tidepoint.operators import result_store

    df = spark.createDataFrame(rows, "statement_id int, series_id string, t long, v string")
    return result_store.store_result(df, ["t"])


def test_pages_read_only_where_their_rows_stand(spark):
    rows = [(0, "hot", i, f"v{i}") for i in range(5000)] + [(1, "hot", i, "other") for i in range(7)] + [(0, "cold", 5, "c"), (0, None, 1, "null")]
    store = result_of(spark, rows[::-1])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    page = store.page(0, "hot", 1990, 1200)
    assert [(r["row_index"], r["v"]) for r in page.collect()] == [(i, f"v{i}") for i in range(1990, 3190)]
    shown = store.page(0, "hot", 1990, 1200)._jdf.queryExecution().executedPlan().toString()
    pushed = shown[shown.index("PushedFilters"):].split("\n")[0]
    assert "EqualTo(series_id,hot)" in pushed and "GreaterThanOrEqual(place," in pushed and "LessThanOrEqual(place," in pushed
    assert shown.count("FileScan") == 1 and "Join" not in shown
    assert [r["row_index"] for r in store.page(0, "hot", 4998, 5).collect()] == [4998, 4999] and store.page(0, "hot", 5000).collect() == []
    picked = store.pick(0, "hot", [4999, 3, 0])
    assert sorted((r["row_index"], r["v"]) for r in picked.collect()) == [(0, "v0"), (3, "v3"), (4999, "v4999")]
    shown = store.pick(0, "hot", [4999, 3, 0])._jdf.queryExecution().executedPlan().toString()
    assert "In(place" in shown and shown.count("FileScan") == 1
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for bad in ([1, 1], [5000], [], [-1]):
        with pytest.raises(Exception, match="INVALID_SELECTION"):
            store.pick(0, "hot", bad)
    for call in (lambda: store.page(0, "hot", 0, 5001), lambda: store.page(0, "none"), lambda: store.page(0, "cold", 2)):
        with pytest.raises(Exception, match="INVALID_PAGE_SIZE|RESULT_SERIES_NOT_FOUND"):
            call()
    assert {(r["statement_id"], r["series_id"]): r["row_count"] for r in store.summary().collect()} == {
        (0, "hot"): 5000, (1, "hot"): 7, (0, "cold"): 1, (0, None): 1}
    assert store.numbered().where("series_id is null").collect()[0]["row_index"] == 0


def test_one_moment_of_one_series_spreads_over_all_tasks(spark):
    from tidepoint.operators import results

    same = spark.range(4000).select(F.lit("s").alias("k"), F.lit(7).alias("t"), "id")
    rows, ranges = results.laid_out(same, ["k"], ["t"])
    sizes = [r["n"] for r in ranges.collect()]
    assert len(sizes) == 8 and max(sizes) < 1000 and sum(sizes) == 4000
    got = sorted(r["row_index"] for r in results.number_rows(same, ["k"], ["t"]).collect())
    assert got == list(range(4000))
    none = results.number_rows(same.limit(0), ["k"], ["t"])
    assert none.collect() == [] and none.columns == ["k", "t", "id", "row_index"]
