"""Golden lines of the three point formats, file reading, and their reject codes."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidepoint.functions.numbers import _shortest
from tidepoint.model import MAX_POINT_BYTES, RejectedInput
from tidepoint.operators import aggregate
from tidepoint.sources import artifacts, line_protocol, lines, mapped_csv, typed_jsonl

BREAKS = ("\n", "\r", "\x85", "\u2028")
LINES = [
    (r"cpu\ load,z=last,a=first value=09007199254740993i,ok=T 01720000000000000001",
     r"cpu\ load,a=first,z=last ok=true,value=9007199254740993i 1720000000000000001", None),
    ("m value=1i", None, "TIMESTAMP_REQUIRED"),
    ("m,shared=tag shared=1i 1", None, "INVALID_INPUT"),
    ("m v=0.10000000000000001,b=1e20,c=-0,d=100000,e=1e6,f=1234567,g=0.00001,h=0.0001,i=0x1p-2,j=1_000.5,k=2e23 1",
     "m b=1e+20,c=-0,d=100000,e=1e+06,f=1.234567e+06,g=1e-05,h=0.0001,i=0.25,j=1000.5,k=2e+23,v=0.1 1", None),
    ("m v=1e400 1", None, "INVALID_INPUT"),
    ("m v=nan 1", None, "INVALID_INPUT"),
    ("m v=1d 1", None, "INVALID_INPUT"),
    ("m v= 1 1", None, "INVALID_INPUT"),
    (r'm v="a \"q\" \\ \x b, c=d" 1', r'm v="a \"q\" \\ \\x b, c=d" 1', None),
    ('m v="x 1', None, "TIMESTAMP_REQUIRED"),
    ('m v="x"y 1', None, "INVALID_INPUT"),
    ('m v="" 1', 'm v="" 1', None),
    ("m v=1 1 2", None, "INVALID_INPUT"),
    ("m v=1 ", None, "INVALID_INPUT"),
    ("m v=1 9223372036854775808", None, "INVALID_INPUT"),
    (" v=1 1", None, "TIMESTAMP_REQUIRED"),
    (r"m\=x v=1 1", None, "INVALID_INPUT"),
    (r"m\q v=1 1", None, "INVALID_INPUT"),
    ("m,a= v=1 1", None, "INVALID_INPUT"),
    ("m,=a v=1 1", None, "INVALID_INPUT"),
    ("m,,a=b v=1 1", None, "INVALID_INPUT"),
    ("m, v=1 1", None, "INVALID_INPUT"),
    ("m,a=b,a=c v=1 1", None, "INVALID_INPUT"),
    ("m v=1,v=2 1", None, "INVALID_INPUT"),
    ("m v=1, 1", None, "INVALID_INPUT"),
    ("m v=1,,w=2 1", None, "INVALID_INPUT"),
    ("m v 1", None, "INVALID_INPUT"),
    ("m v=18446744073709551615u,w=-9223372036854775808i 1", "m v=18446744073709551615u,w=-9223372036854775808i 1", None),
    ("m v=18446744073709551616u 1", None, "INVALID_INPUT"),
    ("m v=-1u 1", None, "INVALID_INPUT"),
    ("m v=9223372036854775808i 1", None, "INVALID_INPUT"),
    ("m,t=x=y v=1i -5", r"m,t=x\=y v=1i -5", None),
    ("m v=TRUE,w=f 1", "m v=true,w=false 1", None),
    ("m v=yes 1", None, "INVALID_INPUT"),
    ("m,ä=ü v=\"ß\" 1", "m,ä=ü v=\"ß\" 1", None),
    ("m v=\"a\rb\" 1", None, "INVALID_INPUT"),
    # A line break of any kind is no part of a number.
    *((f"m v=1.5{b} 1", None, "INVALID_INPUT") for b in BREAKS), *((f"m v=1i{b} 1", None, "INVALID_INPUT") for b in BREAKS),
    *((f"m v=1u{b} 1", None, "INVALID_INPUT") for b in BREAKS), *((f"m v=1i 1{b}", None, "INVALID_INPUT") for b in BREAKS),
]


@pytest.mark.parametrize("parts", [1, 4])
def test_line_protocol_goldens(spark, parts):
    df = spark.createDataFrame([(i, l) for i, (l, _, _) in enumerate(LINES)], "i int, raw string").repartition(parts)
    got = {r["i"]: (r["canonical_lp"], r["code"]) for r in line_protocol.parse_line_protocol(df, keep=["i"]).collect()}
    assert got == {i: (lp, code) for i, (_, lp, code) in enumerate(LINES)}


def test_canonical_lines_are_stable(spark):
    good = [(lp,) for _, lp, code in LINES if code is None]
    out = line_protocol.parse_line_protocol(spark.createDataFrame(good, "raw string"), keep=["raw"])
    assert all(r["raw"] == r["canonical_lp"] for r in out.collect())


def test_point_size_limit(spark):
    frame = len('m v="" 1')
    rows = [("fits", 'm v="' + "x" * (MAX_POINT_BYTES - frame) + '" 1'), ("over", 'm v="' + "x" * (MAX_POINT_BYTES - frame + 1) + '" 1')]
    out = line_protocol.parse_line_protocol(spark.createDataFrame(rows, "k string, raw string"), keep=["k"])
    assert {r["k"]: r["code"] for r in out.select("k", "code").collect()} == {"fits": None, "over": "POINT_TOO_LARGE"}


def test_shortest_float_text():
    cases = {100000.0: "100000", 1e6: "1e+06", 1234567.0: "1.234567e+06", 0.0001: "0.0001", 1e-05: "1e-05",
             0.1: "0.1", -0.0: "-0", 5e-324: "5e-324", 2e23: "2e+23", 1 / 3: "0.3333333333333333", 123.25: "123.25"}
    assert {v: _shortest(v) for v in cases} == cases


def test_line_numbers_across_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.lp").write_text("".join(
            "# note\n" if i % 7 == 3 else "\n" if i % 7 == 5 else f"m v={i}i {i}\r\n" if i % 11 else "broken\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        good, bad = line_protocol.read_line_protocol(spark, str(tmp_path))
        good = lines.with_line_numbers(good, lines.read_lines(spark, str(tmp_path)))
        rows, rejects = good.collect(), bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows and all(r["line_no"] == r["time_ns"] + 1 for r in rows)
    expected = [i + 1 for i in range(500) if i % 7 not in (3, 5) and i % 11 == 0]
    assert sorted(r["line_no"] for r in rejects) == sorted(expected * 3)
    assert {r["code"] for r in rejects} == {"TIMESTAMP_REQUIRED"}
    with pytest.raises(RejectedInput) as error:
        line_protocol.read_line_protocol(spark, str(tmp_path), fail_on_reject=True)
    assert error.value.code == "TIMESTAMP_REQUIRED"


def test_gzip_members(spark, tmp_path):
    sound = gzip.compress(b"m value=1i 1\n")
    flipped = bytearray(sound)
    flipped[-6] ^= 1
    files = {"ok": sound, "crc": bytes(flipped), "two": sound + sound, "tail": sound + b"x", "cut": sound[:-3], "text": b"m value=1i 1\n", "zero": b""}
    for name, content in files.items():
        (tmp_path / f"{name}.lp.gz").write_bytes(content)
    good, bad = line_protocol.read_line_protocol_gz(spark, str(tmp_path))
    assert [r["canonical_lp"] for r in good.collect()] == ["m value=1i 1"]
    assert {r["source_file"].split("/")[-1].split(".")[0]: r["code"] for r in bad.collect()} == dict.fromkeys(
        ["crc", "two", "tail", "cut", "text", "zero"], "INVALID_GZIP")
    _, limited = line_protocol.read_line_protocol_gz(spark, str(tmp_path / "ok.lp.gz"), limit=5)
    assert [r["code"] for r in limited.collect()] == ["GZIP_LIMIT_EXCEEDED"]


def test_source_change_is_seen(spark, tmp_path):
    path = tmp_path / "a.lp"
    path.write_text("m v=1i 1\n")
    before = spark.createDataFrame(artifacts.source_identity(spark, str(tmp_path)).collect())
    assert artifacts.changed_sources(before, artifacts.source_identity(spark, str(tmp_path))).count() == 0
    path.write_text("m v=2i 1\n")
    changed = artifacts.changed_sources(before, artifacts.source_identity(spark, str(tmp_path))).collect()
    assert [r["code"] for r in changed] == ["SOURCE_CHANGED"]


def jsonl(**change):
    point = {"schemaVersion": 1, "measurement": "m", "tags": {"t": "x"}, "fields": {"v": {"kind": "int64", "decimalText": "1"}},
             "timestamp": {"kind": "timestamp_ns", "decimalText": "1"}}
    point.update(change)
    return json.dumps({k: v for k, v in point.items() if v is not ...})


def field(**f):
    return {"v": f}


JSONL = [
    (jsonl(fields={"unsigned": {"kind": "uint64", "decimalText": "18446744073709551615"},
                   "signed": {"kind": "int64", "decimalText": "9007199254740993"},
                   "negativeZero": {"kind": "float64", "decimalText": "-0"}}, timestamp={"kind": "timestamp_ns", "decimalText": "1720000000000000001"}),
     "m,t=x negativeZero=-0,signed=9007199254740993i,unsigned=18446744073709551615u 1720000000000000001", None),
    (jsonl(fields=field(kind="numeric_text", decimalText="1")), None, "NUMERIC_TYPE_REQUIRED"),
    (jsonl(fields={"known": {"kind": "numeric_text", "decimalText": "1.50"}}), "m,t=x known=1.5 1", None),
    (jsonl(fields={"known": {"kind": "numeric_text", "decimalText": "x"}}), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="string", value='q"')), r'm,t=x v="q\"" 1', None),
    (jsonl(fields=field(kind="string", value="")), 'm,t=x v="" 1', None),
    (jsonl(fields=field(kind="string", value=1)), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="string", value="a\nb")), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="boolean", value=True)), "m,t=x v=true 1", None),
    (jsonl(fields=field(kind="boolean", value="true")), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="int64", value=1)), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="int64", decimalText=1)), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="int64", decimalText="1", unit="s")), None, "INVALID_INPUT"),
    (jsonl(fields=field(kind="odd", decimalText="1")), None, "INVALID_INPUT"),
    (jsonl(fields={}), None, "INVALID_INPUT"),
    (jsonl(schemaVersion=2), None, "INVALID_INPUT"),
    (jsonl(schemaVersion="1"), None, "INVALID_INPUT"),
    (jsonl(measurement=""), None, "INVALID_INPUT"),
    (jsonl(extra=1), None, "INVALID_INPUT"),
    (jsonl(tags={"t": ""}), None, "INVALID_INPUT"),
    *((jsonl(fields={"v": {"kind": k, "decimalText": f"1{b}"}}), None, "INVALID_INPUT") for b in BREAKS for k in ("int64", "uint64", "float64")),
    *((jsonl(timestamp={"kind": "timestamp_ns", "decimalText": f"1{b}"}), None, "INVALID_INPUT") for b in BREAKS),
    (jsonl(tags={"t": 1}), None, "INVALID_INPUT"),
    (jsonl(tags={"v": "x"}), None, "INVALID_INPUT"),
    (jsonl(tags=...), "m v=1i 1", None),
    (jsonl(timestamp=...), None, "TIMESTAMP_REQUIRED"),
    (jsonl(timestamp={"kind": "int64", "decimalText": "1"}), None, "TIMESTAMP_REQUIRED"),
    (jsonl(timestamp={"kind": "timestamp_ns", "decimalText": "1.5"}), None, "INVALID_INPUT"),
    (jsonl() + " x", None, "INVALID_INPUT"),
    (jsonl() + jsonl(), None, "INVALID_INPUT"),
    (jsonl() + "}],[{" + jsonl()[1:], None, "INVALID_INPUT"),
    ("[]", None, "INVALID_INPUT"),
    ("{", None, "INVALID_INPUT"),
]


def test_typed_jsonl_goldens(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(l for l, _, _ in JSONL) + "\n\n")
    good, bad = typed_jsonl.read_typed_jsonl(spark, str(tmp_path), [("m", "known", "float64")])
    good = lines.with_line_numbers(good, lines.read_lines(spark, str(tmp_path)))
    got = {r["line_no"]: (r["canonical_lp"], None) for r in good.collect()}
    got.update({r["line_no"]: (None, r["code"]) for r in bad.collect()})
    assert got == {i + 1: (lp, code) for i, (_, lp, code) in enumerate(JSONL)}


def test_numeric_mapping_rules():
    with pytest.raises(RejectedInput):
        typed_jsonl.check_numeric_mapping([("m", "v", "int64"), ("m", "v", "uint64")])
    with pytest.raises(RejectedInput):
        typed_jsonl.check_numeric_mapping([("m", "v", "string")])


MAPPING = mapped_csv.CsvMapping(
    timestamp_column="timestamp", measurement_column="measurement", tag_columns={"host": "host name"},
    field_columns={"signed": ("count", "int64"), "unsigned": ("max", "uint64"), "zero": ("ratio", "float64"), "note": ("note", "string")},
)
CSV = '''measurement,timestamp,host,signed,unsigned,zero,note
"cpu load",1720000000000000001,"east,1",9007199254740993,18446744073709551615,-0,"hello, ""quoted"""
cpu,1,a,1,1,1,"two
lines"
cpu,1,a,1,1
cpu,1,a,1,1,1,x,y
cpu,,a,1,1,1,
cpu,1,a,1,1,1,
'''


def test_mapped_csv_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    good, bad = mapped_csv.read_mapped_csv(spark, str(tmp_path), MAPPING)
    assert {r["row_id"] + 1: r["canonical_lp"] for r in good.collect()} == {
        2: r'cpu\ load,host\ name=east\,1 count=9007199254740993i,max=18446744073709551615u,note="hello, \"quoted\"",ratio=-0 1720000000000000001',
        8: r'cpu,host\ name=a count=1i,max=1u,note="",ratio=1 1',
    }
    assert {r["line_no"]: r["code"] for r in bad.collect()} == {
        3: "INVALID_INPUT", 5: "INVALID_INPUT", 6: "INVALID_INPUT", 7: "TIMESTAMP_REQUIRED"}


@pytest.mark.parametrize("split", [64, 100_000_000])
def test_csv_headers_and_quotes(spark, tmp_path, split):
    """Each file has its own column order; stray quotes reject; quoted line breaks may cross splits."""
    one = mapped_csv.CsvMapping(timestamp_column="time", static_measurement="m", field_columns={"p": ("p", "float64"), "q": ("q", "string")})
    (tmp_path / "a.csv").write_text('time,p,q\r\n1,1.5,x\r\n\r\n2,2.5,"a\r\nb"\r\n3,1,a"b\r\n4,1,"y"z"\r\n5,"1.5\n",x\r\n6,1,""\r\n')
    (tmp_path / "b.csv").write_text("q,time,p\n" + "".join(f'"say ""{i}"" {"w" * 50}",{i},{i}\n' for i in range(10, 40)) + "late,99,7")
    (tmp_path / "c.csv").write_text('p,q,time\n1,"' + "\n".join(["long"] * 60) + '",100\n2,z,101\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        good, bad = mapped_csv.read_mapped_csv(spark, str(tmp_path), one)
        got = {r["time_ns"]: (r["fields"]["p"]["decimal_text"], r["fields"]["q"]["string_value"]) for r in good.collect()}
        rejects = {(r["raw"], r["line_no"]) for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {1: ("1.5", "x"), 6: ("1", ""), 99: ("7", "late"), 101: ("2", "z"),
                   **{i: (str(i), f'say "{i}" ' + "w" * 50) for i in range(10, 40)}}
    # A quote opened by mistake runs to the next one, as in any reader; the records it spoils are rejected whole.
    assert {raw.split(",")[0] for raw, _ in rejects} >= {"2", "3"} and (
        '1,"' + "\n".join(["long"] * 60) + '",100', 2) in rejects


@pytest.mark.parametrize("kind,cell,code", [
    ("int64", "1.5", "INVALID_INPUT"), ("int64", "9223372036854775808", "INVALID_INPUT"), ("int64", " 1", "INVALID_INPUT"),
    ("uint64", "18446744073709551616", "INVALID_INPUT"), ("uint64", "-1", "INVALID_INPUT"), ("float64", "NaN", "INVALID_INPUT"),
    ("boolean", "maybe", "INVALID_INPUT"), ("boolean", "tRUE", "INVALID_INPUT"), ("boolean", "T", None), ("string", "", None),
])
def test_csv_kinds(spark, kind, cell, code):
    m = mapped_csv.CsvMapping("time", {"value": ("ok", kind)}, static_measurement="static measurement")
    df = spark.createDataFrame([("1", cell)], "time string, value string")
    assert mapped_csv.points_from_csv(df, m).collect()[0]["code"] == code


def test_csv_mapping_rules():
    base = dict(timestamp_column="t", field_columns={"v": ("v", "int64")}, static_measurement="m")
    mapped_csv.check_csv_mapping(["t", "v"], mapped_csv.CsvMapping(**base))
    bad = [
        (["t", "v"], {"measurement_column": "t"}), (["t", "v"], {"static_measurement": ""}), (["t", "v"], {"timestamp_column": ""}),
        (["t", "v"], {"field_columns": {}}), (["t", "v", "x"], {}), (["t", "v"], {"tag_columns": {"x": "x"}}),
        (["t", "v", "x"], {"tag_columns": {"x": "v"}}), (["t", "v"], {"tag_columns": {"v": "w"}}), (["t", "t", "v"], {}),
        (["t", "v"], {"field_columns": {"v": ("v", "decimal")}}),
    ]
    for header, change in bad:
        with pytest.raises(RejectedInput):
            mapped_csv.check_csv_mapping(header, mapped_csv.CsvMapping(**{**base, **change}))


def test_ingest_stats_and_empty(spark):
    df = spark.createDataFrame([("m v=1i 1",), ("m v=1i",), ("m v=x 1",), ("m v=22i 1",)], "raw string")
    stats = aggregate.ingest_stats(line_protocol.parse_line_protocol(df))
    assert {r["code"]: (r["row_count"], r["logical_bytes"]) for r in stats.collect()} == {
        "": (2, len("m v=1i 1m v=22i 1") + 2), "TIMESTAMP_REQUIRED": (1, 0), "INVALID_INPUT": (1, 0)}
    aggregate.require_points(stats)
    with pytest.raises(RejectedInput):
        aggregate.require_points(stats.where(F.col("code") != ""))
