"""Members of typed JSON lines in any case; of several spellings the last counts."""

from tidepoint.sources import typed_jsonl

TIME = '"timestamp":{"kind":"timestamp_ns","decimalText":"1"}'
V = '"fields":{"v":{"kind":"int64","decimalText":"1"}}'
CASES = [
    ('{"SCHEMAVERSION":1,"Measurement":"m","FIELDS":{"v":{"KIND":"int64","DecimalText":"1"}},"Timestamp":{"Kind":"timestamp_ns","decimaltext":"1"}}', "m v=1i 1"),
    ('{"schemaVersion":1,"measurement":"a","Measurement":"b",' + V + "," + TIME + "}", "b v=1i 1"),
    ('{"schemaVersion":1,"Measurement":"b","measurement":"a",' + V + "," + TIME + "}", "a v=1i 1"),
    ('{"schemaVersion":1,"measurement":"a","Measurement":null,' + V + "," + TIME + "}", "a v=1i 1"),
    ('{"schemaVersion":1,"measurement":"m","fields":{"v":{"kind":"float64","Kind":"int64","decimalText":"1"}},' + TIME + "}", "m v=1i 1"),
    ('{"schemaVersion":1,"measurement":"m","fields":{"v":{"Kind":"int64","kind":"float64","decimalText":"1.5"}},' + TIME + "}", "m v=1.5 1"),
    ('{"schemaVersion":1,"measurement":"m","fields":{"Kind":{"Kind":"int64","decimalText":"1"},"kind":{"kind":"int64","decimalText":"2"}},' + TIME + "}", "m Kind=1i,kind=2i 1"),
    ('{"schemaVersion":1,"measurement":"m","Tags":{"Kind":"x"},' + V + "," + TIME + "}", "m,Kind=x v=1i 1"),
    ('{"schemaVersion":1,"measurement":"m","Extra":1,"Fields":{"v":{"kind":"int64","decimalText":"1"}},' + TIME + "}", None),
    ('{"schemaVersion":1,"measurement":"m","fields":{"v":{"Kind":"int64","decimalText":"1","Unit":"s"}},' + TIME + "}", None),
    ('{"schemaVersion":1,"Measurement":5,' + V + "," + TIME + "}", None),
    ('{"schemaVersion":1,"Measurement":"m",' + V + "," + TIME + "} {}", None),
    ('{"schemaVersion":1,"Measurement":"m","Fields":[1],' + TIME + "}", None),
]


def test_members_in_any_case(spark):
    rows = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(CASES)], "i int, raw string")
    got = {r.i: (r.canonical_lp, r.code) for r in typed_jsonl.parse_typed_jsonl(rows, keep=["i"]).collect()}
    assert got == {i: (lp, None if lp else "INVALID_INPUT") for i, (_, lp) in enumerate(CASES)}
