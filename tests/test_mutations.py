"""Deletes that stop half way are finished or undone."""

import pytest
from pyspark.sql import functions as F

from tidepoint.operators import mutate

DAY = 86_400 * 10**9


def make_table(spark, path):
    rows = [(k, d * DAY + i, float(i)) for k in ("a", "b c") for d in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "measurement string, time_ns bigint, v double").withColumns({"db": F.lit("d:1"), "rp": F.lit("r%")})
    mutate.write_points(df, path)
    return rows


def state(spark, path):
    return sorted((r["measurement"], r["time_ns"], r["v"]) for r in spark.read.parquet(path).collect())


PREDICATE = "measurement = 'b c' and (time_ns < 86400000000000 or v > 2)"


def expected(rows):
    return sorted(r for r in rows if not (r[0] == "b c" and (r[1] < DAY or r[2] > 2)))


@pytest.mark.parametrize("broken", ["move", "delete", "drop"])
def test_a_run_that_stops_behind_its_journal_is_finished(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "t")
    rows = make_table(spark, path)
    real, taken = mutate._carry_out, []

    def stops(steps):
        first = steps.select("step").first()
        if first and first["step"] == broken:
            real(steps.limit(1))  # some of it is done
            raise OSError("the driver is gone")
        taken.append(first and first["step"])
        real(steps)

    monkeypatch.setattr(mutate, "_carry_out", stops)
    with pytest.raises(OSError):
        mutate.delete_points(spark, path, F.expr(PREDICATE), dry_run=False)
    monkeypatch.setattr(mutate, "_carry_out", real)
    assert mutate.recover(spark, path) == 1 and state(spark, path) == expected(rows)
    assert mutate.recover(spark, path) == 0 and not [f for f in (tmp_path / "t").iterdir() if f.name.startswith(("_staged", "_journal"))]


def test_a_run_that_stops_before_its_journal_never_happened(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = make_table(spark, path)
    monkeypatch.setattr(mutate, "_finish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        mutate.delete_points(spark, path, F.expr(PREDICATE), dry_run=False)
    monkeypatch.undo()
    for journal in (tmp_path / "t").glob("_journal-*"):
        (journal / "_SUCCESS").unlink()
    assert state(spark, path) == sorted(rows)
    report = mutate.delete_points(spark, path, F.expr(PREDICATE), dry_run=False)  # the old run is undone first
    assert sorted((r["matched"], r["total"]) for r in report.collect()) == [(1, 4), (1, 4), (4, 4)]
    assert state(spark, path) == expected(rows) and len(list((tmp_path / "t").glob("_*-*"))) == 0
