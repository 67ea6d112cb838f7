"""Work that is heavy per row or per file is dealt out evenly, whatever the splits and AQE make of it."""

import gzip
import shutil

from pyspark.sql import functions as F

from tidepoint.catalog import registry
from tidepoint.sources import artifacts, framing, mapped_csv


def test_one_row_group_of_many_splits_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_A_TASK", 500)
    spark.range(20_000).selectExpr("id", "sha2(string(id), 256) AS s").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        assert registry.table(spark, str(tmp_path), "t").rdd.getNumPartitions() > 8
        rows = registry.spread_table(spark, str(tmp_path), "t").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) <= 600


def test_byte_ranges_are_not_put_into_one_task(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    files = spark.createDataFrame([(f"file:/f{i}", 16_000) for i in range(4)], "path string, length long")
    where = framing.ranges(files, 1000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in where) == 64 and max(r["count"] for r in where) <= 8


def test_points_and_rejects_of_csv_come_from_one_pass(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text('t,v,n\n1,2,"a\nb"\n2,x,q\n3,4,"c, d"\n')
    mapping = mapped_csv.CsvMapping(timestamp_column="t", static_measurement="m", field_columns={"v": ("v", "int64"), "n": ("n", "string")})
    good, rejects = mapped_csv.read_mapped_csv(spark, str(tmp_path / "c"), mapping)
    assert sorted((r.line_no, r.raw, r.code) for r in rejects.collect()) == [(2, '1,2,"a\nb"', "INVALID_INPUT"), (4, "2,x,q", "INVALID_INPUT")]
    shutil.move(tmp_path / "c", tmp_path / "gone")
    assert [r.canonical_lp for r in good.collect()] == ['m n="c, d",v=4i 3']


def test_files_are_not_verified_in_one_task(spark, tmp_path):
    for i in range(32):
        (tmp_path / f"data-{i}.lp.gz").write_bytes(gzip.compress(b"m v=1 1\n"))
    found = artifacts.verify_artifacts(spark, str(tmp_path / "*.gz")).withColumn("p", F.spark_partition_id()).collect()
    assert len(found) == 32 and all(r.valid for r in found) and len({r.p for r in found}) > 8
