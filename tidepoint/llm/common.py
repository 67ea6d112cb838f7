"""Shared folder, stored tables and row numbers for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write to the shared folder and reread: lineage ends, and a lost executor costs nothing before this point.

    clean: the shuffle files of the write go when it ends, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(CLEAN, None)
    if clean:
        spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(folder)
    finally:
        if clean:
            spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, order: list[str], number: str, name: str) -> DataFrame:
    """`df` with its rows numbered from 0 in the order of `order`, without one task holding all of them.

    Rows are range-partitioned on the order and a row salt (equal rows spread over tasks),
    stored once, and numbered from the counts of the partitions before (one row for each
    partition). Rows equal in `order` get their numbers in any order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col("_salt")]
    placed = stored(
        df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_salt")
        .withColumn("_mid", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_mid", 33).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    # One row for each shuffle partition, so its size is that setting.
    return placed.join(F.broadcast(base), "_part").withColumn(
        number, F.col("_base") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_part", "_mid", "_base")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names never meet the operator's own."""
    return df.select(*columns)
