"""Work folders and stored tables below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which a cluster must name; a local session has one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """`df` written once and reread: consumers share the work, and a lost executor costs nothing before this point."""
    folder = shared_dir(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, share: Column | float = 0.125) -> DataFrame:
    """Rows that each stand for much work (a file, a byte range), dealt out evenly: one a task, or where they are many as many as make up one `share`.

    The number of tasks is given, because rows of a few bytes dealt out by a key alone would all be put into one task by AQE.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows, tasks = df.agg(F.count(F.lit(1)), F.sum(share if isinstance(share, Column) else F.lit(share))).first()
    return df.repartition(max(min(rows, max(8 * cores, int(tasks or 0))), 1))
