"""Mutations as rewrites of the partitions they touch."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions.joins import bounded_broadcast
from tidepoint.functions.work import stored
from tidepoint.model import NS_PER_DAY, RejectedInput, duration_ns
from tidepoint.operators import select
from tidepoint.sinks import files
from tidepoint.sources.artifacts import file_system

PARTITIONS = ["db", "rp", "measurement", "day"]


def day_of(time_ns: Column) -> Column:
    """UTC calendar day of a nanosecond time."""
    days = (time_ns - F.pmod(time_ns, F.lit(NS_PER_DAY).cast("bigint"))) / F.lit(NS_PER_DAY).cast("bigint")
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def write_points(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store points_wide rows (with db and rp) under db / rp / measurement / day.

    Rows are spread by partition and a slice of time, so a partition that holds a large
    share of all rows is written by many tasks.
    """
    _spread(df.withColumn("day", day_of(F.col("time_ns")))).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def _spread(df: DataFrame) -> DataFrame:
    hour = F.floor(F.pmod("time_ns", F.lit(NS_PER_DAY)) / F.lit(NS_PER_DAY // 24)).cast("int")
    return df.repartition(*PARTITIONS, hour)


def select_into(df: DataFrame, path: str, db: str, rp: str, measurement: str) -> None:
    """Store a query result as a measurement. NULL times are refused."""
    if "time_ns" not in df.columns:
        raise RejectedInput("TIMESTAMP_REQUIRED")
    checked = df.withColumn(
        "time_ns", F.coalesce("time_ns", F.raise_error(F.lit("TIMESTAMP_REQUIRED")).cast("bigint"))
    )
    write_points(
        checked.withColumns({"db": F.lit(db), "rp": F.lit(rp), "measurement": F.lit(measurement)}), path
    )


def delete_preview(df: DataFrame, predicate: Column) -> DataFrame:
    """Points that a delete would remove, per measurement; nothing changes."""
    return df.where(predicate).groupBy("measurement").agg(F.count(F.lit(1)).alias("points"))


STAGED, JOURNAL = "_staged-", "_journal-"  # readers pass over names with an underscore in front


def delete_points(spark: SparkSession, path: str, predicate: Column, dry_run: bool = True) -> DataFrame:
    """Delete matching points of a stored table; returns one row per touched partition.

    Partitions without a match are not rewritten; a partition that loses all its points is
    dropped. With dry_run only the counts are computed.

    The predicate filters before anything is grouped, so that it prunes partitions and
    reaches the files; totals are then counted in the touched partitions alone.

    What stays of the touched partitions is written beside the table first, then a journal of every file to move and to delete, and
    only then is the table changed. `recover`, which also runs before each delete, ends a run that stopped: with a whole journal
    it is finished, without one it never happened.
    """
    if not dry_run:
        recover(spark, path)
    table = spark.read.parquet(path)
    hit = F.coalesce(predicate, F.lit(False))
    matched = table.where(predicate).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("matched"))
    totals = table.join(bounded_broadcast(matched.select(*PARTITIONS)), PARTITIONS, "left_semi").groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("total"))
    touched = matched.join(totals, PARTITIONS)
    if dry_run:
        return touched
    touched = stored(touched, "touched")
    name = uuid.uuid4().hex
    root = path.rstrip("/")
    staged, journal = f"{root}/{STAGED}{name}", f"{root}/{JOURNAL}{name}"
    partial = touched.where("matched < total").select(*PARTITIONS)
    file = F.col("_metadata.file_path")
    old = table.select(*PARTITIONS, file.alias("name")).join(bounded_broadcast(touched), PARTITIONS).groupBy("name").agg(
        F.max(F.col("matched") == F.col("total")).alias("whole"))
    steps = old.select(F.lit("delete").alias("step"), "name", F.lit(None).cast("string").alias("target"))
    steps = steps.unionByName(old.where("whole").select(
        F.lit("drop").alias("step"), F.regexp_replace("name", "/[^/]*$", "").alias("name"), F.lit(None).cast("string").alias("target")).distinct())
    if not partial.isEmpty():
        kept = table.join(bounded_broadcast(partial), PARTITIONS, "left_semi").where(~hit)
        _spread(kept).write.partitionBy(*PARTITIONS).parquet(staged)
        new = spark.read.parquet(staged).select(file.alias("name")).distinct()
        steps = steps.unionByName(new.select(F.lit("move").alias("step"), "name", F.replace("name", F.lit(f"/{STAGED}{name}/"), F.lit("/")).alias("target")))
    steps.write.parquet(journal)
    _finish(spark, journal, staged)
    return touched


def recover(spark: SparkSession, path: str) -> int:
    """Finish or undo what stopped deletes left beside the table; how many there were."""
    names = files.children(spark, path)
    journals = {n[len(JOURNAL):] for n in names if n.startswith(JOURNAL)}
    left = journals | {n[len(STAGED):] for n in names if n.startswith(STAGED)}
    root = path.rstrip("/")
    for name in sorted(left):
        staged, journal = f"{root}/{STAGED}{name}", f"{root}/{JOURNAL}{name}"
        if name in journals and files.exists(spark, journal + "/_SUCCESS"):
            _finish(spark, journal, staged)
        else:
            files.delete(spark, journal)
            files.delete(spark, staged)
    return len(left)


def _finish(spark: SparkSession, journal: str, staged: str) -> None:
    """Every step of a journal, in tasks; each may be taken again. The journal goes last but for what it staged."""
    steps = spark.read.parquet(journal)
    for step in ("move", "delete", "drop"):
        _carry_out(steps.where(F.col("step") == step))
    files.delete(spark, journal)
    files.delete(spark, staged)


def _carry_out(steps: DataFrame) -> None:
    def run(batches):
        for batch in batches:
            for step, name, target in zip(batch["step"], batch["name"], batch["target"]):
                _take_step(step, unquote(name), unquote(target or ""))
            yield batch[["name"]]

    steps.repartition("name").mapInPandas(run, "name string").count()


def _take_step(step: str, name: str, target: str) -> None:
    from pyarrow import fs

    filesystem, inner = file_system(name)
    there = filesystem.get_file_info(inner).type != fs.FileType.NotFound
    if step == "move" and there:
        final = file_system(target)[1]
        filesystem.create_dir(final.rsplit("/", 1)[0], recursive=True)
        filesystem.move(inner, final)
    elif step == "delete" and there:
        filesystem.delete_file(inner)
    elif step == "drop" and there:
        held = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
        if not any(f.type == fs.FileType.File and not f.base_name.startswith(".") for f in held):
            filesystem.delete_dir(inner)


def drop_measurement(spark: SparkSession, path: str, measurement: str, dry_run: bool = True) -> DataFrame:
    return delete_points(spark, path, F.col("measurement") == measurement, dry_run)


def apply_retention(df: DataFrame, policy: str | int, now_ns: int) -> DataFrame:
    """Points not older than the policy: whole days fall to partition pruning, the edge day to the filter."""
    return select.since(df, now_ns, policy, inclusive=True)


def enforce_retention(spark: SparkSession, path: str, policy: str | int, now_ns: int) -> DataFrame:
    """Remove points older than the policy from a stored table."""
    edge = now_ns - duration_ns(policy)
    predicate = (F.col("day") <= select._date(edge // NS_PER_DAY)) & (F.col("time_ns") < F.lit(edge))
    return delete_points(spark, path, predicate, dry_run=False)
