"""As-of joins: each row meets the last border at or before its time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepoint.functions.joins import BROADCAST_ROWS, bounded_broadcast
from tidepoint.functions.work import stored
from tidepoint.operators.result_store import PART_SHIFT


def as_of_sorted(rows: DataFrame, time: str, starts: list[int], name: str) -> DataFrame:
    """`rows` with `name`, the place in the sorted `starts` of the last one at or before `time` (null: none).

    One binary search a row in a broadcast array; the caller bounds its length.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.array(starts, np.int64))

    @F.arrow_udf("int")
    def place(at: pa.Array) -> pa.Array:
        found = np.searchsorted(shared.value, at.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
        return pc.if_else(pc.and_(at.is_valid(), pa.array(found >= 0)), pa.array(found.astype(np.int32)), pa.scalar(None, pa.int32()))

    return rows.withColumn(name, place(F.col(time)))


def _filled(keys: list[str]):
    """Rows sorted by keys and time, borders first: the newest border of the same keys so far, in this partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            lead = 0 if held is None else 1
            rows = (pa.concat_tables([held, rows]) if lead else rows).combine_chunks()
            n = len(rows)
            new = np.zeros(n, bool)
            new[0] = True
            for key in keys:
                column = rows[key].combine_chunks()
                a, b = column[1:], column[:-1]
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            border = rows["_border"].to_numpy(zero_copy_only=False).astype(bool)
            has = rows["_payload"].is_valid().to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            last = np.maximum.accumulate(np.where(border | (has & (np.arange(n) < lead)), np.arange(n), -1))
            take = pa.array(np.where(last >= start, last, 0), mask=last < start)
            filled = rows["_payload"].combine_chunks().take(take)
            out = rows.set_column(rows.schema.get_field_index("_payload"), rows.schema.field("_payload"), filled)
            held = out.slice(n - 1)
            yield from out.slice(lead).combine_chunks().to_batches()

    return run


def as_of_join(rows: DataFrame, borders: DataFrame, time: str, start: str, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """`rows` with the `payload` columns of the last border (equal `by`, `start` <= `time`), null where there is none.

    Both sides are laid out by range partitions of keys and time with a row salt, so a hot key or moment spreads; each task fills
    along its own rows, and the last border of the partitions before comes from one row for each key in a partition. Of borders that
    start together any one counts. Rows are never multiplied.
    """
    by = list(by or [])
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keys = [f"_k{i}" for i in range(len(by))]
    named = lambda df: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    left = rows.select(*named(rows), F.col(time).alias("_time"), F.lit(False).alias("_border"), whole.alias("_row"),
                       F.lit(None).cast(borders.select(F.struct(*payload)).schema[0].dataType).alias("_payload"))
    right = borders.select(*named(borders), F.col(start).alias("_time"), F.lit(True).alias("_border"),
                           F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(*payload).alias("_payload"))
    order = [*[F.col(k) for k in keys], F.col("_time"), F.col("_border").desc(), F.col("_salt")]
    both = left.unionByName(right).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    laid = both.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_salt")
    laid = stored(laid.mapInArrow(_filled(keys), laid.schema).withColumn("_place", F.monotonically_increasing_id()), "as-of")
    part = F.shiftright("_place", PART_SHIFT).cast("int")
    ends = laid.groupBy(*keys, part.alias("_part")).agg(F.max_by("_payload", F.when(F.col("_border"), F.col("_place"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("_carried is not null").select(
        *[F.col(k).alias(f"_e{k}") for k in keys], F.col("_part").alias("_epart"), "_carried")
    meets = part == F.col("_epart")
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_e{k}"))
    met = laid.where(~F.col("_border")).join(bounded_broadcast(stored(ends, "as-of-ends")), meets, "left")
    found = F.when(F.col("_time").isNotNull(), F.coalesce("_payload", "_carried"))
    return met.select(*[F.col("_row")[c].alias(c) for c in rows.columns], *[found[c].alias(c) for c in payload])


def small_enough(borders: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return borders.limit(rows + 1).count() <= rows
