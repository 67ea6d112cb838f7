"""Stored results: rows laid out by series and order, so that a page or a choice of rows reads only where they stand.

Rows are range-partitioned by series, order and a row salt, sorted and written once; `place` is the partition and the row's
position in it, taken while writing. A table of ranges, one row for each series in each partition, turns row numbers into places
and back. Both the series and the place are sorted along the files, so Parquet statistics leave one or two row groups to read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepoint.functions.joins import bounded_broadcast
from tidepoint.functions.work import shared_dir, stored
from tidepoint.model import DEFAULT_PAGE, MAX_PAGE, RejectedInput

PART_SHIFT = 33  # of monotonically_increasing_id
ROW_GROUP_BYTES = 16 << 20


def laid_out(df: DataFrame, group: list[str], order: list[str], name: str = "result") -> tuple[DataFrame, DataFrame]:
    """(rows of `df` with `place`, written; ranges: the group columns, part, first, n, base).

    `base` rows of the group stand in earlier partitions. Equal rows spread over partitions by their salt, so a group or a
    moment of any size does; rows equal in `order` stand in any order. A partition begins inside one group at most, so prefix sums
    run over as many rows as a group has partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in (*group, *order)] + [F.col("_salt")]
    folder = shared_dir(spark, name)
    placed = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *keys).sortWithinPartitions(
        *keys).drop("_salt").withColumn("place", F.monotonically_increasing_id())
    placed.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder)
    part = F.shiftright("place", PART_SHIFT).cast("int")
    counts = rows.groupBy(*group, part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), name + "-ranges")


def with_numbers(rows: DataFrame, ranges: DataFrame, group: list[str], name: str = "row_index") -> DataFrame:
    """`rows` with their number in the group instead of their place."""
    named = ranges.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("part").alias("_part"), "first", "base")
    meets = F.shiftright("place", PART_SHIFT).cast("int") == F.col("_part")
    for i, c in enumerate(group):
        meets = meets & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(bounded_broadcast(named), meets).select(
        *[c for c in rows.columns if c != "place"], (F.col("place") - F.col("first") + F.col("base")).alias(name))


SERIES = ["statement_id", "series_id"]


@dataclass(frozen=True)
class ResultStore:
    """A finished result: statement_id, series_id, any columns, and `place`; with its ranges. `finish` makes result rows of stored ones."""

    rows: DataFrame
    ranges: DataFrame
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def numbered(self) -> DataFrame:
        return self.finish(with_numbers(self.rows, self.ranges, SERIES))

    def summary(self) -> DataFrame:
        """statement_id, series_id, row_count, from the ranges alone."""
        return self.ranges.groupBy(*SERIES).agg(F.sum("n").alias("row_count"))

    def _ranges_of(self, statement_id: int, series_id: str) -> list:
        """Ranges of one series: at most one a partition."""
        found = self.ranges.where((F.col("statement_id") == statement_id) & (F.col("series_id") == series_id))
        return sorted(found.select("part", "first", "n", "base").collect(), key=lambda r: r["base"])

    def _at(self, statement_id: int, series_id: str, wanted, ranges: list) -> DataFrame:
        deltas = F.create_map(*[F.lit(x) for r in ranges for x in (r["part"], r["base"] - r["first"])])
        part = F.shiftright("place", PART_SHIFT).cast("int")
        rows = self.rows.where((F.col("statement_id") == statement_id) & (F.col("series_id") == series_id) & wanted)
        return self.finish(rows.withColumn("row_index", F.col("place") + F.element_at(deltas, part)).drop("place"))

    def page(self, statement_id: int, series_id: str, after: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
        """Rows [after, after + limit) of one series, in order; a series or a start that is not there is an error."""
        limit = limit if limit > 0 else DEFAULT_PAGE
        if limit > MAX_PAGE:
            raise RejectedInput("INVALID_PAGE_SIZE")
        ranges = self._ranges_of(statement_id, series_id)
        if not ranges or after > sum(r["n"] for r in ranges):
            raise RejectedInput("RESULT_SERIES_NOT_FOUND")
        met = [r for r in ranges if r["base"] < after + limit and r["base"] + r["n"] > after]
        wanted = F.lit(False)
        for r in met:
            start, stop = max(after, r["base"]), min(after + limit, r["base"] + r["n"])
            wanted = wanted | F.col("place").between(r["first"] + start - r["base"], r["first"] + stop - r["base"] - 1)
        return self._at(statement_id, series_id, wanted, met or ranges[:1]).orderBy("row_index")

    def pick(self, statement_id: int, series_id: str, indexes: list[int]) -> DataFrame:
        """Chosen rows of one series. Duplicates, or an index that is not there, are errors."""
        if not indexes or len(set(indexes)) != len(indexes) or min(indexes) < 0:
            raise RejectedInput("INVALID_SELECTION")
        ranges = self._ranges_of(statement_id, series_id)
        if max(indexes) >= sum(r["n"] for r in ranges):
            raise RejectedInput("INVALID_SELECTION", "row not found")
        met = [r for r in ranges if any(r["base"] <= i < r["base"] + r["n"] for i in indexes)]
        places = [r["first"] + i - r["base"] for r in met for i in indexes if r["base"] <= i < r["base"] + r["n"]]
        return self._at(statement_id, series_id, F.col("place").isin(places), met)


def store_result(rows: DataFrame, order: list[str], finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> ResultStore:
    """Rows with statement_id and series_id as a stored result, each series in `order`."""
    return ResultStore(*laid_out(rows, SERIES, order), finish)
