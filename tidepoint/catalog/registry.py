"""Registry and the point views that the catalog uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions.work import shared_dir  # noqa: F401
from tidepoint.sources import tables

ROWS_A_TASK = 50_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EVENTS = tables.PointShape("events", "ts", ("event_type",), {"value": "float64", "user_id": "int64"})
ORDERS = tables.PointShape(
    "orders", "o_orderdate", ("o_orderstatus", "o_orderpriority"), {"o_totalprice": "float64"}
)
LINEITEM = tables.PointShape(
    "lineitem", "l_shipdate", ("l_returnflag", "l_linestatus"),
    {"l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64",
     "l_orderkey": "int64"},
)

SECOND = 1_000_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR
JAN_1 = 1_704_067_200 * SECOND  # 2024-01-01T00:00:00Z
FEB_1 = JAN_1 + 31 * DAY
JOB = "8f14e45f-ceea-467f-a8c1-2b5d3f0a9e11"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that is heavy per row, dealt out to tasks of at most ROWS_A_TASK rows and no fewer tasks than cores.

    Splits say little about rows: a row group is read by one task, whatever the number of splits it spans.
    """
    df = table(spark, sf, name)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide_points(table(spark, sf, "events"), EVENTS)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide_points(table(spark, sf, "orders"), ORDERS)


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return tables.wide_points(table(spark, sf, "lineitem"), LINEITEM)


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    return tables.points_from_wide(tables.wide_points(spread_table(spark, sf, "events"), EVENTS), EVENTS)


def event_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keys_from_wide(events(spark, sf), EVENTS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals: sums of doubles depend on their order in the last bits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# SQL that several oracles share.
E = "(SELECT event_id, epoch_us(ts) * 1000 AS time_ns, event_type, user_id, value, props FROM events)"
O = "(SELECT *, epoch_us(o_orderdate) * 1000 AS time_ns FROM orders)"
# Canonical text of doubles in [1e-4, 1e6) with few digits.


def num(column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


EVENT_LINE = (
    f"'events,event_type=' || event_type || ' user_id=' || user_id || 'i,value=' || {num('value')} || ' ' || time_ns"
)


def length_prefixed(expr: str) -> str:
    return f"unhex(printf('%016x', strlen({expr}))) || encode({expr})"


def series_sql(measurement: str, key: str, value: str) -> str:
    parts = ["'0'", f"'{measurement}'", f"'{key}'", value]
    return "sha256(" + " || ".join(length_prefixed(p) for p in parts) + ")"
