"""Joins with a side that is small as a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def bounded_broadcast(small: DataFrame, counted: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if it (or the table it is folded from, `counted`) has at most `rows` rows.

    The count reads the small side once. Beyond the bound the join is left to the planner, which
    splits hot keys of the large side at run time.
    """
    source = small if counted is None else counted
    return F.broadcast(small) if source.limit(rows + 1).count() <= rows else small
