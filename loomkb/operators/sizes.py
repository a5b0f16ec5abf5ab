"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a query-side table is sent to all executors.
SMALL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows; Spark's own choice (blocks by partition) beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def broadcast_if_few(df: DataFrame, rows: int | None, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is known to have ``rows`` rows at most and those are few; nothing runs."""
    return F.broadcast(df) if rows is not None and rows <= most else df
