"""Small tables: kept on the driver only after their size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 200_000
SMALL_BYTES = 32 << 20


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Replace an aggregate by a literal relation if it has at most ``max_rows`` rows.

    Catalyst then knows the exact size and broadcasts it by itself. A larger
    table is returned unchanged, so joins with it go through a shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > SMALL_BYTES:
        return df
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only when a count stays within ``max_rows``."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
