"""Whether a table may go to all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEND_ROWS = 200_000


def sent(df: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """df as a side to broadcast if it has no more rows than that; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
