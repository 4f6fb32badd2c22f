"""Checks before a side of a join is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its rows fit; otherwise as it is, and Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df
