"""Checks on everything that leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

STATE_ROWS = 200_000
STATE_VALUES = 8_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def bounded_collect(df: DataFrame, limit: int = STATE_ROWS, what: str = "fitted state") -> list[Row]:
    """Collect a table that must be small, and refuse when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it does not belong on the driver")
    return rows


def check_values(count: int, what: str) -> None:
    if count > STATE_VALUES:
        raise ValueError(f"{what} needs {count} numbers, above the limit of {STATE_VALUES}")
