"""Equi-join lookups that hold when one key makes up a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.operators.bounded import bounded_collect

HOT_SHARE = 1e-3
HOT_ROWS = 100_000


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    rows: int | None = None,
    counts: DataFrame | None = None,
    hot_share: float = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of many rows to a table that is unique on ``keys``.

    Keys that hold more than ``hot_share`` of the left rows (at most ``1 / hot_share`` of them)
    are joined by broadcasting their few right rows; all others go through the shuffle, where
    none of them is large. Small tables are left to the planner. ``counts`` may give the left
    rows per key (``keys..., c``) where they are known already.
    """
    if rows is None:
        rows = left.count()
    if rows <= hot_rows:
        return left.join(right, keys)
    bar = max(rows * hot_share, 1.0)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    hot = counts.filter(F.col("c") > bar).select(*keys)
    found = bounded_collect(hot, limit=int(1 / hot_share) + 1, what="hot keys")
    if not found:
        return left.join(right, keys)
    schema = left.select(*keys).schema
    hot = F.broadcast(left.sparkSession.createDataFrame(found, schema))
    cold_left, cold_right = left.join(hot, keys, "left_anti"), right.join(hot, keys, "left_anti")
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return cold_left.join(cold_right, keys).unionByName(left.join(few, keys))
