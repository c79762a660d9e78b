"""Shuffles, limits, splits, class rebalancing, feature bags; all keyed, none positional."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtline.functions.hashing import md5_uniform
from doubtline.operators.stats import column_quantile


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A reproducible random order (a range-partitioned sort)."""
    return df.orderBy(md5_uniform(seed, F.col(key)), F.col(key))


def random_limit(df: DataFrame, n: float, key: str, seed: int = 0) -> DataFrame:
    """``n`` random rows; the table itself if ``n`` is not finite or not below its size.

    The n-th smallest hash is found by an exact distributed quantile and then used as a filter,
    so no task sees more than its own partition.
    """
    if n is None or n != n or n in (float("inf"), float("-inf")):
        return df
    n = int(n)
    rows = df.count()
    if n >= rows:
        return df
    if n == 0:
        return df.limit(0)
    marked = df.withColumn("__u", md5_uniform(seed, F.col(key)))
    rank = (n - 1) / (rows - 1) if rows > 1 else 0.0
    cut = column_quantile(marked, "__u", rank)
    # the quantile may fall between two neighbours by rounding: settle the edge by counting
    edge = 2.0 / 4294967296.0
    sure = marked.filter(F.col("__u") < cut - edge)
    missing = n - sure.count()
    border = (
        marked.filter((F.col("__u") >= cut - edge) & (F.col("__u") <= cut + edge))
        .orderBy("__u", key)
        .limit(missing)
    )
    return sure.unionByName(border).drop("__u")


def split_label(key, cuts: list[tuple[str, float]], seed: int = 0) -> Column:
    """Name of the split a key falls into; ``cuts`` are (name, share), the last takes the rest."""
    u = md5_uniform(seed, F.col(key) if isinstance(key, str) else key)
    edge, column = 0.0, None
    for name, share in cuts[:-1]:
        edge += share
        column = (F.when if column is None else column.when)(u < F.lit(edge), F.lit(name))
    last = F.lit(cuts[-1][0])
    return last if column is None else column.otherwise(last)


def two_way_split(df: DataFrame, key: str, test_size: float = 0.3, seed: int = 0) -> DataFrame:
    return df.withColumn("split", split_label(key, [("test", test_size), ("train", 1 - test_size)], seed))


def three_way_split(
    df: DataFrame, key: str, test_size: float = 0.3, val_size: float = 0.2, seed: int = 0
) -> DataFrame:
    """Shares of the whole table. A second cut of ``val / (1 - test)`` of the rest gives the same
    expected shares; one hash with two cut points needs no second pass."""
    cuts = [("test", test_size), ("val", val_size), ("train", 1 - test_size - val_size)]
    return df.withColumn("split", split_label(key, cuts, seed))


def downsample_share(misc: int, normal: int, ratio: float | None) -> float:
    """Share of the normal rows to keep: all of them, unless errors are rarer than ``ratio``."""
    if ratio is None or normal == 0:
        return 1.0
    current = misc / normal
    return current / (2.0 * ratio) if current < ratio else 1.0


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(errors, normals)."""
    row = df.agg(
        F.sum((F.col(label) == 1).cast("long")).alias("misc"),
        F.sum((F.col(label) == 0).cast("long")).alias("normal"),
    ).first()
    return row.misc or 0, row.normal or 0


def downsample(
    df: DataFrame,
    ratio: float | None,
    key: str,
    label: str = "label",
    seed: int = 0,
    counts: tuple[int, int] | None = None,
) -> DataFrame:
    """Thin out the normal rows by a hash of their key. Errors are all kept, nothing is copied."""
    misc, normal = counts or class_counts(df, label)
    share = downsample_share(misc, normal, ratio)
    if share >= 1.0:
        return df
    return df.filter((F.col(label) == 1) | (md5_uniform(seed, F.col(key)) < F.lit(share)))


def bag_rate(n_features: int) -> float:
    """Share of the features each bag member sees."""
    # fixed values: (features below, rate); the last rate holds from there on
    steps = [(20, 0.8), (50, 0.7), (100, 0.6)]
    for bound, rate in steps:
        if n_features < bound:
            return rate
    return 0.5


def _digest(*parts) -> str:
    return hashlib.md5("_".join(map(str, parts)).encode()).hexdigest()


def feature_subsets(n_features: int, members: int, rate: float | None = None, seed: int = 0) -> list[list[int]]:
    """Sorted random feature subsets, one per member."""
    size = max(1, int(n_features * (bag_rate(n_features) if rate is None else rate)))
    return [
        sorted(sorted(range(n_features), key=lambda j: _digest(seed, m, j))[:size]) for m in range(members)
    ]


def slice_features(df: DataFrame, subset: list[int], features: str = "features", out: str = "features") -> DataFrame:
    from doubtline.functions.vectors import item, vector

    return df.withColumn(out, vector(F.array(*[item(features, j) for j in subset]), len(subset), out))
