"""Per-feature Student-t intervals around the median, over the table or per class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.functions.student import t_interval_factor
from doubtline.functions.vectors import lit_vector, share_inside
from doubtline.operators.stats import SMALL_GROUP, exact_quantile, moments


class IntervalBounds:
    """``lo`` and ``hi`` per (class, feature); the class is None for the whole table."""

    def __init__(self, labels: list, low, high):
        self.labels, self.low, self.high = labels, np.array(low, float), np.array(high, float)

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        level: float = 0.9999,
        by: str | None = None,
        scale: str = "sem",
        small: int = SMALL_GROUP,
    ) -> IntervalBounds:
        """``scale='sem'`` is the interval of the mean, which shrinks as the table grows;
        ``'sd'`` is the interval of a single row, which does not. NaN bounds hold nothing."""
        rows = train.filter(F.col(by).isNotNull()) if by else train
        m = moments(rows, by=by)
        center = exact_quantile(rows, 0.5, by=by, group_rows=m.n.max(), small=small)
        middle = np.array([center[g] for g in m.labels], float)
        spread = m.sem()
        if scale == "sd":
            spread = spread * np.sqrt(m.n)[:, None]
        factor = np.array([t_interval_factor(level, n - 1) for n in m.n])[:, None]
        half = spread * factor
        half[half == 0] = np.nan  # a constant feature has no interval
        return cls(m.labels, middle - half, middle + half)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(g, self.low[i].tolist(), self.high[i].tolist()) for i, g in enumerate(self.labels)]
        return spark.createDataFrame(rows, "label int, lo array<double>, hi array<double>")

    def add_share(self, df: DataFrame, out: str, pred: str = "pred", width: int | None = None) -> DataFrame:
        """Share of the features inside; by the bounds of the predicted class if they are per class.

        The bounds table has one row per class and was collected under a check, so it is broadcast.
        A class without bounds gives 0.
        """
        if self.labels == [None]:
            return df.withColumn(out, share_inside("features", lit_vector(self.low[0]), lit_vector(self.high[0]), width))
        bounds = self.frame(df.sparkSession).select(
            F.col("label").alias("__label"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi")
        )
        joined = df.join(F.broadcast(bounds), F.col(pred) == F.col("__label"), "left")
        share = F.coalesce(share_inside("features", "__lo", "__hi", width), F.lit(0.0))
        return joined.withColumn(out, share).drop("__label", "__lo", "__hi")

    def state(self) -> dict:
        return {"labels": self.labels, "low": self.low, "high": self.high}
