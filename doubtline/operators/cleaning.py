"""Cleaning, label coding and the projections of the judged table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doubtline.functions import vectors as V
from doubtline.operators.bounded import bounded_collect

CLASS_LIMIT = 100_000


def fill_missing(df: DataFrame) -> DataFrame:
    """Missing values and the text ``null`` become 0, in every column."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    df = df.na.fill(0)
    if texts:
        df = df.na.fill("0", texts).na.replace("null", "0", texts)
    return df


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def keep_numeric(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Keep numeric columns, and the ones named in ``also``."""
    numeric = set(numeric_columns(df))
    return df.select(*[c for c in df.columns if c in numeric or c in also])


def label_classes(df: DataFrame, label: str, position: str | None = None) -> DataFrame:
    """``(code, name)``: sorted by name, or by first appearance when ``position`` is given.

    The distinct labels are found with map-side combination and must be a bounded set.
    """
    order = F.min(position) if position else F.lit(0)
    found = df.groupBy(F.col(label).alias("name")).agg(order.alias("at"))
    rows = bounded_collect(found, limit=CLASS_LIMIT, what="label set")
    rows.sort(key=lambda r: (r["at"], r["name"]))
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(
        [(i, r["name"]) for i, r in enumerate(rows)], f"code int, name {kind}"
    )


def encode_label(df: DataFrame, label: str, classes: DataFrame, out: str = "label") -> DataFrame:
    """Replace names by codes. ``classes`` is bounded by ``CLASS_LIMIT``, hence broadcast."""
    codes = classes.select(F.col("code").alias("__code"), F.col("name").alias("__name"))
    joined = df.join(F.broadcast(codes), F.col(label) == F.col("__name"), "left")
    keep = [c for c in df.columns if c != out]
    return joined.select(*keep, F.col("__code").alias(out))


def decode_label(df: DataFrame, code: str, classes: DataFrame, out: str) -> DataFrame:
    names = classes.select(F.col("code").alias("__code"), F.col("name").alias(out))
    return df.join(F.broadcast(names), F.col(code) == F.col("__code"), "left").drop("__code")


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def binary_label(label, normal: str = "normal") -> Column:
    """0 for the normal class, 1 for everything else."""
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label == normal, 0).otherwise(1)


def misclassified(label: str = "label", pred: str = "pred") -> Column:
    return (F.col(label) != F.col(pred)).cast("int")


def rejected_to_null(pred: str = "pred", misc_pred: str = "misc_pred") -> Column:
    """The prediction where it is trusted, null where it is rejected."""
    return F.when(F.col(misc_pred) == 0, F.col(pred))


def clean_features(df: DataFrame, features: str = "features") -> DataFrame:
    width = V.known_width(df, features)
    cleaned = V.clean_vector(features)
    if width and df.schema[features].nullable:
        cleaned = F.coalesce(cleaned, F.array(*[F.lit(0.0)] * width))  # a missing vector, like missing values
    return df.withColumn(features, V.vector(cleaned, width, features) if width else cleaned)


def judge_inputs(df: DataFrame, um_columns: list[str], out: str = "um_vector") -> DataFrame:
    """Measures, sanitised, as the feature vector of the adjudicator."""
    cells = [V.clean_judge_input(c) for c in um_columns]
    return df.withColumn(out, V.vector(F.array(*cells), len(cells), out))


NON_MEASURES = ("true_label", "predicted_label", "probabilities")


def measure_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c.startswith("um_")]


def drop_non_measures(df: DataFrame) -> DataFrame:
    return keep_numeric(df.drop(*NON_MEASURES))
