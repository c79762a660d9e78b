"""Small JSON states and frames on the shared file system, written and read by Spark."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _plain(value):
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    raise TypeError(f"cannot store {type(value)}")


def write_json(spark: SparkSession, path: str, value) -> None:
    text = json.dumps(value, default=_plain)
    spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first().value)
