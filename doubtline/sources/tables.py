"""Scans: CSV with a header, many datasets at once, vector tables, folders of measure tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doubtline.functions.vectors import pack, vector
from doubtline.operators.cleaning import encode_label, fill_missing, label_classes, numeric_columns


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """Comma-separated with a header. Give a schema where it is known: inferring it costs a
    second pass over the files."""
    reader = spark.read.option("header", True).option("sep", ",")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def expand_list(text: str) -> list[str]:
    """``a.csv, folder/, b.csv`` to paths; Spark expands folders and globs itself."""
    return [part.strip() for part in text.split(",") if part.strip()]


def read_datasets(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    avoid: Sequence[str] = (),
) -> DataFrame:
    """Many files as one table, with the file name (without extension) in column ``dataset``."""
    paths = expand_list(paths) if isinstance(paths, str) else list(paths)
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    df = reader.format(fmt).load(paths)
    for tag in avoid:
        df = df.filter(~F.contains(F.col("_metadata.file_name"), F.lit(tag)))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z0-9.]+$", "")
    return df.select("*", name.alias("dataset"))


def vector_table(
    df: DataFrame, key: str, column: str, label: str | None = None, width: int | None = None, nested: bool = False
) -> DataFrame:
    """Vectors or flattened images as ``row_id, features[, label]``."""
    flat = F.flatten(column) if nested else F.col(column)
    flat = flat.cast("array<double>")
    if width is None:
        row = df.select(F.size(flat).alias("n")).first()
        width = row.n if row else 0
    cells = [F.col(key).cast("long").alias("row_id"), vector(flat, width, "features")]
    if label:
        cells.append(F.col(label).cast("int").alias("label"))
    return df.select(*cells)


def named_pixels(df: DataFrame, features: str = "features", width: int | None = None) -> DataFrame:
    """A vector column as columns ``pixel_0 .. pixel_{n-1}``."""
    from doubtline.functions.vectors import item, width_of

    n = width or width_of(df, features)
    keep = [c for c in df.columns if c != features]
    return df.select(*keep, *[item(features, i).alias(f"pixel_{i}") for i in range(n)])


def long_pixels(df: DataFrame, features: str = "features") -> DataFrame:
    """A vector column as rows ``name, value`` (narrow)."""
    keep = [c for c in df.columns if c != features]
    long = df.select(*keep, F.posexplode(features).alias("__i", "value"))
    return long.select(*keep, F.concat(F.lit("pixel_"), F.col("__i")).alias("name"), "value")


def tabular_dataset(
    df: DataFrame, key: str, label: str, skip: Sequence[str] = (), position: str | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Clean, keep numeric features, code the label: ``(row_id, features, label)``, classes, names."""
    clean = fill_missing(df)
    names = numeric_columns(clean, skip=(key, label, *skip))
    classes = label_classes(clean, label, position)
    coded = encode_label(clean, label, classes, "__label")
    table = coded.select(
        F.col(key).cast("long").alias("row_id"), pack(names), F.col("__label").cast("int").alias("label")
    )
    return table, classes, names


def read_measure_tables(
    spark: SparkSession,
    path: str,
    avoid: Sequence[str] = (),
    min_accuracy: float | None = None,
    label: str = "is_misclassification",
) -> DataFrame:
    """A folder of measure tables (partitioned by ``dataset`` and ``clf``), gated by accuracy.

    A table in which the classifier is right less often than ``min_accuracy`` is left out as a
    whole. Missing measures become 0.
    """
    df = spark.read.parquet(path)
    for tag in avoid:
        df = df.filter(~F.contains(F.concat_ws("/", "dataset", "clf"), F.lit(tag)))
    if min_accuracy is not None:
        df = accuracy_gate(df, ["dataset", "clf"], min_accuracy, label)
    return fill_missing(df)


def accuracy_gate(df: DataFrame, keys: Sequence[str], min_accuracy: float, label: str) -> DataFrame:
    """Semi join with the groups that are accurate enough.

    Gates are few; the aggregate is combined on the map side, and AQE broadcasts its result.
    """
    good = (
        df.groupBy(*keys)
        .agg((F.lit(1.0) - F.avg(F.col(label).cast("double"))).alias("__acc"))
        .filter(F.col("__acc") >= min_accuracy)
        .select(*keys)
    )
    return df.join(good, list(keys), "left_semi")


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """By column name; measures a table lacks become 0."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out.na.fill(0)
