"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("doubtline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "local").startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is made up only for local sessions that name none.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if path:
        return path
    if not is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    path = tempfile.mkdtemp(prefix="doubtline-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for one written table."""
    return os.path.join(shared_dir(spark), "doubtline", f"{tag}-{uuid.uuid4().hex}")


def hidden(name: str) -> str:
    """A name for a column of one plan that no caller's column has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage at a place that outlives lost executors. Column metadata
    (vector widths) is put back, as it is needed at plan time. Rows of a value of
    ``by`` are in a folder of their own, which a filter reads alone.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
