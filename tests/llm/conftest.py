import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, numbered from 0, or from (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = docs_of([(None, "some words of a text without an id"), (None, None), (1, ""), (2, "  \n\t "), (3, "same row"), (3, "same row"), (4, "long " * 30_000), (5, "x" * 60_000), (6, "ünï çödé 漢字 \U0001f600")])
    for name in ("score", "shard", "slot", "fp", "u", "v", "start", "n", "key", "kept", "ids", "ranges", "Label", "component_id", "size", "law", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def table(sf):
    """A table of the test data as Python rows."""

    def read(name, columns="*"):
        return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()

    return read
