"""Helpers the text operators share: columns, batches of texts as bytes, stable row choice."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOC_ID, TEXT = "doc_id", "text"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found without regard to case; further columns, whatever their names, are left out."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def id_and_text(docs: DataFrame, null_text: str | None = None) -> DataFrame:
    """``doc_id`` as long and ``text`` as string; nulls of the text become ``null_text`` if that is given."""
    text = F.col(TEXT).cast("string")
    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), (text if null_text is None else F.coalesce(text, F.lit(null_text))).alias(TEXT))


SLICE_BYTES = 1 << 22


def release_memory() -> None:
    """Memory that is free in this process goes back to the system.

    A Python worker outlives its task, and while it waits for another one the executor's limit counts what it holds.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``fn`` over Arrow batches in the tasks, about 4 MB or one row at a time, so Python objects of few rows exist at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
            for start in range(0, batch.num_rows, step):
                out = fn(batch.slice(start, step))
                if out is not None and out.num_rows:
                    yield out
                out = None
            batch = None
        release_memory()

    return df.mapInArrow(run, schema)


def utf8_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string column as one array of bytes, and the n + 1 offsets; nulls count as empty."""
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of the SplitMix generator."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any byte range in O(1) from prefix sums modulo 2**64.

    Byte ``b`` at position ``j`` adds ``table[b] * base**j``; a range's sum times ``base**-start`` does not
    depend on where it stands. ``table`` is random, ``base`` odd.
    """

    def __init__(self, seed: int):
        self.table = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 17))
        self.base = int(splitmix(np.array([seed + 5], np.uint64))[0]) & ~7 | 5  # 5 modulo 8: a long period
        self.inverse = pow(self.base, -1, 1 << 64)
        self._power = self._back = np.ones(1, np.uint64)

    @staticmethod
    def _grown(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums before each position, n + 1 of them."""
        if len(self._power) < len(data) + 1:
            self._power = self._grown(self._power, self.base, len(data) + 1)
            self._back = self._grown(self._back, self.inverse, len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self._power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self._back[start]


def by_hash(*columns: Column, seed: str = "") -> Column:
    """A number that depends on the values alone, for choices that have to be the same in each run."""
    return F.xxhash64(F.lit(seed), *columns)


def least_by_hash(df: DataFrame, most: int, *columns: Column, seed: str) -> DataFrame:
    """At most ``most`` rows: those whose hash of ``columns`` is least, and of equal hashes any.

    A share of the hashes that holds about that many rows is filtered first, so that the tasks together, however many
    they are, hand on about ``most`` rows and not ``most`` rows each.
    """
    rows = df.count()
    hashed = df.withColumn("__hash", by_hash(*columns, seed=seed))
    if rows > most:
        share = min(1.0, (1.1 * most + 100) / rows)
        hashed = hashed.filter(F.col("__hash") < int(-(2**63) + share * 2**64) if share < 1 else F.lit(True))
    return hashed.orderBy("__hash").limit(most).drop("__hash")


def frame_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch from numpy arrays, lists or Arrow arrays, in the schema's order."""
    arrays = []
    for field in schema:
        value = columns[field.name]
        arrays.append(value if isinstance(value, pa.Array) and value.type == field.type else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
