"""Expressions over fixed-length ``array<double>`` columns.

A vector column carries its length in column metadata (``width``). Where the length is known
and small the expressions are unrolled, so that they stay inside whole-stage code generation;
otherwise they fall back to the higher-order array functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_LIMIT = 32
DOUBLE_MAX = 1.7976931348623157e308


def vector(column, width: int, name: str) -> Column:
    """Name a vector column and note its length."""
    return column.alias(name, metadata={"width": int(width)})


def pack(columns: Sequence, name: str = "features") -> Column:
    """Plain numeric columns to one vector column."""
    cols = [(c if isinstance(c, Column) else F.col(c)).cast("double") for c in columns]
    return vector(F.array(*cols), len(cols), name)


def width_of(df: DataFrame, name: str) -> int:
    """Vector length: from metadata, or else from the first row."""
    known = df.schema[name].metadata.get("width")
    if known is not None:
        return int(known)
    row = df.select(F.size(name).alias("n")).first()
    if row is None:
        raise ValueError(f"cannot tell the length of {name!r}: the table is empty")
    return int(row.n)


def known_width(df: DataFrame, name: str) -> int | None:
    width = df.schema[name].metadata.get("width")
    return None if width is None else int(width)


def with_width(df: DataFrame, name: str, width: int) -> DataFrame:
    return df.withColumn(name, vector(F.col(name), width, name))


def double_literal(value: float) -> str:
    value = float(value)
    if math.isnan(value):
        return "double('NaN')"
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"{value!r}D"


def lit_vector(values) -> Column:
    """A constant ``array<double>``; folded to one literal by Catalyst."""
    return F.expr("array(" + ", ".join(double_literal(v) for v in values) + ")")


def item(array, index: int) -> Column:
    return F.get(F.col(array) if isinstance(array, str) else array, F.lit(index))


def total(terms: Sequence[Column]) -> Column:
    """Sum of columns, from left to right."""
    return reduce(lambda a, b: a + b, terms)


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def array_total(array) -> Column:
    return F.aggregate(_column(array), F.lit(0.0), lambda acc, x: acc + x)


def at(name: str, index: int) -> str:
    """SQL text of one entry. Long unrolled expressions are written as text: one parser call
    instead of a gateway call per operator."""
    return f"get({name}, {index})"


def sum_text(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _unrolled(width: int | None, *names) -> bool:
    return width is not None and width <= UNROLL_LIMIT and all(isinstance(n, str) for n in names)


def squared_distance(a, b, width: int | None = None) -> Column:
    if _unrolled(width, a, b):
        gaps = [f"({at(a, j)} - {at(b, j)})" for j in range(width)]
        return F.expr(sum_text([f"{g} * {g}" for g in gaps]))
    return array_total(F.zip_with(_column(a), _column(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b, width: int | None = None) -> Column:
    return F.sqrt(squared_distance(a, b, width))


def mean_absolute_error(a, b, width: int | None = None) -> Column:
    if _unrolled(width, a, b):
        return F.expr(sum_text([f"abs({at(a, j)} - {at(b, j)})" for j in range(width)]) + f" / {float(width)}D")
    errors = F.zip_with(_column(a), _column(b), lambda x, y: F.abs(x - y))
    return array_total(errors) / F.size(_column(a))


def share_inside(x, low, high, width: int | None = None) -> Column:
    """Share of the positions with ``low <= x <= high``; a missing bound counts as outside.

    NaN bounds need a test of their own: Spark orders NaN above every number.
    """
    if _unrolled(width, x, low, high):
        cells = [
            f"CASE WHEN {at(low, j)} <= {at(x, j)} AND {at(x, j)} <= {at(high, j)} "
            f"AND NOT isnan({at(low, j)}) AND NOT isnan({at(high, j)}) THEN 1D ELSE 0D END"
            for j in range(width)
        ]
        return F.expr(sum_text(cells) + f" / {float(width)}D")

    def inside(v, lo, hi):
        ok = (lo <= v) & (v <= hi) & ~F.isnan(lo) & ~F.isnan(hi)
        return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))

    bounds = F.arrays_zip(_column(low).alias("lo"), _column(high).alias("hi"))
    flags = F.zip_with(_column(x), bounds, lambda v, b: inside(v, b["lo"], b["hi"]))
    return array_total(flags) / F.size(_column(x))


def is_bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))


def clean_vector(array) -> Column:
    """Missing, NaN and infinite entries to 0."""
    return F.transform(_column(array), lambda x: F.when(is_bad(x), F.lit(0.0)).otherwise(x))


def clean_measure(x) -> Column:
    """Missing, NaN and infinite measures to -10, the mark of an unusable measure."""
    x = _column(x)
    return F.when(is_bad(x), F.lit(-10.0)).otherwise(x)


def clean_judge_input(x) -> Column:
    """NaN and missing to 0, infinities to the largest finite double of their sign."""
    x = _column(x)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(0.0))
        .when(x == F.lit(math.inf), F.lit(DOUBLE_MAX))
        .when(x == F.lit(-math.inf), F.lit(-DOUBLE_MAX))
        .otherwise(x)
    )


def min_max(array: str, low: Sequence[float], high: Sequence[float], name: str = "features") -> Column:
    """Scale by known bounds; constant features stay as they are."""
    cells = [
        f"({at(array, j)} - ({double_literal(lo)})) / {double_literal(hi - lo)}" if hi != lo else at(array, j)
        for j, (lo, hi) in enumerate(zip(low, high))
    ]
    return vector(F.expr(f"array({', '.join(cells)})"), len(cells), name)


def as_text(array, decimals: int | None = None) -> Column:
    """``[a;b;c]``"""
    cells = _column(array)
    if decimals is not None:
        cells = F.transform(cells, lambda x: F.format_string(f"%.{decimals}f", x))
    else:
        cells = F.transform(cells, lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.concat_ws(";", cells), F.lit("]"))


# --- Arrow-batched numpy, for matrix work that has no built-in expression ------------------


def to_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column to a 2-D array, without a Python loop.

    A null vector is missing and counts as zeros, like a missing value; vectors of different lengths raise.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not rows:
        return flat.reshape(0, 0)
    if column.null_count == rows:
        return np.zeros((rows, 1))
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} and of {lengths['max']} numbers in one column")
    if not column.null_count:
        return flat.reshape(rows, -1)
    out = np.zeros((rows, lengths["max"]))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = flat.reshape(rows - column.null_count, -1)
    return out


def from_matrix(matrix: np.ndarray) -> pa.Array:
    rows, cols = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * cols)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def matrix_to_scalar(fn: Callable[[np.ndarray], np.ndarray]):
    """``X (n x d) -> y (n)`` as a column function over one vector column."""

    @F.arrow_udf("double")
    def apply(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.float64())
        return pa.array(np.asarray(fn(to_matrix(column)), dtype=np.float64))

    return apply


def matrix_to_matrix(fn: Callable[[np.ndarray], np.ndarray]):
    """``X (n x d) -> Y (n x m)`` as a column function over one vector column."""

    @F.arrow_udf("array<double>")
    def apply(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return from_matrix(np.asarray(fn(to_matrix(column)), dtype=np.float64))

    return apply
