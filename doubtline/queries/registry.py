"""Query names to Spark plans and to the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}
MODULES = ("basics", "aggregates", "neighbours", "measuring", "detecting", "learning", "streams")


def query(name: str, sql: str | None = None):
    def add(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"doubtline.queries.{module}")


def all_queries() -> dict[str, Plan]:
    _load()
    return dict(PLANS)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for comparison across engines."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema
        ]
    )
