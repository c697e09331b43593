"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.oracle_parts import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, tuple[list[str], str]] = {}


def query(name: str, parts: list[str] | None = None, oracle: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = (parts or [], oracle)
        return build

    return add


def oracles() -> dict[str, str]:
    return {name: sql(parts, body) for name, (parts, body) in _ORACLES.items()}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])
