"""Where queries and the SQL they are checked against are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tapeloom.session import safe_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
            safe_unions(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = guarded
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
