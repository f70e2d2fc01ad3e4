"""The list of checked queries: a Spark callable and, where SQL can say it, the SQL text it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is the equivalent DuckDB text over the given tables."""

    def wrap(fn):
        from skyloom.sources.tables import Tables, plain_times

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
