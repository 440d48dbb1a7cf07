"""Registry of named queries: a builder of a DataFrame, and oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphmill.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a Catalog under its name, with its oracle."""

    def register(build: Callable[[Catalog], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Catalog(spark, sf_dir))

        run.__name__, run.__doc__ = key, build.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return build

    return register
