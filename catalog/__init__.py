"""Registered queries: each operator wired to the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.fixtures import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``$name`` in ``sql`` stands for that fixture's table expression."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            text = sql
            for cte, body in CTES.items():
                text = text.replace(f"${cte}", body)
            ORACLES[name] = text
        return build

    return add


def r(expr: str, places: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"(round({expr}, {places}) + 0e0)"


def load_all() -> None:
    from catalog import (  # noqa: F401
        features, models, quality, scalars, scans, statistics, streams, windows,
    )
