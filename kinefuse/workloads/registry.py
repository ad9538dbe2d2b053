"""Where queries and their checks register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str, spread: str | None = None) -> DataFrame:
    """A benchmark table. Its times have no zone; the session reads them as UTC.

    With `spread`, the rows are redistributed by that key, for queries whose work per row is heavy.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return rows if spread is None else rows.repartition(spread)
