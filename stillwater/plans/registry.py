"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def scalar(
    name: str, base: Query, base_sql: str, keys: list[str], columns: Callable[[], dict[str, Column]], texts: dict[str, str]
) -> None:
    """Registers a projection of ``base``: Spark columns, made when the query runs, and the same as SQL over base_sql."""
    sql = ", ".join([*keys, *[f"{text} AS {c}" for c, text in texts.items()]])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns()
        return base(spark, sf_dir).select(*keys, *[made[c].alias(c) for c in texts])

    query(name, f"SELECT {sql} FROM ({base_sql}) AS base")(run)
