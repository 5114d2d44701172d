"""Named queries over the given tables, with the SQL that defines their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, and its SQL where there is one."""

    def add(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add
