"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import core, fits, logs, training


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*core.QUERIES, *logs.QUERIES, *fits.QUERIES, *training.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return core.oracle_sql() | logs.oracle_sql() | fits.oracle_sql() | training.ORACLE
