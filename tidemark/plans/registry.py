"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import queries as deterministic
from tidemark.plans import sampled, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**deterministic.QUERIES, **sampled.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
