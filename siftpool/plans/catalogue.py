"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftpool.plans import learning, screening, shaping, tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return screening.QUERIES | shaping.QUERIES | learning.QUERIES | tables.QUERIES


def oracle_sql() -> dict[str, str]:
    return screening.SQL | shaping.SQL | learning.SQL | tables.SQL
