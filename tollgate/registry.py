"""Every query of the monitoring engine, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import core, learned
from .streaming import queries as streaming_queries

_ALL = (core, learned, streaming_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLES)
