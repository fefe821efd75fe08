"""Registration of queries and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-06-15T00:00:00.000Z"
TODAY = "2024-03-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL that gives the same rows where SQL can."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(frame: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """A table of small rows that take much work each, dealt by their number: split by bytes, all of them may be one task."""
    return frame.repartition(max(1, math.ceil(frame.count() / rows)), key)
