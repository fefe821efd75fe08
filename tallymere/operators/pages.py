"""Pages of a listing by place, however deep, from a copy of the store in the listing's order.

The copy lies in folders, one for each range of the order, and a small table beside it
says where each range begins.  A page reads the folders that hold its places, and of
these the row groups; a token, the last place of a page, leads to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scans import in_ranges
from .listing import order_of, page_of


def write_pages(entities: DataFrame, path: str, sort: str | None = None, order: str | None = None, ranges: int = 64) -> None:
    """Writes the entities by the order of the listing, with their ``place`` in it."""
    rows = in_ranges(entities, *order_of(sort, order), name="place", ranges=ranges).withColumnRenamed("_part", "range")
    rows.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    ranges = entities.sparkSession.read.parquet(f"{path}/rows").groupBy("range").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Entities from one place to another, in order."""
    found = spark.read.parquet(f"{path}/ranges").where((F.col("first") <= last) & (F.col("last") >= first)).select("range").collect()  # the ranges of a page
    rows = spark.read.parquet(f"{path}/rows").where(F.col("range").isin([r[0] for r in found]) & F.col("place").between(first, last))
    return rows.drop("range").orderBy("place")


def page_at(spark: SparkSession, path: str, page=None, limit=None) -> DataFrame:
    """A page by its number, as list_entities counts them."""
    page, limit = page_of(page, limit)
    return between(spark, path, (page - 1) * limit, page * limit - 1)


def page_after(spark: SparkSession, path: str, token: int = -1, limit=None) -> DataFrame:
    """The page after the place ``token``."""
    _, limit = page_of(1, limit)
    return between(spark, path, token + 1, token + limit)
