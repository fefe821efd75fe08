"""Scans over landing tables: keyed unions, detail lookups, exchange fallback.

Landing tables hold what a feed delivered, one row an item, with ``ord`` as the
order of arrival.  Every scan is a plan over such tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def in_ranges(rows: DataFrame, *order: str | Column, name: str = "ord", ranges: int | None = None) -> DataFrame:
    """Rows with their number by ``order``, from 0 without gaps, as ``name``, and ``_part``, the range of the order that they are in.

    Rows that are equal in the order are numbered in any order.  Ranges are sorted apart and written; a range begins after all rows of those before it.
    Their number is up to Spark where it isn't given.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    sorted_ = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    sorted_ = scratch.save(sorted_, "sorted")
    parts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_part").alias("_of"), "_first", before.alias("_before"))
    met = sorted_.join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    return met.withColumn("_number", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_of", "_first", "_before", name).withColumnRenamed("_number", name)


def numbered(rows: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """As in_ranges, without the columns of the order and the ranges."""
    return in_ranges(rows, *order, name=name).drop(*[c for c in order if c != name], "_part")


def read_landing(spark: SparkSession, path: str, schema: str = "ord bigint, id string, list_no int, payload string") -> DataFrame:
    """A landing folder of JSON lines, by declared schema."""
    return spark.read.schema(schema).json(path)


def last_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, at the first one's place: the keyed union in which later lists win. Null keys go."""
    backward = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return (
        rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(backward))
        .withColumn("position", F.min(F.struct(*order)).over(Window.partitionBy(key))).where("_n = 1").drop("_n")
    )


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key: the keyed union in which earlier lists win. Null keys go."""
    forward = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(forward)).where("_n = 1").drop("_n")


def with_detail(items: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Payload of the detail where there is one, else of the list item. Details are unique by key."""
    own = details.select(key, F.col("payload").alias("_detail"))
    return items.join(own, key, "left").withColumn("payload", F.coalesce("_detail", "payload")).drop("_detail")


def limited_details(items: DataFrame, details: DataFrame, most: int, key: str = "id", order: str = "ord") -> DataFrame:
    """Details for the first ``most`` items only; the others keep a null detail."""
    chosen = items.orderBy(order).limit(most).select(key)
    return items.join(details.join(chosen, key, "left_semi").select(key, F.col("payload").alias("detail")), key, "left")


def without_listed(records: DataFrame) -> DataFrame:
    """Drops listed records; those without a status stay."""
    return records.where(~F.col("status").eqNullSafe("listed"))


def known_sources(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested sources that the registry doesn't have, as error rows."""
    return names.join(registry, "source", "left_anti").select("source", F.lit("unknown source").alias("error"))


def candles_by_exchange(rows: DataFrame) -> DataFrame:
    """Of candles (isin, exchange, found, candles), the first exchange that knows the instrument, NSE_EQ before BSE_EQ. An empty answer is final."""
    rank = F.when(F.col("exchange") == "NSE_EQ", 0).otherwise(1)
    w = Window.partitionBy("isin").orderBy(rank)
    return rows.where("found").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def candle_struct(values):
    """Positional array of texts (time, open, high, low, close, volume, oi) to the candle struct; the date is the text before T."""
    number = lambda i: F.get(values, i).try_cast("double")
    return F.struct(
        F.substring_index(F.get(values, 0), "T", 1).alias("date"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"),
        number(4).alias("close"), number(5).cast("long").alias("volume"), number(6).cast("long").alias("oi"),
    )
