"""Time series: candles, listing performance, premium history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import premium_date
from ..functions.numbers import opening_gain, prefix_or_zero


def historical(candles: DataFrame, key: str, issue_price: Column) -> DataFrame:
    """Listing block of each key from candles (key, ord, date, open, high, low, close): its first and last day. Equal dates go by ord.

    Partial aggregates carry one candle for each end, so nothing is sorted.
    """
    place = F.struct("date", "ord")
    first = F.min_by(F.struct("open", "high", "low", "close"), place)
    last = F.max_by(F.struct("close", "date"), place)
    ends = candles.groupBy(key).agg(first.alias("f"), last.alias("l"), F.max(issue_price).alias("issue"))
    listing = F.coalesce("f.open", "f.close")
    return ends.select(
        key, listing.alias("listing_price"), F.col("f.high").alias("day_high"), F.col("f.low").alias("day_low"), F.col("l.close").alias("current_price"),
        opening_gain(listing, F.col("issue")).alias("opening_gain"), F.col("l.date").alias("as_of"),
    )


def merge_candles(stored: DataFrame, incoming: DataFrame, key: str = "isin") -> DataFrame:
    """Price history of each key: by date, incoming over stored, later over earlier, rising."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).where("date is not null and date <> ''")
    one = both.groupBy(key, "date").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "oi"), F.struct("_new", "ord")).alias("c"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "c.*"))).alias("candles"))


def upsert_points(stored: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Premium points by (slug, date): the last incoming value wins; untouched points stay as stored."""
    new = incoming.groupBy("slug", "date").agg(F.max_by("value", "ord").alias("value")).select(
        "slug", "date", "value", F.lit("investorgain").alias("source"), F.lit(now).alias("updated_at")
    )
    return stored.join(new, ["slug", "date"], "left_anti").unionByName(new)


def new_points(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many (slug, date) of each slug weren't stored before."""
    fresh = incoming.select("slug", "date").distinct().join(stored, ["slug", "date"], "left_anti")
    return fresh.groupBy("slug").agg(F.count(F.lit(1)).alias("added"))


def latest_of_day(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("slug", "date").orderBy(F.col("ord").desc())
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def premium_series(rows: DataFrame) -> DataFrame:
    """Points (id, date, gmp) from a premium feed's daily rows (id, gmp_date, gmp as texts). Rows without a readable date go; an unreadable premium is 0."""
    return rows.select("id", premium_date(F.col("gmp_date")).alias("date"), prefix_or_zero(F.col("gmp")).alias("gmp")).where("date is not null")


def candle_of_day(candles: DataFrame, key: str, day: str) -> DataFrame:
    """The first candle (by ord) of each key on a day."""
    one = candles.where(F.col("date") == day)
    rest = [c for c in candles.columns if c not in (key, "ord")]
    return one.groupBy(key).agg(F.min_by(F.struct(*rest), "ord").alias("c")).select(key, "c.*")


def candle_actions(records: DataFrame, candles: DataFrame) -> DataFrame:
    """Of each record (slug, status, isin): updated if it is listed, has an isin, and candles came for it; else skipped."""
    known = candles.select("isin").distinct().withColumn("_came", F.lit(True))
    wanted = (F.col("status") == "listed") & (F.coalesce(F.col("isin"), F.lit("")) != "")
    came = records.join(known, "isin", "left")
    return came.select("slug", F.when(wanted & F.col("_came"), "updated").otherwise("skipped").alias("action"))
