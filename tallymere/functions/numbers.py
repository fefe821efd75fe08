"""Prices, prefix numbers and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let
from .names import SPACES, nonzero, trim

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def prefix_number(c: Column) -> Column:
    """The number that a text begins with, such as 12.5 of ``12.5%``; else null."""
    return F.regexp_extract(c, NUMBER, 1).try_cast("double")


def prefix_or_zero(c: Column) -> Column:
    return F.coalesce(prefix_number(c), F.lit(0.0))


def prefix_or_null(c: Column) -> Column:
    """As prefix_number, with 0 as missing."""
    return nonzero(prefix_number(c))


def half_up(x: Column, scale: int = 100) -> Column:
    """Rounded with halves towards plus infinity."""
    return F.floor(x * scale + 0.5) / scale


def _strict(c: Column) -> Column:
    """A whole text as a number: '' is 0, anything else must be a number."""
    return let(trim(c), lambda s: F.when(s == "", F.lit(0.0)).otherwise(s.try_cast("double")))


def _band(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("minimum"), high.cast("double").alias("maximum"))


def price_range(c: Column) -> Column:
    """Struct of minimum and maximum of a text such as ``Rs.326 to Rs.343``."""
    pattern = rf"(?i)[{SPACES}]+to[{SPACES}]+|[{SPACES}]*-[{SPACES}]*"
    none = F.lit(None)

    def of(parts: Column) -> Column:
        single = let(_strict(F.get(parts, 0)), lambda x: F.when(x > 0, x))
        return F.when(F.size(parts) == 2, _band(_strict(F.get(parts, 0)), _strict(F.get(parts, 1)))).when(F.size(parts) == 1, let(single, lambda x: _band(x, x))).otherwise(_band(none, none))

    clean = trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)Rs\.?", ""), ",", ""))
    return let(F.split(clean, pattern), of)


def price_band(c: Column) -> Column:
    """Struct of minimum and maximum: the first two runs of digits and commas."""

    def of(runs: Column) -> Column:
        number = lambda i: F.replace(F.get(runs, i), F.lit(","), F.lit("")).try_cast("double")
        return _band(number(0), F.coalesce(number(1), number(0)))

    return let(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d[\d,]*)"), 1), of)


def premium_percentage(given: Column, premium: Column, price: Column) -> Column:
    return F.coalesce(given, F.floor(premium / nonzero(price) * 10000 + 0.5) / 100)


def opening_gain(listing: Column, issue: Column) -> Column:
    """Percent above the issue price; null without either price."""
    return F.floor((listing - nonzero(issue)) / nonzero(issue) * 10000 + 0.5) / 100
