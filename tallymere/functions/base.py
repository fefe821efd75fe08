"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once and named once in the plan, however often it is used.

    Without it, a parsed text that several branches look at would be repeated in each of them.
    """
    return F.get(F.transform(F.array(value), then), 0)
