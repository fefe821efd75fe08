"""Regular-expression search through an index of three-character runs.

What a pattern cannot match without is read off it: alternatives, each a set of runs of
three characters that must all occur.  Only entities that have them are read and
verified by the pattern itself, so results equal those of a scan; a pattern that asks
for no such run (as ``a.b`` or ``x|yz``) is answered by the scan.

The index is a table (gram, slug) in folders by the hash of gram; a search reads the
folders of its own grams, and of the store the buckets of its candidates.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from re import _constants as c
from re import _parser as parser
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .buckets import BucketStore
from .listing import matching

FIELDS = ("company_name", "symbol", "isin")
SIZE = 3
#: Alternatives of a pattern beyond which it is answered by the scan.
MOST = 32


def _lower(text: Column) -> Column:
    """As a pattern that ignores case sees it: A-Z alone change."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _joined(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
    """Alternatives of one after the other. The first run of the second goes on from the last of the first; '' ends a run."""
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]


def _runs(items) -> list[list[str]]:
    """Alternatives of a parsed pattern, each a list of its literal runs in order, where neighbours are apart."""
    out = [[""]]
    for op, value in items:
        if op is c.LITERAL:
            own = [[chr(value)]]
        elif op is c.SUBPATTERN and not value[1] and not value[2]:
            own = _runs(value[3])
        elif op is c.BRANCH:
            own = [alternative for branch in value[1] for alternative in _runs(branch)]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] > 0:
            own = [["", *a, ""] if len(a) > 1 else ["", a[0], ""] for a in _runs(value[2])]
        elif op is c.AT:
            own = [["", ""]] if value not in (c.AT_BEGINNING, c.AT_END) else [[""]]
        else:
            own = [["", ""]]  # anything may stand here
        out = _joined(out, own)
        if len(out) > MOST:
            raise ValueError("too many alternatives")
    return out


def required_grams(pattern: str) -> list[set[str]] | None:
    """Sets of grams of which one must all occur in any match, or None if the pattern asks for none."""
    try:
        parsed = parser.parse(pattern)
        if parsed.state.flags & ~c.SRE_FLAG_UNICODE or "\\" in pattern or "(?" in pattern:
            return None  # flags and escapes mean other things in other dialects
        alternatives = _runs(parsed)
    except (parser.error, ValueError, OverflowError, RecursionError):
        return None
    lower = str.maketrans(ascii_uppercase, ascii_lowercase)
    grams = [{run[k : k + SIZE] for run in (r.translate(lower) for r in runs) for k in range(len(run) - SIZE + 1)} for runs in alternatives]
    return grams if grams and all(grams) else None


def grams_of(entities: DataFrame) -> DataFrame:
    """Columns gram, slug: the different runs of each entity's searched fields."""
    none = F.array().cast("array<string>")

    def runs(field: str) -> Column:
        text = _lower(F.col(field))
        own = F.transform(F.sequence(F.lit(1), F.length(field) - (SIZE - 1)), lambda k: F.substring(text, k, F.lit(SIZE)))
        return F.when(F.length(field) >= SIZE, own).otherwise(none)

    return entities.select("slug", F.explode(F.array_distinct(F.flatten(F.array(*[runs(f) for f in FIELDS])))).alias("gram")).select("gram", "slug")


def write_index(entities: DataFrame, path: str, folders: int = 64, size: int = 100_000) -> None:
    """Writes the index, the grams of about ``size`` entities a task. Ranges go on over the slugs of a gram, as one that all entities have would else be one task's."""
    ranges = max(1, math.ceil(entities.count() / size))
    part = F.pmod(F.xxhash64("gram"), F.lit(folders)).cast("int")
    rows = grams_of(entities).withColumn("folder", part).repartitionByRange(ranges, "folder", "gram", "slug").sortWithinPartitions("folder", "gram")
    rows.write.mode("overwrite").partitionBy("folder").parquet(path)


def candidates(spark: SparkSession, path: str, wanted: list[set[str]], folders: int = 64, rows: int = 500_000) -> DataFrame:
    """Slugs that have all grams of one of the sets.

    The rows of a slug lie in as many places as it has grams, so nothing is summed before they meet, about ``rows`` of them in a task.
    """
    grams = sorted({g for own in wanted for g in own})
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(folders)).cast("int").alias("folder"))
    numbers = sorted({r["folder"] for r in asked.distinct().collect()})
    index = spark.read.schema("gram string, slug string, folder int").parquet(path).where(F.col("folder").isin(numbers) & F.col("gram").isin(grams)).select("gram", "slug")
    dealt = index.repartition(max(1, math.ceil(index.count() / rows)), "slug")
    found = dealt.groupBy("slug").agg(*[F.count_if(F.col("gram").isin(sorted(own))).alias(f"_{k}") for k, own in enumerate(wanted)])
    return found.where(reduce(or_, [F.col(f"_{k}") == len(own) for k, own in enumerate(wanted)])).select("slug")


def search(store: BucketStore, index: str, pattern: str, folders: int = 64) -> DataFrame:
    """Entities with a match of the pattern in name, symbol or isin, ignoring case; the same as those of a scan."""
    wanted = required_grams(pattern)
    if wanted is None:
        return matching(store.entities(), search=pattern)
    found = Scratch(store.spark, "search").save(candidates(store.spark, index, wanted, folders), "candidates")
    return matching(store.of_slugs(found), search=pattern)
