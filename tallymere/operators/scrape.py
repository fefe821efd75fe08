"""A whole run: from the feeds' landing rows to the new store, and what happened on the way."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..schemas import SOURCES
from ..sources import feeds as scans
from ..sources.mappers import standard_records
from ..sources.scans import without_listed
from .entity import to_entities
from .match import Merge, deduplicate
from .store import upsert
from .timeline import with_timeline


@dataclass
class Run:
    state: DataFrame | None  #: the new store; None for a dry run
    actions: DataFrame | None  #: slug, action, changes
    entities: DataFrame  #: what the feeds give, merged, without listed ones
    counts: DataFrame  #: source, records (of each source asked for)
    merged: DataFrame  #: one row: records, masters, listed_dropped
    errors: DataFrame  #: source, error: names that no feed has
    merge: Merge

    @property
    def borderline(self) -> DataFrame:
        """Near misses of the merge."""
        return self.merge.misses


def merge_counts(masters: DataFrame) -> DataFrame:
    """One row: records that went into entities, entities, and those of them that are dropped as listed."""
    return masters.agg(F.coalesce(F.sum("n_members"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("masters"), F.count_if(F.col("status") == "listed").alias("listed_dropped"))


def run_feeds(feeds: dict[str, DataFrame], stored: DataFrame | None, now: str, today: str, sources: Sequence[str] = SOURCES, dry_run: bool = False) -> Run:
    """Standardise the feeds (source name to items that were keyed and met with details before: ord, payload), merge across them, and upsert into the store.

    Without a store (None) all entities are new.  A source that isn't known gives an error row and stops nothing.
    """
    known = [s for s in sources if s in feeds]
    records = standard_records({s: feeds[s] for s in known}, today) if known else standard_records(feeds, today).limit(0)
    return run_records(records, list(feeds), stored, now, sources, dry_run)


def run_landed(landed: dict[str, tuple[DataFrame, DataFrame | None]], stored: DataFrame | None, now: str, today: str, sources: Sequence[str] = SOURCES, dry_run: bool = False) -> Run:
    """As run_feeds, from what the feeds delivered: source name to its lists and details, by the scans of ``sources.feeds``."""
    scan = {"upstox": scans.upstox, "nse": scans.nse, "groww": scans.groww, "zerodha": lambda pages, details: scans.zerodha(pages, details, today)}
    records = None
    for source in SOURCES:
        if source in landed:
            own = scan[source](*landed[source])
            own = own if source in sources else own.limit(0)
            records = own if records is None else records.unionByName(own)
    return run_records(records, list(landed), stored, now, sources, dry_run)


def run_records(records: DataFrame, known: Sequence[str], stored: DataFrame | None, now: str, sources: Sequence[str] = SOURCES, dry_run: bool = False) -> Run:
    """Merge standard records of the known sources and upsert them into the store."""
    spark = records.sparkSession
    scratch = Scratch(spark, "run")
    asked = spark.createDataFrame([(s,) for s in sources], "source string")
    records = scratch.save(records, "records")
    merge = deduplicate(records)
    masters = scratch.save(merge.masters, "masters")
    kept = without_listed(masters)
    entities = to_entities(with_timeline(kept, now), now)
    counts = asked.join(records.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("records"))
    merged = merge_counts(masters)
    errors = asked.where(~F.col("source").isin(list(known))).select("source", F.lit("unknown source").alias("error"))
    if dry_run:
        return Run(None, None, entities, counts, merged, errors, merge)
    # the merge's order decides which of two entities with one key comes first
    batch = to_entities(with_timeline(kept, now), now, "first_ord")
    old = entities.withColumn("created_at", F.lit(now)).limit(0) if stored is None else stored
    state, actions = upsert(old, batch, now, order="first_ord")
    return Run(state, actions, entities, counts, merged, errors, merge)
