"""The batch run over a growing landing folder, one version of the store for each micro-batch.

A micro-batch reads the version before it and writes its own, named by its
number, so a batch that is tried again overwrites what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.scrape import run_feeds
from ..plans.scratch import scope
from ..schemas import SOURCES

LANDING = "source string, ord bigint, payload string"


def version(store: str, number: int) -> str:
    return f"{store}/version={number}"


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, clock: Callable[[], str], today: Callable[[], str]) -> StreamingQuery:
    """Takes what has arrived in ``landing`` (JSON lines of LANDING) into the store, then ends; run again, it takes what is new."""

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        feeds = {s: batch.where(f"source = '{s}'").select("ord", "payload") for s in SOURCES}
        before = session.read.parquet(version(store, number - 1)) if number else None
        with scope(session):  # tables of the run go when its version is written
            run_feeds(feeds, before, clock(), today()).state.write.mode("overwrite").parquet(version(store, number))

    rows = spark.readStream.schema(LANDING).json(landing)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
