"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of two or three numbers that a join may broadcast; larger tables are shuffled.
BROADCAST_ROWS = 500_000


def sized(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most ``limit`` rows. It should be cheap to count."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Of links (a, b), columns node, component: the smallest node that it reaches. Nodes without links are absent.

    Each round hangs neighbours below the least neighbour of a node; the
    rounds needed grow with the logarithm of the largest component.  A round
    is written to shared storage, so lineage stays short.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turn += 1
        edges = scratch.save(small.union(least).distinct(), f"{name}-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        scratch.drop(f"{name}-{turn - 1}")
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
