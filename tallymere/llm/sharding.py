"""Sharding by a two-pass external shuffle.

Pass one scatters the records over memory-sized buckets by a seeded hash of
their key columns; pass two puts each bucket in the order of a seeded
Fisher-Yates shuffle.  The buckets one after another are a random order of
all records; dealt round-robin, every shard gets an equal count of records
(at most one apart) and gapless slots.  The order depends on the seed and the
records alone, so a task that runs again writes the same rows.

Only one count for each bucket is gathered besides the records themselves,
which are shuffled once.  A group of equal texts is spread like other rows, as
the hash covers the identifier too.

Defined results: null columns hash as absent and stay null; an empty table
gives an empty result; records equal in all key columns share a bucket and
are interchangeable there; input columns are kept inside the struct ``row``,
so that no name can clash with ``bucket``, ``shard`` or ``slot``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def shuffle_to_shards(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 17,
    key: Sequence[str] = ("doc_id", "text"),
    size: Column | None = None,
    bucket_bytes: int = 32 << 20,
) -> DataFrame:
    """Columns row (struct of the input's columns), bucket, shard (from 0), slot (from 0, gapless in its shard).

    ``size`` gives the bytes of a record, by default those of its text;
    ``bucket_bytes`` is the mean size of a bucket, which one task holds in memory.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if size is None else size
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    code = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key])
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        code.alias("code"),
        F.pmod(F.xxhash64(code, F.lit(seed)), F.lit(n_buckets)).alias("bucket"),
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )

    def deal(table: pa.Table) -> pa.Table:
        bucket, start = table["bucket"][0].as_py(), table["start"][0].as_py()
        order = np.argsort(table["code"].to_numpy(), kind="stable")
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]  # Fisher-Yates
        place = np.arange(start, start + len(order))
        return pa.table({
            "row": table["row"].take(pa.array(order)),
            "bucket": table["bucket"],
            "shard": pa.array((place % n_shards).astype(np.int32)),
            "slot": pa.array(place // n_shards),
        })

    row_type = keyed.schema["row"].dataType.simpleString()
    return keyed.join(starts, "bucket").groupBy("bucket").applyInArrow(deal, f"row {row_type}, bucket long, shard int, slot long")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard into its own folder ``shard=N`` of Parquet files; slot is the order inside it."""
    shuffled.write.mode("overwrite").partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shuffled = shuffle_to_shards(docs, n_shards=8)
    scratch = Scratch(spark, "shards")
    write_shards(shuffled, f"{scratch.path}/shards")
    written = spark.read.schema(shuffled.schema).parquet(f"{scratch.path}/shards")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return written.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
