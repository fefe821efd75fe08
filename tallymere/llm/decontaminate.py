"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size (powers of two of their shingle counts).
In a partition every item has a MinHash sketch of one length, its smallest
shingle hashes (bottom-k), so many of them that a document which contains the
wanted share of an item must contain at least the sketch less the shingles
that may be missing.  A sketch of the document itself would hold next to
nothing of a short item, so documents probe with all their shingles, and no
contaminated document is missed.  However long a document is, its shingles probe the
sketches where they are read; only hits are shuffled.  Candidates are verified
by exact containment of the shingles themselves.

All steps are DataFrame expressions.  The sketches are broadcast while their
counted rows are few, and joined by a shuffle beyond that.

Defined results: null or empty texts, on either side, have no shingles and
match nothing; a text of fewer than ``width`` words has its whole sequence as
its one shingle; repeated rows give repeated pairs; items with a null item_id
or one that other items have too are searched like all others; other columns
are not read, and keep() returns the input's columns unchanged.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import sized
from ..plans.scratch import Scratch


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, r"[ \t\n\x0B\f\r]+"), "")


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, where a column named in a lambda function would be computed for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _runs(items: Column, width: int, combine) -> Column:
    """``combine`` of each ``width`` neighbours of an array; of all, if there are fewer."""

    def runs(a: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: combine([F.get(a, i + k) for k in range(width)]))
        return F.when(F.size(a) >= width, many).when(F.size(a) > 0, F.array(combine([a])))

    return let(items, runs)


def _hashed(frame: DataFrame, text: str, width: int, keep: list[str]) -> DataFrame:
    """Columns ``keep``, and ``codes``: hashes of the shingles of a text in order."""
    coded = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    return frame.select(*keep, _runs(coded, width, lambda part: F.xxhash64(*part)).alias("codes"))


def _spelt(frame: DataFrame, text: str, width: int, keep: list[str]) -> DataFrame:
    """Columns ``keep``, and ``shingles``: the different shingles as strings."""
    return frame.select(*keep, F.array_distinct(_runs(words(F.col(text)), width, lambda part: F.concat_ws(" ", *part))).alias("shingles"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document and item of which it contains at least ``percent`` of the shingles:
    doc_id, item_id, n_item_shingles, n_shared."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    codes = [F.xxhash64("text").alias("text_code"), F.hash("text").alias("text_check")]
    text_key = ["text_code", "text_check"]
    coded = docs.select("doc_id", "text", *codes).where("text is not null")

    # rows of equal sets are one item, whatever their item_id
    listed = _hashed(benchmark.select("item_id", "text"), "text", width, ["item_id", "text"]).where("codes is not null")
    listed = scratch.save(listed.withColumn("codes", F.array_sort(F.array_distinct("codes"))).withColumn("item", F.xxhash64("codes")), "items")
    items = listed.groupBy("item").agg(F.first("codes").alias("codes"), F.first("text").alias("text")).withColumn("n", F.size("codes"))
    upper = (F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1).cast("int")  # largest size in the item's partition
    missing = F.floor(F.col("n") * (100 - percent) / 100).cast("int")
    length = F.least(F.floor(upper * (100 - percent) / 100).cast("int") + 1, F.col("n"))
    sketches = scratch.save(items.select("item", (length - missing).alias("needed"), F.explode(F.slice("codes", F.lit(1), length)).alias("code")), "sketches")

    probes = _hashed(coded, "text", width, text_key).select(*text_key, F.explode("codes").alias("code"))
    hits = probes.join(sized(sketches), "code").groupBy(*text_key, "item").agg(F.count_distinct("code").alias("hits"), F.max("needed").alias("needed"))
    candidates = scratch.save(hits.where("hits >= needed").select(*text_key, "item"), "candidates")

    # each different text is verified once
    texts = coded.join(sized(candidates.select(*text_key).distinct()), text_key).groupBy(*text_key).agg(F.first("text").alias("text"))
    spelt = _spelt(texts, "text", width, text_key).withColumnRenamed("shingles", "own")
    known = _spelt(items, "text", width, ["item"])
    found = (
        candidates.join(spelt, text_key).join(known, "item")
        .select(*text_key, "item", F.size("shingles").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"))
        .where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent)
    )
    found = scratch.save(found, "found").join(sized(listed.select("item", "item_id")), "item")
    out = coded.select("doc_id", *text_key).join(sized(found), text_key).select("doc_id", "item_id", "n_item_shingles", "n_shared")
    scratch.drop("sketches", "candidates")
    return out


def keep(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id has no contaminated row. Rows with a null doc_id stay unless such a row is contaminated."""
    bad = sized(contamination(docs, benchmark, width, percent).select(F.col("doc_id").alias("bad_id")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)


OP7_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS rid, text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
s AS (
  SELECT side, id, rid, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM w WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT side, id, rid, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM s),
n AS (SELECT rid, count(*) AS n_item_shingles FROM g WHERE side = 'b' GROUP BY rid)
SELECT d.id AS doc_id, b.id AS item_id, n.n_item_shingles, count(*) AS n_shared
FROM g d JOIN g b ON d.side = 'd' AND b.side = 'b' AND d.shingle = b.shingle JOIN n ON n.rid = b.rid
GROUP BY d.id, d.rid, b.id, b.rid, n.n_item_shingles HAVING count(*) * 100 >= n.n_item_shingles * 80
"""
