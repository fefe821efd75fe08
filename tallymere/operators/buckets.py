"""A store in buckets, of which a batch reads and writes only those it touches.

Entities lie in folders by the hash of their slug; two tables beside them, by the hash
of the key, say which slugs hold an isin and which a symbol.  A batch asks these tables
for its own keys, so it finds the entities that it can meet without reading the others,
upserts against those alone, and overwrites the buckets of what it changed.

What a batch collects is a list of bucket numbers, at most as many as there are
buckets; the number of buckets is fixed when a store is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scratch import Scratch
from .store import prepared, upsert_fresh

KEYS = ("isin", "symbol")


@dataclass
class BucketStore:
    spark: SparkSession
    path: str
    schema: str  #: of an entity
    buckets: int = 64

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c)), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, numbers: list[int] | None = None) -> DataFrame:
        schema = f"{self.schema}, bucket int" if name == "entities" else "key string, slug string, bucket int"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:  # a store begins without folders
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows if numbers is None else rows.where(F.col("bucket").isin(numbers))

    def entities(self) -> DataFrame:
        """All entities."""
        return self._read("entities").drop("bucket")

    def of_slugs(self, slugs: DataFrame) -> DataFrame:
        """The entities of a table (slug), out of their buckets alone."""
        return self._read("entities", self._numbers(slugs, "slug")).drop("bucket").join(slugs.select("slug").distinct(), "slug", "left_semi")

    def _numbers(self, rows: DataFrame, column: str) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(column)).distinct().collect()]  # at most one for each bucket

    def _staged(self, name: str, rows: DataFrame, numbers: list[int]) -> None:
        """Writes what buckets are to have beside the store, where readers do not look."""
        written = rows.withColumn("bucket", self._bucket("slug" if name == "entities" else "key")).repartition(max(1, min(len(numbers), 200)), "bucket")
        written.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/.next-{name}")

    def _swap(self, name: str, schema: StructType, numbers: list[int]) -> None:
        """Puts staged buckets in the place of the store's. A bucket left without rows keeps one empty file."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path(f"{self.path}/{name}"))
        for k in numbers:
            staged, place = (path(f"{self.path}/{of}/bucket={k}") for of in (f".next-{name}", name))
            files.delete(place, True)
            if not files.exists(staged):
                self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/bucket={k}")
            elif not files.rename(staged, place):
                raise OSError(f"can't move {staged} to {place}")
        files.delete(path(f"{self.path}/.next-{name}"), True)

    def replace_all(self, rows: DataFrame) -> None:
        """Makes these entities the whole store, and its key tables theirs."""
        tables = {"entities": (rows, "slug"), **{key: (rows.select(F.col(key).alias("key"), "slug").where("coalesce(key, '') <> ''"), "key") for key in KEYS}}
        for name, (own, by) in tables.items():
            own.withColumn("bucket", self._bucket(by)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def upsert(self, incoming: DataFrame, now: str, order: str | None = None) -> DataFrame:
        """Takes a batch of entities; returns the actions (slug, action, changes), as ``store.upsert`` against the whole store gives them."""
        scratch = Scratch(self.spark, "bucket-upsert")
        batch = prepared(incoming, now, scratch)
        slugs = batch.select("slug")
        for key in KEYS:
            asked = batch.where(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).alias("key")).distinct()
            slugs = slugs.union(self._read(key, self._numbers(asked, "key")).join(asked, "key", "left_semi").select("slug"))
        slugs = scratch.save(slugs.distinct(), "slugs")
        met = self.of_slugs(slugs).select(*batch_columns(self.schema))
        # entities that stay as they were are not written
        fresh, actions = upsert_fresh(met, batch, now, order, scratch)
        touched = self._numbers(fresh, "slug")
        rest = self._read("entities", touched).drop("bucket").join(fresh.select("slug"), "slug", "left_anti").select(*fresh.columns)
        tables = []
        for key in KEYS:
            was = met.join(fresh.select("slug"), "slug", "left_semi").select(F.col(key).alias("key"), "slug").where("coalesce(key, '') <> ''")
            now_ = fresh.select(F.col(key).alias("key"), "slug").where("coalesce(key, '') <> ''")
            gone, added = was.join(now_, ["key", "slug"], "left_anti"), now_.join(was, ["key", "slug"], "left_anti")
            numbers = self._numbers(gone.select("key").union(added.select("key")), "key")
            held = self._read(key, numbers).drop("bucket").join(gone, ["key", "slug"], "left_anti")
            tables.append((key, held.unionByName(added), numbers))
        tables.append(("entities", rest.unionByName(fresh), touched))
        tables = [(name, rows, numbers) for name, rows, numbers in tables if numbers]
        for name, rows, numbers in tables:
            self._staged(name, rows, numbers)
        # a batch that is tried again finds its keys before its entities, and then writes these
        for name, rows, numbers in tables:
            self._swap(name, rows.schema, numbers)
        return actions


def batch_columns(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fieldNames()
