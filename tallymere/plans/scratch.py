"""Tables that cut lineage, kept in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``, or the checkpoint folder
that was set by hand.  Only a local master, as in tests on one machine, may do
without either; a temporary folder then takes their place.

Tables that a result still reads must stay until it is written.  Operators drop
the others as they go; ``release`` deletes what is left of this process, when
its results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: str | None = None
_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the master is local and nothing is named."""
    global _local
    context = spark.sparkContext
    named = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _local, True)
    return _local


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables of this process. Results that still read them must be written before."""
    while _made:
        _delete(spark, _made.pop())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables made since its beginning. Results that read them must be written inside. Not for threads that share a process."""
    before = set(_made)
    try:
        yield
    finally:
        for path in _made - before:
            _made.discard(path)
            _delete(spark, path)


class Scratch:
    """Parquet tables of one run of an operator.

    A saved table is on shared storage, so losing an executor costs at most
    the tasks that it was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        _made.add(self.path)

    def save(self, frame: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = frame.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; without a name, all of them."""
        for name in names or ("",):
            _delete(self.spark, f"{self.path}/{name}")
