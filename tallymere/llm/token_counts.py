"""Token counts of documents in flat token files without an index.

A file is a row of little-endian token ids, with an end-of-document id after
each document.  It is read in blocks that know nothing of documents: every
block is searched for separators in one vectorised pass, and a prefix scan over
one small row for each block (tokens, separators, place of the last separator)
gives each block the number of documents and the place of the last boundary
before it.  The scan has two levels, so no task sees all blocks of a large file.

``write_token_blocks`` makes such files from texts: one file for each input
partition, as Parquet rows of raw blocks, so that any Spark storage holds them,
and a list of the documents in the order of the files.  ``read_token_files``
reads plain binary files of any size, range by range.

Defined results: a null or empty text is a document of 0 tokens; a separator
counts to no document; tokens after the last separator of a file are a last
document, marked as not ended; blocks may have any sizes, also none; a null
block is empty; identifiers of documents keep their type.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .texthash import blocks

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published split pattern of this vocabulary, and its free id for the end of a document.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
SEGMENT = 1024  #: blocks that the lower level of the prefix scan takes together


def load_encoding(path: str = RANKS_PATH):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat-files", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_type_of(encoding) -> str:
    """Two bytes a token where the vocabulary allows, else four."""
    return "<u2" if encoding.n_vocab <= 1 << 16 else "<u4"


def write_token_blocks(docs: DataFrame, encoding, scratch: Scratch, separator: int = END_OF_DOCUMENT, block_tokens: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Blocks (file, no, data) of ids of token_type_of(encoding), and documents (file, ordinal, doc_id) in their order."""
    shared = docs.sparkSession.sparkContext.broadcast(encoding)
    token_type = token_type_of(encoding)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def row(kind: str, file: int, no: list, doc_id: pa.Array, data: list) -> pa.RecordBatch:
        n = len(no)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([file] * n, pa.int32()), pa.array(no, pa.int64()), doc_id, pa.array(data, pa.binary())], ["kind", "file", "no", "doc_id", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, no, ordinal, waiting, held = TaskContext.get().partitionId(), 0, 0, [], 0
        none = None
        for batch in batches:
            none = pa.nulls(1, batch["doc_id"].type)
            for lo, hi in blocks(batch["text"]):
                part = batch.slice(lo, hi - lo)
                n = part.num_rows
                yield row("document", file, list(range(ordinal, ordinal + n)), part["doc_id"], [None] * n)
                ordinal += n
                for text in part["text"].to_pylist():
                    waiting.append(np.array([*shared.value.encode_ordinary(text or ""), separator], token_type))
                    held += len(waiting[-1])
                if held >= block_tokens:
                    flat, at = np.concatenate(waiting), 0
                    for at in range(block_tokens, held + 1, block_tokens):
                        yield row("block", file, [no], none, [flat[at - block_tokens : at].tobytes()])
                        no += 1
                    waiting, held = [flat[at:].copy()], held - at
        if held:
            yield row("block", file, [no], none, [np.concatenate(waiting).tobytes()])

    written = scratch.save(docs.select("doc_id", "text").mapInArrow(run, f"kind string, file int, no long, doc_id {id_type}, data binary"), "tokens", partition_by="kind")
    stream = written.where("kind = 'block'").select("file", "no", "data")
    return stream, written.where("kind = 'document'").select("file", F.col("no").alias("ordinal"), "doc_id")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks (file, no, data) of plain binary files of any size below a path; block_bytes must be a multiple of a token's width.

    Spark lists the files and their lengths; tasks read ranges of bytes, so a file is never in memory whole.  The
    store must be one that pyarrow can open (local or shared folders, object stores, HDFS).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                name, no = own["file"][0].as_py(), own["no"][0].as_py()
                store, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_file(place) as opened:
                    data = opened.read_at(min(block_bytes, own["length"][0].as_py() - no * block_bytes), no * block_bytes)
                yield pa.RecordBatch.from_arrays([own["file"], own["no"], pa.array([data], pa.binary())], ["file", "no", "data"])

    # ranges are few numbers each; dealt anew, as all of a large file's come from one row
    return ranges.repartition("file", "no").mapInArrow(run, "file string, no long, data binary")


def count_tokens(stream: DataFrame, scratch: Scratch, separator: int = END_OF_DOCUMENT, token_type: str = "<u2") -> DataFrame:
    """Of blocks (file, no, data), a row for each document: file, ordinal (from 0), start (in tokens), n_tokens, ended."""
    file_type = stream.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch["data"][i].as_py() or b"", token_type)
                found = np.flatnonzero(tokens == separator)
                yield pa.RecordBatch.from_arrays([batch["file"].slice(i, 1), batch["no"].slice(i, 1), pa.array([len(tokens)], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "no", "n", "found"])

    searched = scratch.save(stream.select("file", "no", "data").mapInArrow(run, f"file {file_type}, no long, n long, found array<long>"), "searched")
    small = searched.select("file", "no", F.floor(F.col("no") / SEGMENT).alias("segment"), "n", F.size("found").cast("long").alias("k"), F.try_element_at("found", F.lit(-1)).alias("last"))

    inside = Window.partitionBy("file", "segment").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    small = small.withColumn("at", F.coalesce(F.sum("n").over(inside), zero)).withColumn("place", F.col("at") + F.col("last"))
    small = small.withColumns({"before": F.coalesce(F.sum("k").over(inside), zero), "boundary": F.max("place").over(inside)})
    sums = small.groupBy("file", "segment").agg(F.sum("n").alias("n_all"), F.sum("k").alias("k_all"), F.max("place").alias("last_all"))
    above = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("at_all", F.coalesce(F.sum("n_all").over(above), zero)).withColumn("place_all", F.col("at_all") + F.col("last_all"))
    sums = sums.withColumns({"before_all": F.coalesce(F.sum("k_all").over(above), zero), "boundary_all": F.max("place_all").over(above)})
    placed = small.join(sums, ["file", "segment"]).select(
        "file", "no",
        (F.col("at") + F.col("at_all")).alias("at"), (F.col("before") + F.col("before_all")).alias("before"),
        F.coalesce(F.col("boundary") + F.col("at_all"), "boundary_all", F.lit(-1)).alias("boundary"),
    )
    ends = searched.where(F.size("found") > 0).join(placed, ["file", "no"]).select("file", "at", "before", "boundary", F.posexplode("found").alias("i", "end"), "found")
    start = F.when(F.col("i") == 0, F.col("boundary")).otherwise(F.col("at") + F.get("found", F.col("i") - 1)) + 1
    docs = ends.select("file", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = sums.groupBy("file").agg(F.sum("n_all").alias("n"), F.sum("k_all").alias("k"), F.coalesce(F.max("place_all"), F.lit(-1)).alias("last"))
    rest = whole.where("n - last > 1").select("file", F.col("k").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.union(rest)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "token-counts")
    encoding = load_encoding()
    stream, order = write_token_blocks(docs, encoding, scratch)
    return count_tokens(stream, scratch, token_type=token_type_of(encoding)).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
