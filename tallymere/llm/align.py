"""Alignment of the tokens of two vocabularies: a byte-level BPE (A) and a SentencePiece model (B).

A text, with a space before it, is cut where neither vocabulary has a token across:
before a space that follows a character other than white space.  The different parts
of a block of texts are encoded once, and DuckDB aligns them inside the task: tokens
are intervals of bytes; an ASOF join finds for each A token the B token in which it
begins, a range join the B tokens that begin inside it (of tokens that have no
counterpart), so together they give each overlap once; offsets at which tokens of both sides end cut the tokens into groups,
which a window sum numbers.  Offsets run on from part to part, so no join needs a
key and a single part of any length is no worse than many.

A row of the table that is written is one block of texts: its parts with their groups
and links and which parts each text consists of, as a compressed Arrow batch, and how
often the block holds each linked pair of ids.  Spark adds the pair counts of all blocks, and each block meets
the totals of its own pairs: from a broadcast while all pairs are at most
``SENT_PAIRS``, counted before, else by a shuffle.  The best count of each B id,
which is bounded by that vocabulary, is broadcast.  A task holds about
``SPAN`` bytes of text, or one text where that is larger; what it remembers of
parts that it has met is bounded, and forgetting them changes no result.

Defined results: texts that are null or empty, or whose tokens of one side do not
spell the text byte for byte (as those with U+2581), have no tokens: all numbers are
zero, ``groups`` is empty, and they take no part in the counts; special tokens in a
text are plain text; rows that repeat count as often as they occur.  Input columns
other than the text are kept inside the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .bpe import BLANK, ByteBPE, vocabulary_path
from .pieces import SPACE, _ranges
from .texthash import _trim, blocks, bounded_batches

MODEL = "piece_bpe_32k.model"
#: Bytes of text that are cut into parts together, of a block that becomes a row, of parts that A encodes together, and of parts that one call aligns.
SPAN, BLOCK, ENCODED, CALL = 4 << 20, 2 << 20, 1 << 20, 3 << 17
#: Parts that a task remembers, and their links.
KNOWN_PARTS, KNOWN_LINKS = 130_000, 1_300_000
#: Pairs of ids whose totals, 17 bytes each, are sent to all tasks; with more, each block gets those of its own pairs by a shuffle.
SENT_PAIRS = 2_000_000

_GROUPS = """
SELECT x.k, coalesce(sum((y.hi IS NOT NULL)::INT) OVER (ORDER BY x.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM {0} x LEFT JOIN {1} y USING (hi)
"""
_OVERLAPS = """
SELECT a.k AS i, b.k AS j FROM a ASOF JOIN b ON a.lo >= b.lo
UNION ALL SELECT x.k, y.k FROM (FROM a ANTI JOIN b USING (lo, hi)) x JOIN (FROM b ANTI JOIN a USING (lo)) y ON y.lo > x.lo AND y.lo < x.hi
"""


@dataclass
class PieceModel:
    """A SentencePiece model as bytes, what its pieces spell, and whether no piece has a space mark after another character."""

    proto: bytes
    raw: np.ndarray
    raw_ends: np.ndarray
    mark: int  #: id of the space mark by itself
    splits: bool

    @classmethod
    def load(cls, path: str | None = None) -> PieceModel:
        import sentencepiece

        with open(path or vocabulary_path(MODEL), "rb") as file:
            proto = file.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        spelt = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, pieces, strict=True)]
        splits = not any(b == SPACE != a for p in pieces for a, b in zip(p, p[1:])) and model.id_to_piece(model.piece_to_id(SPACE)) == SPACE
        return cls(proto, np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelt])]), model.piece_to_id(SPACE), splits)


def _cuts(raw: bytes, bounds: np.ndarray, classes: np.ndarray, splits: bool) -> np.ndarray:
    """Offsets at which parts start: texts, and spaces after a character that is not white space."""
    data = np.frombuffer(raw, np.uint8)
    starts = bounds[:-1][np.diff(bounds) > 0]
    if not splits:
        return starts
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    spelt = [chr(code).encode() for code in np.flatnonzero(classes == BLANK).tolist()]
    ascii_blank = np.zeros(256, bool)
    ascii_blank[[x[0] for x in spelt if len(x) == 1]] = True
    last = data[at - 1]
    after_blank = ascii_blank[last]
    far = np.flatnonzero(last >= 0x80)  # the character before has two bytes or more
    for n in {len(x) for x in spelt if len(x) > 1}:
        code = sum(data[np.maximum(at[far] - k, 0)].astype(np.int64) << (8 * (k - 1)) for k in range(1, n + 1))
        after_blank[far] |= np.isin(code, [int.from_bytes(x) for x in spelt if len(x) == n])
    first = np.zeros(len(data), bool)
    first[starts] = first[at[~after_blank]] = True
    return np.flatnonzero(first)


class Parts:
    """The parts that a task has met: how many tokens, groups and links they have."""

    def __init__(self, bpe: ByteBPE, model: PieceModel):
        import sentencepiece

        self.bpe, self.model = bpe, model
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        self.place: dict[bytes, int] = {}
        none = np.zeros(0, np.int64)
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links = none.astype(bool), none, none, none, none
        self.spelt, self.spelt_sizes = np.zeros(0, np.uint8), none  #: groups of the parts one after another, and bytes of each
        self.pairs: dict[int, int] = {}  #: number of each linked pair, a << 32 | b
        self.links = np.zeros(0, np.int32)  #: numbers of the pairs that parts link, as often as they do, part by part
        self.hits = none  #: in how many spans of texts each part was

    def _forget(self) -> None:
        """Keeps the parts that came back, if they are few, and nothing else."""
        kept = np.flatnonzero(self.hits > 1)
        if 2 * len(kept) > KNOWN_PARTS or 2 * self.n_links[kept].sum() > KNOWN_LINKS:
            kept = kept[:0]
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}
        for values, sizes in (("spelt", "spelt_sizes"), ("links", "n_links")):
            own = getattr(self, sizes)
            setattr(self, values, getattr(self, values)[_ranges((np.cumsum(own) - own)[kept], own[kept])])
        for name in ("spelt_sizes", "good", "n_a", "n_b", "n_groups", "n_links"):
            setattr(self, name, getattr(self, name)[kept])
        self.hits = np.ones(len(kept), np.int64)

    def add(self, parts: list[bytes]) -> None:
        import duckdb

        if len(self.place) > KNOWN_PARTS or len(self.links) > KNOWN_LINKS:
            self._forget()
        fresh = [p for p in parts if p not in self.place]
        self.hits = np.concatenate([self.hits, np.zeros(len(fresh), np.int64)])
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        with duckdb.connect() as db:  # closed at once, as it keeps memory
            db.execute("SET threads=1; SET temp_directory=''; SET preserve_insertion_order=false")
            for part in self._cut(fresh, ENCODED):
                ids, ends = self.bpe.encode_apart(part)
                lo = 0
                for own in self._cut(part, CALL):
                    at = ends[lo : lo + len(own) + 1]
                    self._align(db, own, ids[at[0] : at[-1]], at - at[0])
                    lo += len(own)

    @staticmethod
    def _cut(parts: list[bytes], limit: int) -> Iterator[list[bytes]]:
        """The parts in lists of ``limit`` bytes at most, or of one part."""
        lo = 0
        while lo < len(parts):
            hi, size = lo + 1, len(parts[lo])
            while hi < len(parts) and size + len(parts[hi]) <= limit:
                size += len(parts[hi])
                hi += 1
            yield parts[lo:hi]
            lo = hi

    def _align(self, db, parts: list[bytes], a: np.ndarray, a_ends: np.ndarray) -> None:
        # the library puts a space mark before what it encodes, but not before nothing
        lists = self.pieces.encode([p[1:].decode() for p in parts], num_threads=1)
        lists = [own if len(p) > 1 else [self.model.mark] for own, p in zip(lists, parts, strict=True)]
        b_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(b_ends[-1]))
        sizes_b = np.diff(self.model.raw_ends)[b]
        spelt = self.model.raw[_ranges(self.model.raw_ends[b], sizes_b)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes_b)])[b_ends].tolist()
        good = np.array([spelt[lo:hi] == p for lo, hi, p in zip(at[:-1], at[1:], parts, strict=True)])
        n_a, n_b = np.where(good, np.diff(a_ends), 0), np.where(good, np.diff(b_ends), 0)
        n_groups, n_links, groups, spelt_sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.zeros(0, np.uint8), np.zeros(len(parts), np.int64)
        links = np.zeros(0, np.int32)
        if good.any():
            db.execute(f"SET memory_limit='{max(512, sum(map(len, parts)) * 400 >> 20)}MB'")
            x, y = self._intervals(a, a_ends, np.diff(self.bpe.raw_ends)[a], good), self._intervals(b, b_ends, sizes_b, good)
            db.register("a", x)
            db.register("b", y)
            of = []
            for sides in (("a", "b"), ("b", "a")):
                found = db.execute(_GROUPS.format(*sides)).fetchnumpy()
                g = np.empty(len(found["k"]), np.int64)
                g[found["k"]] = found["g"]
                of.append(g)
            found = db.execute(_OVERLAPS).fetchnumpy()
            db.unregister("a")
            db.unregister("b")
            part_a, id_a, part_b, id_b = (t[name].to_numpy() for t in (x, y) for name in ("part", "id"))
            n_groups = np.bincount(part_a, np.append(np.diff(of[0]) > 0, True), len(parts)).astype(np.int64)
            groups, spelt_sizes = self._spell(part_a, id_a, of[0], part_b, id_b, of[1], len(parts))
            linked = part_a[found["i"]]
            order = np.argsort(linked, kind="stable")
            key = (id_a[found["i"]] << 32 | id_b[found["j"]])[order]
            keys = np.sort(key)
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
            links = np.array([self.pairs.setdefault(k, len(self.pairs)) for k in keys.tolist()], np.int32)[np.searchsorted(keys, key)]
            n_links = np.bincount(linked, minlength=len(parts))
        self.spelt, self.links = np.concatenate([self.spelt, groups]), np.concatenate([self.links, links])
        for name, own in (("spelt_sizes", spelt_sizes), ("good", good), ("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
            setattr(self, name, np.concatenate([getattr(self, name), own]))

    def _spell(self, part_a, id_a, g_a, part_b, id_b, g_b, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups of the parts one after another, and bytes of each: ids, commas within a side of a group, a bar between sides, semicolons between groups."""
        if not hasattr(self, "_digits"):
            most = max(len(self.bpe.raw_ends), len(self.model.raw_ends))
            spelt = [f"{i}{sign}".encode() for sign in (",", "|", ";", "") for i in range(most)]
            self._digits = (most, np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelt])]))
        most, digits, digit_ends = self._digits
        last_a, last_b = np.append(np.diff(g_a) > 0, True), np.append(np.diff(g_b) > 0, True)
        sign_b = np.where(last_b, np.where(np.append(part_b[1:] != part_b[:-1], True), 3, 2), 0)
        # a token stands after the tokens of its side before it, and after those of the other side in earlier groups, or its own too
        at_a = np.arange(len(g_a)) + np.searchsorted(g_b, g_a)
        at_b = np.arange(len(g_b)) + np.searchsorted(g_a, g_b, "right")
        item = np.empty(len(g_a) + len(g_b), np.int64)
        item[at_a], item[at_b] = id_a + most * np.where(last_a, 1, 0), id_b + most * sign_b
        part = np.empty(len(item), np.int64)
        part[at_a], part[at_b] = part_a, part_b
        sizes = np.diff(digit_ends)[item]
        return digits[_ranges(digit_ends[item], sizes)], np.bincount(part, sizes, n).astype(np.int64)

    @staticmethod
    def _intervals(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> pa.Table:
        part = np.repeat(np.arange(len(good)), np.diff(ends))
        kept = good[part]
        hi = np.cumsum(sizes[kept])
        return pa.table({"part": part[kept], "k": np.arange(len(hi)), "id": ids[kept].astype(np.int64), "lo": hi - sizes[kept], "hi": hi})


def _lists(values: np.ndarray, kind) -> pa.Array:
    """One row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocks(rows: pa.Array, text: pa.Array, met: Parts) -> Iterator[pa.RecordBatch]:
    """A row for each block of the texts."""
    data = [b" " + x if x else b"" for x in text.cast(pa.binary()).to_pylist()]
    raw = b"".join(data)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    starts = _cuts(raw, bounds, met.bpe.classes, met.model.splits)
    wide = len(raw) >= 1 << 31
    ends = np.append(starts, len(raw)).astype(np.int64 if wide else np.int32)
    parts = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
    own = parts.dictionary.to_pylist()
    met.add(own)
    known = np.array([met.place[p] for p in own], np.int64)
    met.hits[known] += 1
    place = parts.indices.to_numpy().astype(np.int64)
    of_text = np.searchsorted(bounds, starts, "right") - 1
    whole = np.ones(len(data), bool)
    if len(place):
        whole[of_text[~met.good[known[place]]]] = False
    kept = whole[of_text]
    known, of_text = known[place[kept]].astype(np.int32), of_text[kept].astype(np.int32)
    del data, raw, parts, own, place, kept, starts, ends
    for lo, hi in blocks(text, BLOCK):
        part = slice(*np.searchsorted(of_text, [lo, hi]))
        yield _block(rows.slice(lo, hi - lo), known[part], np.bincount(of_text[part] - lo, minlength=hi - lo), met)


def _block(rows: pa.Array, parts: np.ndarray, n_parts: np.ndarray, met: Parts) -> pa.RecordBatch:
    """The row of a block: its texts' parts one after another, and how many each text has."""
    times = np.bincount(parts, minlength=len(met.place))
    known = np.flatnonzero(times)
    place, times = (np.cumsum(times > 0) - 1)[parts], times[known]
    n_links = met.n_links[known]
    link = met.links[_ranges((np.cumsum(met.n_links) - met.n_links)[known], n_links)]
    held = np.bincount(link, np.repeat(times, n_links), len(met.pairs)).astype(np.int64)
    there = held > 0
    pair, link, held = np.array(list(met.pairs), np.int64)[there], (np.cumsum(there) - 1)[link], held[there]
    pairs = pa.StructArray.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(held)], ["a", "b", "n"])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    sizes = met.spelt_sizes[known]
    text = met.spelt[_ranges((np.cumsum(met.spelt_sizes) - met.spelt_sizes)[known], sizes)]
    spelt = pa.Array.from_buffers(pa.string(), len(known), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
    body = pa.RecordBatch.from_pydict({
        "rows": one(rows), "n_parts": _lists(n_parts, pa.int32()), "place": _lists(place, pa.int32()),
        "n_a": _lists(met.n_a[known], pa.int32()), "n_b": _lists(met.n_b[known], pa.int32()), "n_groups": _lists(met.n_groups[known], pa.int32()),
        "spelt": one(spelt), "n_links": _lists(n_links, pa.int32()), "link": _lists(link, pa.int32()),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(body)
    return pa.RecordBatch.from_pydict({"body": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "pairs": one(pairs)})


def _finish(packed: pa.Scalar, count: np.ndarray, best: np.ndarray) -> pa.Table:
    """The rows of a block's texts, from its body and, for each of its pairs, the total and whether it is the highest of the B id."""
    body = pa.ipc.open_stream(packed.as_buffer()).read_all()
    array = lambda name: body[name].combine_chunks().flatten()
    number = lambda name: array(name).to_numpy().astype(np.int64)
    rows, n_parts, place, n_links, link = array("rows"), number("n_parts"), number("place"), number("n_links"), number("link")

    def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    of_part = {name: number(name) for name in ("n_a", "n_b", "n_groups")}
    of_part |= {"n_links": n_links, "n_best": summed(best[link].astype(np.int64), n_links), "count_sum": summed(count[link], n_links)}
    spelt = array("spelt").to_pylist()
    own = place.tolist()
    ends = np.cumsum(n_parts).tolist()
    groups = [";".join([spelt[k] for k in own[lo:hi]]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"row": rows, **{name: summed(values[place], n_parts) for name, values in of_part.items()}, "groups": pa.array(groups, pa.string())})


def align(docs: DataFrame, bpe: ByteBPE, model: PieceModel, text: str = "text") -> DataFrame:
    """Columns row (struct of the input's columns but the text), n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group.  A link is a token of A and one of B that overlap; the count of a pair of ids is
    how many links of all texts it has, ``n_best`` says for how many links that is the highest of the B id, ``count_sum`` adds the counts over links.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "align")
    shared = spark.sparkContext.broadcast((bpe, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Parts(*shared.value)
        for batch in batches:
            own = batch["text"]
            for lo, hi in blocks(own, SPAN):
                yield from _blocks(batch["row"].slice(lo, hi - lo), own.slice(lo, hi - lo), met)
                _trim()  # what aligning took goes back to the system
        pa.default_memory_pool().release_unused()
        _trim()

    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select((F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("none"))).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    made = packed.mapInArrow(run, "body binary, pairs array<struct<a:int,b:int,n:bigint>>")
    table = scratch.save(made.withColumn("block", F.monotonically_increasing_id()), "blocks")

    pairs = table.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).select("of", "place", "pair.*")
    counts = scratch.save(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    most = counts.groupBy(F.col("b").alias("most_b")).agg(F.max("count").alias("most"))  # a row for each id of B
    totals = counts.join(F.broadcast(most), counts.b == F.col("most_b")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    numbers = ", ".join(f"{name} long" for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    result = f"row {kind}, {numbers}, groups string"
    if counts.limit(SENT_PAIRS + 1).count() > SENT_PAIRS:
        marks = pairs.join(totals, ["a", "b"]).select("of", "place", "count", "best")

        def finish(block: pa.Table, own: pa.Table) -> pa.Table:
            order = np.argsort(own["place"].to_numpy())
            return _finish(block["body"][0], own["count"].to_numpy()[order], own["best"].to_numpy()[order])

        return table.select("block", "body").groupBy("block").cogroup(marks.groupBy("of")).applyInArrow(finish, result)

    sent = totals.select((F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b"))).alias("key"), "count", "best").toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast(tuple(sent[name].to_numpy() for name in ("key", "count", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch["pairs"][k].values
                a, b = (own.field(name).to_numpy().astype(np.int64) for name in ("a", "b"))
                at = np.searchsorted(key, a << 32 | b)
                yield from _finish(batch["body"][k], count[at], best[at]).to_batches(max_chunksize=512)
        pa.default_memory_pool().release_unused()
        _trim()

    return table.select("body", "pairs").mapInArrow(look_up, result)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = align(docs, ByteBPE.load(), PieceModel.load())
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
