"""N-gram Jaccard join: which documents share 80 % of their word shingles, and the groups that such links form.

The shingles of a document are ordered rare first.  Two sets with the wanted
Jaccard index share a shingle of their prefixes, so only prefixes are shuffled
and joined.  Candidates pass a length filter and a positional filter inside
the join, then a suffix filter on partition sizes of what follows the
prefixes, and are verified once a pair on the shingles of the whole texts.

Work on a large group of near copies stays linear where that loses nothing.
Equal sets are one node.  In rounds, each node is compared at each shared
shingle with one leader of another component: first with the node that has
fewest rarer shingles before it, mostly the original of a group, then with the
next.  Rounds go on while they unite many.  Then only nodes that are still in
different components are compared with each other, which is exact: a link
inside a component can't change it.  For these the join itself also bounds how
many shingles two sets differ in, by bits that tell which of 2,048 parts of a
set have an odd size; so rows are made for little more than the near misses.
What remains square in a group is this comparison of numbers, for nodes that
link with no leader.

The rarity of a shingle is read from a table of counts with a fixed number of
slots, filled from all documents; any order gives the same links, a truer one
fewer candidates.  Sets are told apart by two 64-bit digests, texts by 96 bits.

Defined results: a null or empty text, or one without words, has no shingles
and links with nothing; a text of fewer than ``width`` words has its whole
sequence as its one shingle; rows that repeat a doc_id are compared as rows of
their own; a null doc_id counts as no identifier when the smallest is taken.
Columns of the input other than the identifier and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components, sized
from ..plans.scratch import Scratch
from .texthash import blocks, bounded_batches, by_blocks, mix, shingle_sets

SLOTS = 1 << 19
BINS = 32
BITS = 2048
#: Rows of one number that a join may broadcast.
TOKEN_ROWS = 2_000_000
#: Rounds of leaders go on while one of so many compared pairs links.
LEAST_GAIN = 8


def _text_codes() -> list[Column]:
    """Hashes that tell texts apart."""
    return [F.xxhash64("text").alias("code"), F.hash("text").alias("check")]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Of each slot, in how many documents its shingles occur. Only this table of fixed size reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo, hi in blocks(batch["text"]):
                total += np.bincount(_slot(shingle_sets(batch["text"].slice(lo, hi - lo), width)[0]), minlength=SLOTS)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"slot": part.astype(np.int32), "n": total[part]})

    sums = docs.select("text").where("text is not null").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.uint32)
    counts[sums["slot"].to_numpy()] = np.minimum(sums["n"].to_numpy(), (1 << 32) - 1)
    return counts


def _documents_as_sets(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Columns doc_id, code and check (hashes of the text), n (size of the set), d1 and d2 (digests of the set), prefix (rare first),
    tail (sizes of the parts of the rest), odd (bits of the parts of the whole set with an odd size)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, code long, check int, n int, d1 long, d2 long, prefix array<long>, tail array<int>, odd array<long>"

    def digest(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> pa.Array:
        n = np.diff(offsets)
        out, full = np.zeros(len(n), np.uint64), np.flatnonzero(n)
        if len(full):
            out[full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), offsets[full]) + n[full].astype(np.uint64))
        return pa.array(out.view(np.int64), mask=n == 0)

    def convert(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = shingle_sets(part["text"], width)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, shared.value[_slot(hashes)], doc))
        hashes = hashes[order]
        lead = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
        in_prefix = np.arange(len(hashes)) - offsets[:-1][doc] < lead[doc]
        tail = np.bincount(doc[~in_prefix] * BINS + (hashes[~in_prefix] % np.uint64(BINS)).astype(np.int64), minlength=len(n) * BINS)
        odd = np.bincount(doc * BITS + ((hashes >> np.uint64(8)) % np.uint64(BITS)).astype(np.int64), minlength=len(n) * BITS) & 1
        odd = np.packbits(odd.astype(np.uint8)).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(lead)]).astype(np.int32)
        fixed = lambda values, size: pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * size + 1, size, dtype=np.int32)), pa.array(values))
        return pa.RecordBatch.from_arrays([
            part["doc_id"], part["code"], part["check"], pa.array(n.astype(np.int32)), digest(hashes, offsets, 0x5851F42D4C957F2D), digest(hashes, offsets, 0x14057B7EF767814F),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[in_prefix].view(np.int64))), fixed(tail.astype(np.int32), BINS), fixed(odd, BITS // 64),
        ], ["doc_id", "code", "check", "n", "d1", "d2", "prefix", "tail", "odd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_blocks(batches, lambda batch: batch["text"], convert)

    return docs.select("doc_id", *_text_codes(), "text").mapInArrow(run, schema)


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """The pairs whose prefixes and sizes of parts of the rest allow the overlap that they need."""
    shared = pairs.sparkSession.sparkContext.broadcast(counts)
    ids = sized(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = nodes.join(ids, "node", "left_semi").select("node", "n", "prefix", "tail")
    for side in "ab":
        pairs = pairs.join(own.select(*[F.col(c).alias(side + (c if c != "node" else "")) for c in own.columns]), side)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = {s: batch[f"{s}n"].to_numpy() for s in "ab"}
            need = -(-percent * (n["a"].astype(np.int64) + n["b"]) // (100 + percent))
            tail = {s: batch[f"{s}tail"].flatten().to_numpy().reshape(-1, BINS) for s in "ab"}
            bound = np.minimum(tail["a"], tail["b"]).sum(1)
            for i in range(batch.num_rows):
                a, b = (batch[f"{s}prefix"][i].values.to_numpy().view(np.uint64) for s in "ab")
                common = len(np.intersect1d(a, b, assume_unique=True))
                last = {s: (int(shared.value[_slot(x[-1:])[0]]), int(x[-1])) for s, x in (("a", a), ("b", b))}
                late, end = (b, last["a"]) if last["a"] < last["b"] else (a, last["b"])
                rank = shared.value[_slot(late)]
                bound[i] += common + np.count_nonzero((rank > end[0]) | ((rank == end[0]) & (late > np.uint64(end[1]))))
            good = pa.array(bound >= need)
            yield pa.RecordBatch.from_pydict({"a": batch["a"].filter(good), "b": batch["b"].filter(good)})

    return pairs.mapInArrow(keep, "a long, b long")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, name: str, width: int, percent: int) -> DataFrame:
    """The pairs that are links, counted on the shingles of the whole texts."""
    ids = nodes.select("node", "code", "check").join(sized(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    texts = docs.select(*_text_codes(), "text").where("text is not null").join(sized(ids), ["code", "check"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = scratch.save(texts, f"{name}-texts")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}text")), side)

    def linked(part: pa.RecordBatch) -> pa.RecordBatch:
        good = np.zeros(part.num_rows, bool)
        (a, aends), last = shingle_sets(part["atext"], width), None
        for i in range(part.num_rows):
            if last is None or part["b"][i].as_py() != last:
                last = part["b"][i].as_py()
                b = shingle_sets(part["btext"].slice(i, 1), width)[0]
            own = a[aends[i] : aends[i + 1]]
            common = len(np.intersect1d(own, b, assume_unique=True))
            good[i] = 100 * common >= percent * (len(own) + len(b) - common)
        return pa.RecordBatch.from_pydict({"a": part["a"].filter(pa.array(good)), "b": part["b"].filter(pa.array(good))})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_blocks(batches, lambda batch: batch["atext"], linked)

    links = scratch.save(pairs.mapInArrow(check, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return links


def _fits(x: str, y: str, percent: int):
    """Length filter, and positional filter at a shared shingle, for columns n and pos of two sides."""
    nx, ny, px, py = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    room = F.least(nx - px, ny - py).cast("long")
    return (100 * F.least(nx, ny).cast("long") >= percent * F.greatest(nx, ny).cast("long")) & (room * (100 + percent) >= percent * (nx + ny).cast("long"))


def _differ_little(x: str, y: str, percent: int):
    """Parity filter: each shingle that two sets don't share changes one bit of ``odd``, so as many bits as differ, they differ in at least."""
    bits = sum((F.bit_count(F.col(f"{x}odd{i}").bitwiseXOR(F.col(f"{y}odd{i}"))) for i in range(BITS // 64)), F.lit(0))
    return bits.cast("long") * (100 + percent) <= (100 - percent) * (F.col(f"{x}n") + F.col(f"{y}n")).cast("long")


def _pairs_of(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _apart(shared: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The rows (token, node, n, pos) of tokens whose nodes are in two components or more, with component."""
    if joined is None:
        return shared.withColumn("component", F.col("node"))
    own = shared.join(sized(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return own.join(open_, "token", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of documents (doc_id, text), one row each: doc_id, n_shingles, component_id, code and check (hashes of the text).

    Two rows link when 100 * intersection >= percent * union of their sets;
    component_id is the smallest doc_id that links reach, the row's own included.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    counts = shingle_counts(docs, width)
    sets = scratch.save(_documents_as_sets(docs, counts, width, percent).withColumn("rid", F.monotonically_increasing_id()), "sets")

    # one node for each different set: the first of its rows
    repeated = sets.where("n > 0").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("k"), F.min("rid").alias("first")).where("k > 1").drop("k")
    repeated = sized(scratch.save(repeated, "repeated"))
    members = sets.join(repeated, ["d1", "d2"], "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("first", "rid")))
    nodes = members.where("node = rid").select("node", "n", "code", "check", "prefix", "tail", "odd")

    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    common = scratch.save(postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "common")
    shared = scratch.save(postings.join(sized(common, TOKEN_ROWS), "token"), "shared")

    # rounds of leaders: at each shingle every node meets one other, as long as that unites many
    place = F.struct("pos", F.xxhash64("node").alias("code"))
    links, tried, led, joined, turn = None, None, None, None, 0
    own = _apart(shared, None)
    while True:
        turn += 1
        open_ = own.join(sized(led), "token", "left").where(F.col("last").isNull() | (place > F.col("last"))) if led is not None else own
        leaders = open_.groupBy("token").agg(F.min(F.struct(place.alias("last"), "node", "n", "component")).alias("l"))
        leaders = scratch.save(leaders.select("token", "l.last", *[F.col(f"l.{c}").alias(f"leader_{c}") for c in ("node", "n", "component")]), f"leaders-{turn}")
        met = own.join(leaders.withColumn("leader_pos", F.col("last.pos")), "token").where("component <> leader_component").where(_fits("", "leader_", percent))
        pairs = _pairs_of(met, "node", "leader_node")
        pairs = scratch.save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        left = scratch.save(_suffix_filter(pairs, nodes, counts, percent), f"left-{turn}")
        found = _verify(left, nodes, docs, scratch, f"round-{turn}", width, percent)
        n_tried, n_found = pairs.count(), found.count()
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        if n_found:
            joined = components(links, scratch, f"components-{turn}")
            own = scratch.save(_apart(shared, joined), f"apart-{turn}")
        if n_found * LEAST_GAIN < n_tried or not n_tried:
            break
        led = leaders.select("token", "last")

    # the rest: at each shingle all nodes outside its largest component meet all others; first, rows without any partner go
    sizes = own.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    major = sizes.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major"))
    side = lambda frame, name: frame.select("token", *[F.col(c).alias(f"{name}_{c}") for c in frame.columns if c != "token"])
    x, y = side(own, "x"), side(own.select("token", "node", "n", "pos", "component"), "y")
    meets = x.join(y, (x.token == y.token) & (F.col("x_component") != F.col("y_component")) & _fits("x_", "y_", percent), "left_semi")
    own = scratch.save(meets.select("token", *[F.col(c).alias(c[2:]) for c in x.columns if c != "token"]).join(sized(major, TOKEN_ROWS), "token"), "meets")
    bits = nodes.join(sized(own.select("node").distinct()), "node", "left_semi").select("node", *[F.get("odd", F.lit(i)).alias(f"odd{i}") for i in range(BITS // 64)])
    own = scratch.save(own.join(bits, "node").withColumn("is_major", F.col("component") == F.col("major")), "rest")
    x, y = side(own.where("not is_major"), "x"), side(own, "y")
    other = (F.col("x_component") != F.col("y_component")) & (F.col("y_is_major") | (F.col("x_node") < F.col("y_node")))
    rest = x.join(y, (x.token == y.token) & other & _fits("x_", "y_", percent) & _differ_little("x_", "y_", percent))
    rest = scratch.save(_pairs_of(rest, "x_node", "y_node").join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    rest = scratch.save(_suffix_filter(rest, nodes, counts, percent), "rest-left")
    found = _verify(rest, nodes, docs, scratch, "rest", width, percent)
    if not found.isEmpty():
        joined = components(links.union(found), scratch, "all-components")
    rows = members.select("doc_id", "n", "node", "code", "check")
    if joined is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(sized(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    least = sized(scratch.save(least, "least"))
    out = rows.join(least, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "code", "check")
    scratch.drop("shared", "common", "meets", "rest", "rest-pairs", "rest-left", *[f"{t}-{i}" for t in ("leaders", "pairs", "left", "apart") for i in range(1, turn + 1)])
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group: its first by doc_id (null last), then by hash of the text. Input columns are unchanged."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.save(near_duplicates(docs, width, percent).where("n_shingles > 0"), "found")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "code", "check")
    first = found.groupBy("component_id").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # a group whose rows have no doc_id has no component_id; such rows stay
    first = sized(scratch.save(first, "first"))
    names = ["doc_id", "code", "check"]
    drop = found.join(first, "component_id").where(key != F.col("first")).select(*[F.col(c).alias(f"drop_{c}") for c in names]).distinct()
    drop = scratch.save(drop, "drop")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", *_text_codes())
    left = packed.join(sized(drop), F.col("doc_id").eqNullSafe(F.col("drop_doc_id")) & (F.col("code") == F.col("drop_code")) & (F.col("check") == F.col("drop_check")), "left_anti")
    twice = found.groupBy(*names).count().where("count > 1 and doc_id is not null").select(*names)
    twice = scratch.save(twice, "twice")
    if not twice.isEmpty():  # rows that repeat a document whole
        whole = left.join(sized(twice), names, "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(sized(twice), names, "left_anti").unionByName(whole)
    return left.select("row.*")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("code", "check")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT g, min(rid) AS node, len(g) AS n FROM s GROUP BY g),
x AS (SELECT node, n, unnest(g) AS shingle FROM n),
l AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT node, node AS reached FROM n WHERE n > 0 UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT n.node, min(s.doc_id) AS least FROM s JOIN n ON n.g = s.g GROUP BY n.node),
c AS (SELECT r.node, min(m.least) AS component_id FROM r JOIN m ON m.node = r.reached GROUP BY r.node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s JOIN n ON n.g = s.g LEFT JOIN c ON c.node = n.node
"""
