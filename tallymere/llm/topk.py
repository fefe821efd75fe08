"""Exact top-k search by inner product with two cover trees.

Vectors are grouped by the nearest of a few pivots into blocks of bounded
size.  Each query block is first searched against the candidate block of its
own cell, which gives every query a worst k-th score to beat; then against
each other block whose centre and radius allow a better one.  Inside a pair of
blocks, a cover tree over the queries and one over the candidates are descended
together: a pair of nodes is dropped when the inner product of their centres
plus what their covering radii can add is below the worst k-th score in the
query node.  The bounds hold for every vector, so the result is exact.

Block pairs are the unit of work and of memory: a task holds one block of
queries and one of candidates.  Pivots come from a bounded sample that grows
with the rows, so a cell is about one block until there are more rows than
``most_pivots`` blocks hold; they steer only how well blocks prune.  There is a
small row for each pair of a query block and a candidate block.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, neither as queries nor as candidates; a query meets
only vectors of its own dimension, and no row with its own vec_id; a vec_id
that repeats is ranked once for each of its rows, and queried once for each
different vector; with fewer than k candidates all are returned.  Scores are
exact below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

LEAF = 64
SHRINK = 0.7  #: radius of a cover tree's level against the level above


@dataclass
class Node:
    lo: int  #: its points are order[lo:hi] of the tree
    hi: int
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """Root, and the order of points in which each node's are together.

    The children of a node are a greedy net of its points: centres more than
    the child radius apart, each point with the first centre that covers it.
    """
    order = np.arange(len(points))

    def build(lo: int, hi: int, centre: np.ndarray, scale: float) -> Node:
        own = order[lo:hi]
        distance = np.sqrt(((points[own] - centre) ** 2).sum(1))
        node = Node(lo, hi, centre, float(distance.max()))
        if hi - lo <= LEAF or node.radius == 0:
            return node
        scale = min(scale, node.radius) * SHRINK
        rest, groups, singles, alone = own, [], [], 0
        while len(rest):
            if alone == LEAF:  # no structure left at this scale
                singles.append(rest)
                break
            away = np.sqrt(((points[rest] - points[rest[0]]) ** 2).sum(1))
            near = away <= scale
            small = near.sum() <= LEAF // 4
            alone = alone + 1 if small else 0
            (singles if small else groups).append(rest[near])
            rest = rest[~near]
        if singles:  # points that are far from most others share leaves, by distance from the first of them
            flat = np.concatenate(singles)
            flat = flat[np.argsort(((points[flat] - points[flat[0]]) ** 2).sum(1), kind="stable")]
            groups += [flat[i : i + LEAF] for i in range(0, len(flat), LEAF)]
        at = lo
        order[lo:hi] = np.concatenate(groups)
        for group in groups:
            node.children.append(build(at, at + len(group), points[group].mean(0), scale))
            at += len(group)
        return node

    root = build(0, len(points), points.mean(0), np.inf)
    return root, order


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, point, score) of each query's best k among the points, ties to smaller ids; those below a query's floor may be left out."""
    by_id = np.argsort(point_ids, kind="stable")
    points, point_ids = points[by_id], point_ids[by_id]
    q_root, q_order = cover_tree(queries)
    p_root, p_order = cover_tree(points)
    q, ids, own_floor = queries[q_order], query_ids[q_order], floor[q_order]
    none = -np.inf
    best, which = np.full((len(q), k), none), np.full((len(q), k), len(points))
    worst = own_floor.copy()
    heap = [(q_root, p_root)]
    norm = {}

    def length(node: Node) -> float:
        if id(node) not in norm:
            norm[id(node)] = float(np.sqrt((node.centre**2).sum()))
        return norm[id(node)]

    def bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * length(b) + b.radius * length(a) + a.radius * b.radius + 1e-6

    while heap:
        a, b = heap.pop()
        if bound(a, b) < worst[a.lo : a.hi].min():
            continue
        if not a.children and not b.children:
            rows, cols = slice(a.lo, a.hi), p_order[b.lo : b.hi]
            score = q[rows] @ points[cols].T
            score[ids[rows][:, None] == point_ids[cols][None, :]] = none
            if not (score >= worst[rows][:, None]).any():
                continue
            all_scores = np.concatenate([best[rows], score], 1)
            all_which = np.concatenate([which[rows], np.broadcast_to(cols, score.shape)], 1)
            take = np.lexsort((all_which, -all_scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, take, 1)
            which[rows] = np.take_along_axis(all_which, take, 1)
            worst[rows] = np.maximum(own_floor[rows], best[rows][:, -1])
        elif a.children and (not b.children or a.radius > b.radius):
            heap += [(x, b) for x in a.children]
        else:
            heap += sorted(((a, x) for x in b.children), key=lambda pair: bound(*pair))  # the best is taken first
    row, col = np.nonzero((best > none) & (best >= own_floor[:, None]))
    return q_order[row], point_ids[which[row, col]], best[row, col]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.float64)


def _place(vectors: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """Adds cell: the nearest pivot of the same dimension, or -1."""
    sets = {len(p): np.array([x for x in pivots if len(x) == len(p)], np.float64) for p in pivots}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["dim"].to_numpy()
            cell = np.full(len(sizes), -1, np.int32)
            for dim in np.unique(sizes):
                if dim in sets:
                    at = np.flatnonzero(sizes == dim)
                    own = _matrix(batch["v"].take(pa.array(at)))
                    cell[at] = ((sets[dim] ** 2).sum(1) - 2 * own @ sets[dim].T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, dim int, asked boolean, cell int")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, block_rows: int = 8192, query_rows: int = 2048, most_pivots: int = 1024) -> DataFrame:
    """Of vectors (vec_id, embedding), for those where the column ``is_query`` holds: query_id, rank (from 1), vec_id, score.

    Components count as floor(``scale`` * x).  There are about as many cells as blocks, up to ``most_pivots``, the rows of the sample that pivots come from.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(whole).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asked")
    )
    n_pivots = min(most_pivots, max(16, -(-rows.count() // block_rows)))
    sample = rows.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(n_pivots)
    placed = scratch.save(_place(rows, [list(r["v"]) for r in sample.collect()]), "placed")

    def blocks(frame: DataFrame, size: int, name: str) -> DataFrame:
        cells = frame.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
        return frame.join(F.broadcast(cells), ["dim", "cell"]).select(F.struct("dim", "cell", part.alias("part")).alias(name), "vec_id", "v")  # a row for each pivot

    candidates = scratch.save(blocks(placed, block_rows, "c"), "candidates")
    queries = scratch.save(blocks(placed.where("asked").dropDuplicates(["vec_id", "v"]), query_rows, "q"), "queries")

    def cover(frame: DataFrame, name: str) -> DataFrame:
        """Of each block, centre and covering radius."""

        def of(table: pa.Table) -> pa.Table:
            own = _matrix(table["v"])
            centre = own.mean(0)
            return pa.table({name: table[name].slice(0, 1), f"{name}_centre": pa.array([centre.tolist()]), f"{name}_radius": [float(np.sqrt(((own - centre) ** 2).sum(1)).max())]})

        key = "struct<dim:int,cell:int,part:bigint>"
        return scratch.save(frame.select(name, "v").groupBy(name).applyInArrow(of, f"{name} {key}, {name}_centre array<double>, {name}_radius double"), f"cover-{name}")

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, z: total + z)
    # a row for each pair of a query block and a candidate block of its dimension
    pairs = cover(queries, "q").join(cover(candidates, "c"), F.col("q.dim") == F.col("c.dim"))
    nc, nq = F.sqrt(dot("c_centre", "c_centre")), F.sqrt(dot("q_centre", "q_centre"))
    most = dot("q_centre", "c_centre") + F.col("q_radius") * nc + F.col("c_radius") * nq + F.col("q_radius") * F.col("c_radius") + 1e-6
    first = F.row_number().over(Window.partitionBy("q").orderBy((F.col("q.cell") == F.col("c.cell")).desc(), most.desc(), "c")) == 1
    pairs = scratch.save(pairs.select("q", "c", most.alias("most"), first.alias("first")), "pairs")

    def searched(chosen: DataFrame, asked: DataFrame, name: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            ids = left["vec_id"].to_numpy()
            row, found, score = search(_matrix(left["v"]), ids, _matrix(right["v"]), right["vec_id"].to_numpy(), left["floor"].to_numpy(), k)
            return pa.table({"query_id": ids[row], "key": left["key"].to_numpy()[row], "vec_id": found, "score": score.astype(np.int64)})

        left = asked.join(chosen, "q").groupBy("q", "c")
        right = candidates.join(chosen, "c").select("q", "c", "vec_id", "v").groupBy("q", "c")
        return scratch.save(left.cogroup(right).applyInArrow(run, "query_id long, key long, vec_id long, score long"), name)

    key = F.xxhash64("vec_id", "v").alias("key")
    none = float("-inf")
    near = searched(pairs.where("first").select("q", "c"), queries.select("q", "vec_id", "v", key, F.lit(none).alias("floor")), "near")
    kth = near.groupBy("query_id", "key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
    asked = queries.select("q", "vec_id", "v", key).join(kth.withColumnsRenamed({"query_id": "vec_id"}), ["vec_id", "key"], "left")
    asked = scratch.save(asked.select("q", "vec_id", "v", "key", F.coalesce("kth", F.lit(none)).alias("floor")), "asked")
    least = asked.groupBy("q").agg(F.min("floor").alias("least"))
    rest = pairs.where("not first").join(least, "q").where("most >= least").select("q", "c")
    found = near.union(searched(rest, asked, "rest"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
