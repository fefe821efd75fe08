"""Whitening of embeddings from an exact integer scatter.

Components become integers, floor(``scale`` * x).  The fit list holds each different
vector once.  Each task subtracts a shift (a vector of the list, so numbers are small)
and sums vectors and their cross-products exactly: numbers are split into limbs that
matrix products in floating point add without rounding, and limbs become integers of
any size.  A task gives its sums in limbs of 32 bits, which Spark adds as longs.  From
n, S and X'X follows n X'X - SS', an exact integer matrix that does not depend on the
shift; only then it is divided by n^2, each entry rounded once, and decomposed.

The driver holds one matrix for each dimension of vectors, so it depends on the
dimension alone, never on rows; executors get mean and components by a broadcast of
that size.

Defined results: rows whose vector is null, empty, or holds a null or non-finite
component are left out; floor(``scale`` * x) stops at the ends of a long; vectors of
different dimensions are whitened apart, each with its own fit list; fewer components
than asked for where the dimension is smaller; a component without variance has null
``whitened``; ``explained`` is null where no dimension varies; ``identity_error`` is
taken over the components that vary, and is null without any.  Input columns other
than the vector are kept inside the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Limbs of numbers have so many bits, and so many rows are multiplied at once: sums of products stay below 2^53.
LIMB_BITS, ROWS = 20, 1 << 12


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, exactly: as longs where they suffice, else as Python's integers."""
    if not x.size:
        return x
    low, high = int(x.min()) - max(shift), int(x.max()) - min(shift)
    if -(1 << 62) < low and high < 1 << 62:
        return x - np.array(shift, np.int64)
    return x.astype(object) - np.array(shift, object)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Arrays of floats below 2^20 in size, whose sum with weights 2^(20 k) is y."""
    out = []
    sign, rest = np.where(y < 0, -1, 1), abs(y)
    while True:
        out.append((sign * (rest & ((1 << LIMB_BITS) - 1))).astype(np.float64))
        rest = rest >> LIMB_BITS
        if not rest.any():
            return out


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of y, as Python's integers."""
    d = y.shape[1]
    total, product = np.zeros(d, object), np.zeros((d, d), object)
    for lo in range(0, len(y), ROWS):
        limbs = _limbs(y[lo : lo + ROWS])
        for i, a in enumerate(limbs):
            total += a.sum(0).astype(np.int64).astype(object) << (LIMB_BITS * i)
            for j, b in enumerate(limbs):
                product += (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return total, product


def _long_limbs(values: list[int]) -> list[tuple[int, int, int]]:
    """(place, limb number, limb): signed limbs of 32 bits, so that sums over many tasks fit a long; zeros are left out."""
    out = []
    for place, v in enumerate(values):
        sign, v, k = (-1, -v, 0) if v < 0 else (1, v, 0)
        while v:
            if low := v & 0xFFFFFFFF:
                out.append((place, k, sign * low))
            v >>= 32
            k += 1
    return out


@dataclass
class Whitening:
    """Mean and components of the fit list of one dimension."""

    size: int
    n: int
    shift: list[int]
    sums: list[int]  #: of the fit list, less n * shift
    vectors: np.ndarray  #: a column for each component
    values: np.ndarray  #: their variances, falling
    trace: float

    @classmethod
    def fit(cls, size: int, n: int, shift: list[int], sums: list[int], products: np.ndarray, most: int) -> Whitening:
        """``sums`` and ``products`` are exact, of vectors less the shift."""
        s = np.array(sums, object)
        centred = n * products - np.outer(s, s)  # n^2 times the covariance, exact
        square = n * n
        covariance = np.array([[v / square for v in row] for row in centred], np.float64).reshape(size, size)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        trace = sum(int(centred[i, i]) for i in range(size)) / square
        floor = size * np.finfo(float).eps * max(trace, 0)
        return cls(size, n, shift, list(map(int, sums)), vectors[:, order], np.where(values[order] > floor, values[order], 0), trace)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component, over its deviation; NaN where that is zero. The mean is taken from numbers that are small already."""
        y = shifted(x, self.shift).astype(np.float64) - np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y @ self.vectors) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        y, s = shifted(x, self.shift), self.sums
        most = self.n * max(abs(int(y.min())), abs(int(y.max()))) + max(map(abs, s)) if y.size else 0
        if self.size * most * most >= 1 << 63:
            y, s = y.astype(object), np.array(s, object)
        else:
            s = np.array(s, np.int64)
        z = self.n * y - s
        return (z * z).sum(1).tolist()


def _whole(x):
    return F.col(x).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def fit(vectors: DataFrame, most: int = 4) -> list[Whitening]:
    """Of a fit list (x array<long>, size int), each different vector once: a whitening for each dimension."""
    spark = vectors.sparkSession
    # the shift is the vector of least hash; hashes are compared rather than vectors, as these would have to be sorted
    heads = vectors.groupBy(F.col("size").alias("h_size")).agg(F.min(F.xxhash64("x")).alias("hash"), F.count(F.lit(1)).alias("n"))
    heads = heads.collect()  # a row for each dimension
    least = F.broadcast(spark.createDataFrame([tuple(r) for r in heads], "h_size int, hash long, n long"))
    chosen = vectors.join(least, (F.col("size") == F.col("h_size")) & (F.xxhash64("x") == F.col("hash"))).dropDuplicates(["size"])
    shifts = {r["size"]: list(r["x"]) for r in chosen.select("size", "x").collect()}
    shared = spark.sparkContext.broadcast(shifts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                own = _matrix(batch["x"].take(pa.array(np.flatnonzero(sizes == size))), size)
                total, product = scatter(shifted(own, shared.value[size]))
                before = held.get(size, (0, 0))
                held[size] = (before[0] + total, before[1] + product)
        for size, (total, product) in held.items():
            rows = _long_limbs([*total.tolist(), *product[np.triu_indices(size)].tolist()])
            place, limb, value = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(rows), pa.int32()), "place": pa.array(place, pa.int32()), "limb": pa.array(limb, pa.int32()), "value": pa.array(value, pa.int64())})

    parts = vectors.select("x", "size").mapInArrow(run, "size int, place int, limb int, value long").groupBy("size", "place", "limb").agg(F.sum("value").alias("value"))
    values = {size: [0] * (size + size * (size + 1) // 2) for size in shifts}
    for r in parts.collect():  # a few numbers for each entry of a matrix
        values[r["size"]][r["place"]] += r["value"] << (32 * r["limb"])
    out = []
    for r in heads:
        size = r["h_size"]
        products = np.zeros((size, size), object)
        upper = np.triu_indices(size)
        products[upper] = values[size][size:]
        products.T[upper] = values[size][size:]
        out.append(Whitening.fit(size, r["n"], shifts[size], values[size][:size], products, most))
    return out


def _apply(rows: DataFrame, models: dict[int, Whitening], kind: str | None) -> DataFrame:
    """Adds deviation (decimal digits) and whitened (array<double>) to rows with x and size; ``row`` is kept where its type is given."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kept = ["row"] if kind else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                model, x = shared.value[size], _matrix(part["x"], size)
                white = pa.array(model.whitened(x).tolist(), pa.list_(pa.float64()))
                out = {name: part[name] for name in [*kept, "size"]}
                yield pa.RecordBatch.from_pydict(out | {"deviation": pa.array(map(str, model.deviations(x)), pa.string()), "whitened": white})

    return rows.select(*kept, "size", "x").mapInArrow(run, (f"row {kind}, " if kind else "") + "size int, deviation string, whitened array<double>")


def identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """By dimension, the largest entry, in size, of the whitened fit list's covariance less the identity."""
    most = max((len(m.values) for m in models.values()), default=0)
    if not most:
        return {}
    white = _apply(vectors, models, None)
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    entries = [F.covar_pop(F.get("whitened", i), F.get("whitened", j)).alias(f"c{i}_{j}") for i, j in pairs]
    found = {r["size"]: r for r in white.groupBy("size").agg(*entries).collect()}  # a row for each dimension
    out = {}
    for size, model in models.items():
        alive = np.flatnonzero(model.values > 0).tolist()
        errors = [abs(found[size][f"c{i}_{j}"] - (i == j)) for i in alive for j in alive if i <= j]
        out[size] = max(errors) if errors else None
    return out


def whiten(docs: DataFrame, vector: str = "embedding", scale: int = 256, most: int = 4) -> DataFrame:
    """Columns row (struct of the input's columns but the vector), component (from 1), n, deviation (decimal digits), whitened, explained, identity_error.

    A row for each input row and component, up to ``most``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "whitening")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != vector]
    named = docs.select((F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("none"))).alias("row"), F.col(f"`{vector}`").alias("v"))
    rows = named.where(_whole("v")).select("row", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"), F.size("v").alias("size"))
    distinct = scratch.save(rows.select("x", "size").distinct(), "fit")
    models = {m.size: m for m in fit(distinct, most)}
    errors = identity_errors(distinct, models)
    facts = [(size, k + 1, m.n, float(m.values[k] / m.trace) if m.trace > 0 else None, errors[size]) for size, m in models.items() for k in range(len(m.values))]
    facts = spark.createDataFrame(facts, "f_size int, component int, n long, explained double, identity_error double")  # a few rows for each dimension
    out = _apply(rows, models, named.schema["row"].dataType.simpleString())
    one = F.get("whitened", F.col("component") - 1)
    met = out.join(F.broadcast(facts), F.col("size") == F.col("f_size"))
    return met.select("row", "component", "n", "deviation", F.when(~F.isnan(one), one).alias("whitened"), "explained", "identity_error")


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = whiten(vectors)
    # a deviation that no long holds is null here; the operator gives its digits
    return out.select(F.col("row.vec_id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
