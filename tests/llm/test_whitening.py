"""Whitening against rational arithmetic and a plain computation."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tallymere.llm import whitening


def plain(rows, scale=256, most=4):
    """By row number: deviation, whitened values up to sign; explained; from exact fractions and one decomposition."""
    good = {i: tuple(min(max(int(np.floor(np.float64(np.float32(c)) * scale)), -(1 << 63)), (1 << 63) - 1) for c in v) for i, v in rows.items() if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)}
    out = {}
    for d in {len(x) for x in good.values()}:
        fit = sorted({x for x in good.values() if len(x) == d})
        n = len(fit)
        sums = [sum(x[k] for x in fit) for k in range(d)]
        cov = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)])
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        for i, x in good.items():
            if len(x) == d:
                y = np.array([float(x[k] - Fraction(sums[k], n)) for k in range(d)])
                out[i] = (n, sum((n * x[k] - sums[k]) ** 2 for k in range(d)), (y @ vectors), values, np.trace(cov))
    return out


def compare(spark, rows):
    frame = spark.createDataFrame([*rows.items()], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in whitening.whiten(frame).collect():
        got.setdefault(r["row"]["vec_id"], {})[r["component"]] = r
    wanted = plain(rows)
    assert got.keys() == wanted.keys()
    signs = {}
    for i, (n, deviation, projected, values, trace) in wanted.items():
        d = len(rows[i])
        assert sorted(got[i]) == list(range(1, min(4, d) + 1))
        for k, r in got[i].items():
            assert r["n"] == n and int(r["deviation"]) == deviation
            value = values[k - 1]
            if value > 1e-12 * max(trace, 1):
                white = projected[k - 1] / np.sqrt(value)
                if abs(white) > 1e-6:
                    sign = signs.setdefault((d, k), np.sign(white * r["whitened"]))
                    assert r["whitened"] == pytest.approx(sign * white, rel=1e-6, abs=1e-9)
                assert r["explained"] == pytest.approx(value / trace, rel=1e-6)
                assert r["identity_error"] < 1e-8
    return got


def test_equals_exact_arithmetic(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 7)) * [5, 3, 2, 1, 0.5, 0.2, 0.1] + 100
    rows = {i: [float(x) for x in v] for i, v in enumerate(base)}
    rows |= {100 + i: rows[0] for i in range(40)}  # a hot vector counts once
    rows |= {200: None, 201: [], 202: [None] * 7, 203: [float("nan")] + [0.0] * 6, 204: [float("-inf")] * 7, 205: [-0.0] * 7}
    rows |= {300 + i: [float(i), float(i * i)] for i in range(5)}  # another dimension
    compare(spark, rows)


def test_without_variance(spark):
    got = compare(spark, {1: [1.0, 2.0, 3.0], 2: [1.0, 2.0, 3.0], 3: [7.0]})
    assert got[1][1]["whitened"] is None and got[1][1]["explained"] is None and got[1][1]["identity_error"] is None and got[1][1]["deviation"] == "0"
    got = compare(spark, {i: [float(i), 2.0 * i, 5.0] for i in range(6)})  # one direction only
    assert got[1][1]["whitened"] is not None and got[1][2]["whitened"] is None and got[1][1]["explained"] == pytest.approx(1)


def test_huge_components(spark):
    """Beyond what a long holds, products and deviations stay exact, and components stop at the ends of a long."""
    r = np.random.default_rng(5)
    rows = {i: [float(x) for x in v] for i, v in enumerate(r.normal(size=(20, 3)) * [1e15, 1e12, 1e3])}
    rows |= {50: [3e38, -3e38, 1.0], 51: [3e38, 0.0, 0.0]}
    got = compare(spark, rows)
    assert int(got[50][1]["deviation"]) > 1 << 63


def test_scatter_is_exact():
    r = np.random.default_rng(0)
    for bits in (3, 19, 20, 40, 61):
        y = r.integers(-(1 << bits), 1 << bits, (5000, 3))
        total, product = whitening.scatter(y)
        big = y.astype(object)
        assert (total == big.sum(0)).all() and (product == big.T @ big).all()
    values = [0, 1, -1, 1 << 32, -(1 << 95) - 5, (1 << 64) - 1]
    back = [0] * len(values)
    for place, k, v in whitening._long_limbs(values):
        back[place] += v << (32 * k)
    assert back == values


def test_empty_and_other_columns(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], "a", 5, 0), (None, [2.0, 1.0], "b", 6, 1), (1, [1.0, 2.0], "a", 5, 0)], "vec_id long, embedding array<double>, row string, size int, n int")
    out = whitening.whiten(frame).collect()
    assert len(out) == 6 and {r["row"]["size"] for r in out} == {5, 6} and {r["n"] for r in out} == {2}
    assert whitening.whiten(frame.where("vec_id > 5")).count() == 0


def test_query(spark, small):
    from tallymere.llm.queries import QUERIES

    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    wanted = plain(vectors)
    rows = QUERIES["op13_embedding_whitening"](spark, small).collect()
    assert len(rows) == 4 * len(wanted) and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-10
    for r in rows:
        n, deviation, projected, values, trace = wanted[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(projected[r["component"] - 1]) / np.sqrt(values[r["component"] - 1]), rel=1e-7, abs=1e-9)
