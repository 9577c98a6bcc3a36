"""Whitening against numpy's own decomposition and whole-number sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import whitening as W
from inkstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FORM = "vec_id long, embedding array<double>, n long, component string"


def plain(rows: list[tuple[int | None, list[float]]]):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[float(c * n - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    return n, deviation, y, cov, e[::-1], v[:, ::-1]


def check(got, rows, k):
    n, deviation, y, cov, e, v = plain(rows)
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    z = np.array([[w["whitened"] for w in sorted(by[i], key=lambda r: r["component"])] for i, _ in rows])
    assert {r["n"] for r in got} == {n}
    assert all(w["deviation"] == d for (i, _), d in zip(rows, deviation, strict=True) for w in by[i])
    for c in range(k):
        want = y @ v[:, c] / math.sqrt(e[c])
        sign = np.sign(want @ z[:, c])
        assert np.allclose(z[:, c] * sign, want, atol=1e-7)
        assert {w["explained"] for ws in by.values() for w in ws if w["component"] == c + 1}.pop() == pytest.approx(e[c] / np.trace(cov), rel=1e-9)
    assert np.allclose(z.T @ z / n, np.eye(k), atol=1e-6)
    # the covariance itself is rounded to doubles, which small eigenvalues feel by the ratio to the largest
    assert max(r["identity_error"] for r in got) < max(1e-9, 10 * np.finfo(float).eps * e[0] / e[k - 1])


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, SF).collect(), rows, 32)


def test_small_eigenvalues_and_far_mean(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * [3000, 200, 20, 4, 1, 0.2] + [1e6, 0, 5, 0, 0, -4e5]
    rows = [(k, v.tolist()) for k, v in enumerate(x @ np.linalg.qr(rng.normal(size=(6, 6)))[0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)).collect()
    check(got, rows, 6)


def test_jacobi_is_accurate_for_graded_matrices():
    d = np.diag([1.0, 1e-5, 1e-10, 1e-14])
    a = d @ (np.eye(4) + 0.2) @ d
    e, v = W.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-14)
    assert e[3] == pytest.approx(1 / np.linalg.inv(np.eye(4) + 0.2)[3, 3] * 1e-28, rel=1e-6)
    for n in (1, 2, 3, 7, 64):
        m = np.random.default_rng(n).normal(size=(n, n))
        e, v = W.jacobi(m @ m.T)
        assert np.allclose(v * e @ v.T, m @ m.T, atol=1e-10) and (np.diff(e) <= 0).all()


def test_odd_rows(spark):
    v = [[1.0, 2.0], [2.0, 1.0], [4.0, 4.5], [0.5, -3.0]]
    rows = [(1, v[0], 5, "x"), (None, v[1], None, None), (3, v[2], 1, "y"), (3, v[2], 1, "y"), (4, v[3], 0, ""), (5, None, 0, ""), (6, [], 0, ""), (7, [1.0, None], 0, ""), (8, [math.nan, 1.0], 0, ""), (9, [1.0, math.inf], 0, ""), (10, [1.0, 2.0, 3.0], 0, "")]
    got = W.whiten(spark.createDataFrame(rows, FORM)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i in (1, None, 3, 3, 4) for _ in range(2))
    assert {r["n"] for r in got} == {5} and all(r["identity_error"] < 1e-9 for r in got)


def test_no_variance_gives_no_component(spark):
    same = [(k, [1.0, 1.0]) for k in range(4)]
    form = "vec_id long, embedding array<double>"
    assert W.whiten(spark.createDataFrame(same, form)).count() == 0
    assert W.whiten(spark.createDataFrame([], form)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None)], form)).count() == 0
    flat = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    got = W.whiten(spark.createDataFrame(flat, form)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_very_large_entries(spark):
    rows = [(k, [k * 1e8, (k * k) % 7 * 1e8]) for k in range(50)] + [(99, [1e300, -1e300])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert len(got) == 51 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


def test_lanes_add_up(spark):
    vectors = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100).alias("c") for k in range(3)]).alias("embedding"))
    model = W.fit(vectors.repartition(97))
    other = W.fit(vectors.coalesce(1))
    assert model.n == 5000 and np.array_equal(model.base, other.base) and np.array_equal(model.rest, other.rest)
    assert np.array_equal(model.explained, other.explained)
