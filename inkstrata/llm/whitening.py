"""Embedding whitening: cyclic Jacobi on a distributed centred scatter.

1. Each task sums its vectors; sums meet in a tree of two levels.
2. Each task centres its vectors at the integer next below the mean and adds
   up their products; the matrices meet in the same tree.  The vectors are
   integers, so both sums are exact, and the rest of the mean is taken off
   in whole numbers before one division.
3. The driver holds one matrix of dimension times dimension and turns pairs
   of rows and columns until what is off the diagonal vanishes beside the
   two diagonal entries it belongs to.  That test is relative, so
   small eigenvalues come out as accurate as large ones.
4. The whitening matrix, at most `COMPONENTS` columns, is broadcast; its
   identity error is measured on the whitened rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._spark import table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this saturate, so that whole numbers never overflow.
MOST = 1 << 40
LANES = 64
ROWS = 2048
SWEEPS = 60
EPS = float(np.finfo(float).eps)


def usable(batch: pa.RecordBatch, size: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(flags of rows with a whole vector, matrix of x by vector length); column 1 holds the vectors."""
    col = batch.column(1)
    vectors = col.values.to_numpy(zero_copy_only=False).astype(float) if len(col) else np.zeros(0)
    lo, hi = col.offsets.to_numpy()[:-1], col.offsets.to_numpy()[1:]
    n = np.where(np.asarray(col.is_valid()), hi - lo, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(vectors))])  # null entries are NaN here
    good = (n > 0) & (bad[lo + n] == bad[lo])
    if size is not None:
        good &= n == size
    out = {}
    for d in np.unique(n[good]):
        at = lo[good & (n == d)]
        c = vectors[at[:, None] + np.arange(d)]
        out[int(d)] = np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + SHIFT
    return good, out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, n and the sums of each batch, by length of the vectors."""
    for batch in batches:
        rows = [(d, len(x), x.sum(axis=0).tobytes()) for d, x in usable(batch)[1].items()]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["size", "n", "part"])


def _scatter(made: Callable[[pa.RecordBatch], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row by row the sum of products of what `made` gives, then the sums of its columns, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = made(batch)
            if y is not None and len(y):
                part = np.vstack([y.T @ y, y.sum(axis=0)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(np.zeros(len(total), np.int64)), pa.array([r.tobytes() for r in total], pa.binary())], ["size", "n", "part"])

    return run


def _added(kind: str) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, kind) for b in group["part"].to_pylist())
        return pa.table({"size": group["size"][:1].cast(pa.int64()), "n": pa.array([pc.sum(group["n"]).as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    return run


def _tree(parts: DataFrame, kind: str) -> DataFrame:
    """Sums of `part` by `size`, first within lanes of tasks, so that no group holds a row of every task."""
    form = "size long, n long, part binary"
    lanes = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy("size", "lane").applyInArrow(_added(kind), form)
    return lanes.groupBy("size").applyInArrow(_added(kind), form)


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors (columns) of a symmetric matrix.

    A sweep meets every pair once, in rounds of pairs that share no row, which
    turn together.
    """
    d = len(a)
    m = d + d % 2
    v = np.eye(d)
    a = a.copy()
    ring = np.arange(m)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(m - 1):
            p, q = np.minimum(ring[: m // 2], ring[m // 2 :][::-1]), np.maximum(ring[: m // 2], ring[m // 2 :][::-1])
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            p, q = p[q < d], q[q < d]
            off = a[p, q]
            live = np.abs(off) > EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q, off = p[live], q[live], off[live]
            if not len(p):
                continue
            turned = True
            half = (a[q, q] - a[p, p]) / 2
            t = off / (half + np.where(half < 0, -1.0, 1.0) * np.hypot(half, off))
            new_p, new_q = a[p, p] - t * off, a[q, q] + t * off
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            a[p], a[q] = a[p] * c[:, None] - a[q] * s[:, None], a[p] * s[:, None] + a[q] * c[:, None]
            v[:, p], v[:, q] = v[:, p] * c - v[:, q] * s, v[:, p] * s + v[:, q] * c
            a[p, p], a[q, q] = new_p, new_q
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


@dataclass
class Whitening:
    """n rows, floor of the mean, rest of the sums, whitening matrix and shares of the variance."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray

    @property
    def size(self) -> int:
        return len(self.base)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.rest / self.n) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared; null where it does not fit a long."""
        y = x - self.base
        most = int(np.abs(y).max(initial=0) + 1) * self.n
        if self.size * most * most < 2**63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        big = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [b if b < 2**63 else None for b in big]


def own(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all whole vectors; null without any.

    Whole vectors are those without null or non-finite entries.  Where their
    lengths differ, the commonest length counts (the longer one of equals).
    The driver gets one row of sums and one matrix of dimension times dimension.
    """
    rows = own(vectors)
    top = _tree(rows.mapInArrow(_sums, "size long, n long, part binary"), "<i8").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not top:
        return None
    d, n, total = top[0]["size"], top[0]["n"], np.frombuffer(top[0]["part"], "<i8")
    base = total // n
    rest = total - base * n

    def centred(batch: pa.RecordBatch) -> np.ndarray | None:
        x = usable(batch, d)[1].get(d)
        return None if x is None else (x - base).astype(float)

    met = sorted(_tree(rows.mapInArrow(_scatter(centred), "size long, n long, part binary"), "<f8").collect(), key=lambda r: r["size"])
    products = np.array([np.frombuffer(r["part"], "<f8") for r in met[:d]])
    t = [int(r) for r in rest]
    cov = np.array([[float(Fraction(int(products[i, j]) * n - t[i] * t[j], n * n)) if j >= i else 0.0 for j in range(d)] for i in range(d)])
    cov = cov + np.triu(cov, 1).T
    e, v = jacobi(cov)
    k = min(components, int((e > d * EPS * max(e[0], 0.0)).sum()))
    return Whitening(n, base, rest, v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov))


def identity_error(vectors: DataFrame, model: Whitening, given: Broadcast) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity; given: the model, broadcast."""

    def whitened(batch: pa.RecordBatch) -> np.ndarray | None:
        x = usable(batch, given.value.size)[1].get(given.value.size)
        return None if x is None else given.value.project(x)

    met = sorted(_tree(own(vectors).mapInArrow(_scatter(whitened), "size long, n long, part binary"), "<f8").collect(), key=lambda r: r["size"])
    z = np.array([np.frombuffer(r["part"], "<f8") for r in met])
    mean = z[-1] / model.n
    return float(np.abs(z[:-1] / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component, numbered from 1 by falling variance.

    Vectors that are null or empty, hold null or non-finite entries, or are not of
    the commonest length are dropped.  Components whose variance is zero
    beside the largest (equal vectors, dimensions that depend on each other)
    have no whitened value and no row.  Repeated rows and null ids are rows of
    their own; other columns are ignored.  Entries beyond 1.7e10 saturate; a
    deviation that does not fit a long is null.
    """
    spark = vectors.sparkSession
    model = fit(vectors, components)
    if model is None or not model.matrix.shape[1]:
        return spark.createDataFrame([], RESULT)
    given = spark.sparkContext.broadcast(model)  # dimension times at most `components` numbers
    error, k = identity_error(vectors, model, given), model.matrix.shape[1]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                good, found = usable(batch, m.size)
                if m.size not in found:
                    continue
                x = found[m.size]
                ids = batch.column(0).filter(pa.array(good)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                wide = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, m.n)), pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))]
                yield pa.record_batch([ids, *wide, pa.array(m.project(x).ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(x) * k, error))], names)

    return own(vectors).mapInArrow(run, RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
