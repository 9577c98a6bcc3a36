"""Gradient-boosted trees over small categorical features, scored as SQL expressions.

Training examples are aggregated to weighted counts per feature vector by
Spark; the number of vectors is bounded by the product of the feature sizes,
so the summary fits the driver whatever the corpus.  Trees are fitted to the
logistic gradient on that summary and become nested CASE columns, which are
evaluated once per distinct vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Example = tuple[tuple[int, ...], int, float]
Node = tuple  # ("leaf", value) or ("split", feature, value, left, right)

RATE = 0.4
STEP = 4.0
LIMIT = 30.0


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> Node:
    """A tree on gradients g and curvatures h; each split sets one value of one feature apart."""
    total_g, total_h = g.sum(), h.sum()
    whole = total_g * total_g / (total_h + l2)
    best = (1e-9, -1, -1)
    for f in range(x.shape[1] if depth and len(x) else 0):
        n = np.bincount(x[:, f])
        left_g, left_h = np.bincount(x[:, f], g), np.bincount(x[:, f], h)
        gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (np.maximum(total_h - left_h, 0) + l2) - whole
        gain[(n == 0) | (n == len(x))] = -1.0
        v = int(gain.argmax())
        if gain[v] > best[0]:
            best = (float(gain[v]), f, v)
    if best[1] < 0:
        return ("leaf", float(total_g / (total_h + l2)))
    _, f, v = best
    own = x[:, f] == v
    return ("split", f, v, _grow(x[own], g[own], h[own], depth - 1, l2), _grow(x[~own], g[~own], h[~own], depth - 1, l2))


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node[0] == "leaf":
        return np.full(len(x), node[1])
    own = x[:, node[1]] == node[2]
    out = np.empty(len(x))
    out[own], out[~own] = _values(node[3], x[own]), _values(node[4], x[~own])
    return out


def _step(value):
    return RATE * np.clip(value, -STEP, STEP)


def boost(examples: list[Example], rounds: int = 24, depth: int = 2, l2: float = 1.0) -> tuple[float, list[Node]]:
    """(base score, trees) of the log-odds of label 1; examples: (vector, label, weight).  Without examples: (0, no tree)."""
    if not examples:
        return 0.0, []
    x = np.array([e[0] for e in examples], np.int64)
    y, w = np.array([e[1] for e in examples], float), np.array([e[2] for e in examples], float)
    base = float(np.log((w[y > 0].sum() + 1) / (w[y == 0].sum() + 1)))
    trees: list[Node] = []
    score = np.full(len(x), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(score, -LIMIT, LIMIT)))
        trees.append(_grow(x, w * (y - p), w * p * (1 - p), depth, l2))
        score = score + _step(_values(trees[-1], x))
    return base, trees


def predictions(model: tuple[float, list[Node]], vectors: list[tuple[int, ...]]) -> np.ndarray:
    if not vectors:
        return np.zeros(0)
    x = np.array(vectors, np.int64)
    s = model[0] + sum((_step(_values(t, x)) for t in model[1]), np.zeros(len(x)))
    return 1 / (1 + np.exp(-np.clip(s, -LIMIT, LIMIT)))


def predict(model: tuple[float, list[Node]], x: tuple[int, ...]) -> float:
    return float(predictions(model, [x])[0])


def column(model: tuple[float, list[Node]], names: list[str]) -> Column:
    """The model's probability as a native column over the feature columns."""

    def build(node: Node) -> Column:
        if node[0] == "leaf":
            return F.lit(float(_step(node[1])))
        return F.when(F.col(names[node[1]]) == node[2], build(node[3])).otherwise(build(node[4]))

    s = F.lit(model[0])
    for tree in model[1]:
        s = s + build(tree)
    return 1 / (1 + F.exp(-F.least(F.greatest(s, F.lit(-LIMIT)), F.lit(LIMIT))))


def threshold(model: tuple[float, list[Node]], examples: list[Example], precision: float) -> float:
    """Lowest score at which the accepted examples are right at least `precision` of their weight; above one if none is.

    The examples should not be those the trees were fitted to.
    """
    p = predictions(model, [e[0] for e in examples])
    order = np.argsort(-p, kind="stable")
    y, w = np.array([e[1] for e in examples], float)[order], np.array([e[2] for e in examples], float)[order]
    p = p[order]
    share = np.cumsum(w * y) / np.maximum(np.cumsum(w), 1e-12)
    ends = np.append(p[1:] < p[:-1], True)[: len(p)]
    good = np.flatnonzero(ends & (share >= precision))
    # halfway to the next lower score, so that equal scores of another summation order fall on the same side
    if not len(good):
        return 1.1
    k = int(good[-1])
    return float(p[k]) if k + 1 == len(p) else float((p[k] + p[k + 1]) / 2)
