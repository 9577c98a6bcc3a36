from __future__ import annotations

import random

import pytest

from inkstrata.llm._graph import components


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_against_union_find(spark, one_task):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(k, k + 1) for k in range(300, 330)] + [(400, k) for k in range(401, 450)]
    edges += [(7, 7), (None, 3), edges[0]]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = sorted((r["node"], r["root"]) for r in components(df, "test", one_task).collect())
    assert got == sorted((x, root(x)) for x in top)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_no_links(spark, one_task):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), "none", one_task).count() == 0
