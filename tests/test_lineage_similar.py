"""Lineage against following each chain, similar titles against all pairs, and the shape of their plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkstrata.functions.titles import TITLE_STOP
from inkstrata.operators import lineage as A
from inkstrata.operators import similar as Z


def followed(links):
    out = {}
    for n in links:
        seen, at = [n], n
        while links[at] in links and links[at] not in seen:
            at = links[at]
            seen.append(at)
        out[n] = (None, None, "cycle") if links[at] in links else (at, len(seen) - 1, "root" if at == n else "derived")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lineage_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = {n: rng.choice([None, n + 1, n + 1, n + 1, n + 1, n + 1, rng.randrange(400), 9999]) for n in range(300)}
    got = A.lineage(spark.createDataFrame(list(links.items()), "id long, parent long"), "id", "parent").collect()
    assert {r["id"]: (r["root"], r["depth"], r["status"]) for r in got} == followed(links) and len(got) == 300


def test_lineage_of_a_long_chain_and_odd_rows(spark):
    rows = [(k, k - 1) for k in range(1, 1000)] + [(0, None), (None, 5), (5, 4), (5, None), (2000, 2000)]
    got = {r["id"]: (r["root"], r["depth"], r["status"]) for r in A.lineage(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    assert got[999] == (0, 999, "derived") and got[0] == (0, 0, "root") and got[2000] == (None, None, "cycle") and len(got) == 1001
    assert A.lineage(spark.createDataFrame([], "id long, parent long"), "id", "parent").count() == 0


def sets(titles):
    import re

    return {k: frozenset(w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in TITLE_STOP) for k, t in titles}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_titles_equal_all_pairs(spark, least):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["the", "of", "vol"]

    def some(n):
        return [(k, None if k % 50 == 9 else " ".join(rng.choice(words[: rng.choice([6, 15, 43])]) for _ in range(rng.randrange(0, 8)))) for k in range(n)]

    left, right = some(150), some(170) + [(500 + k, "w1 w2 w3") for k in range(30)]
    a, b = sets(left), sets(right)
    want = {}
    for k, x in a.items():
        for o, y in b.items():
            if x and y and len(x & y) / len(x | y) >= least - 1e-9:
                key = (k, y)
                want[key] = (min(o, want.get(key, (o,))[0]), want.get(key, (0, 0))[1] + 1, round(len(x & y) / len(x | y), 9))
    form = "string"
    got = Z.alike(spark.createDataFrame(left, f"id long, title {form}"), spark.createDataFrame(right, f"cid long, title {form}"), "id", "cid", "title", least).collect()
    assert sorted((r["id"], r["cid"], r["n"], round(r["similarity"], 9)) for r in got) == sorted((k, *v) for (k, _), v in want.items())


def test_copies_of_a_title_are_one_row(spark):
    t = spark.range(3000).select("id", F.lit("same words here").alias("title"))
    got = Z.alike(t, t.withColumnRenamed("id", "cid"), "id", "cid", "title", 0.5)
    assert got.count() == 3000 and {(r["cid"], r["n"]) for r in got.select("cid", "n").distinct().collect()} == {(0, 3000)}
    assert Z.best_alike(got, "id", "cid").count() == 3000
