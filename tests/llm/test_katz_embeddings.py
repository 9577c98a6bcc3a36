"""op8 against a plain recursive model, op6 against all pairs."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import embedding_dedup, katz

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    learn = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for d in learn for w in d)
    bi = Counter((h, w) for d in learn for h, w in zip(["<s>", *d], d, strict=False))
    follow = defaultdict(list)
    for h, w in bi:
        follow[h].append(w)
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (katz.discounts(Counter(c.values())) for c in (uni, bi))
    ch = dict(uni) | {"<s>": len(learn)}
    unknown = sum(d1[min(c, 6)] for c in uni.values()) / n

    def p1(w):
        return (uni[w] - d1[min(uni[w], 6)]) / n if uni[w] else unknown

    @functools.cache
    def alpha(h):
        return sum(d2[min(bi[h, x], 6)] for x in follow[h]) / ch[h] / (1 - sum(map(p1, follow[h])))

    def p(h, w):
        if bi[h, w]:
            return (bi[h, w] - d2[min(bi[h, w], 6)]) / ch[h]
        return alpha(h) * p1(w) if ch.get(h) else p1(w)

    for h in ["<s>", *[w for w, _ in uni.most_common(5)], min(w for w in uni if w)]:
        if h is not None:
            assert abs(sum(p(h, w) for w in [*uni, "never seen"]) - 1) < 1e-9
    assert abs(sum(p1(w) for w in uni) + unknown - 1) < 1e-12
    for i, t in rows:
        ts = tokens(t)
        yield (
            i,
            zlib.crc32(str(i).encode()) % 7 == 2,
            len(ts),
            sum(uni[w] > 0 for w in ts),
            n,
            sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts),
            sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ts], ts, strict=False)),
        )


@pytest.mark.parametrize("size", [10 << 20, 60_000])
def test_katz_against_recursive_model(spark, size):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows += [(800001, None), (800002, ""), (800003, "\t \n"), (800004, "quite unknownish words"), (800005, "a b " * 3000), (800005, "a b " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = katz.score(df, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2, size).collect()
    want = sorted(brute(rows))
    got = sorted(tuple(r) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-9)


def test_katz_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = katz.score(one, F.lit(False)).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def brute_links(rows):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and any(v):
            x = np.asarray(v, np.float64)
            good.setdefault((label, len(x)), []).append((i, x / np.linalg.norm(x)))
    links = set()
    for members in good.values():
        x = np.array([m[1] for m in members])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.98), strict=True):
            if a < b:
                links.add((members[a][0], members[b][0]))
    return links


@pytest.mark.parametrize("chunk", [1024, 7])
def test_embeddings_against_all_pairs(spark, chunk):
    base = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    rng = np.random.default_rng(4)
    rows = list(base)
    for k in range(300):
        i, v, label = base[k % 60]
        x = np.asarray(v) + rng.normal(0, 0.012 * (k % 3), len(v)) * np.linalg.norm(v)
        rows.append((70000 + k, [float(np.float32(y)) for y in x], label))
    rows += [(90001, None, 1), (90002, [], 1), (90003, [0.0] * 64, 1), (90004, [1.0, None], 1), (90005, [float("nan")] * 64, 1), (90006, base[0][1], None), (90007, [1.0, 0.0], 1), (90008, [1.0, 0.0], 1), (90009, [1e-30, 0.0], 1)]
    nameless = [(None, None, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows + nameless], "vec_id long, embedding array<float>, label int, key int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, chunk=chunk).collect()}
    assert got.pop(None)["kept"]
    assert len(got) == len(rows)
    links = brute_links(rows)
    want = Counter(x for pair in links for x in pair)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * sum(want.values()) and all(r["n_links"] <= want[i] for i, r in got.items())
    assert all(r["n_links"] == 0 and r["kept"] for i, r in got.items() if 90001 <= i <= 90006)
    assert [got[i]["component_id"] for i in (90007, 90008, 90009)] == [90007] * 3
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    same = sum(r["component_id"] == root(i) for i, r in got.items())
    assert same >= 0.97 * len(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_counts_never_wrap():
    for top in (0, 200, 300, 70_000, 2**32 - 1, 2**32, 2**53 + 1, 2**62):
        x = np.array([0, 1, top], np.int64)
        assert (katz.unpack_counts(katz.pack_counts(x)) == x).all()
    big = 2**40 + 1
    keys = np.array([5, 9], np.uint64)
    rows = [{"ord": 1, "range": 0, "chunk": c, "keys": katz.pack_keys(keys), "counts": katz.pack_counts(np.array([big, c]))} for c in (0, 1, 2)]
    out = katz._answer(pa.Table.from_pylist(rows, pa.schema([("ord", pa.int32()), ("range", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))).to_pylist()
    assert [katz.unpack_counts(r["counts"]).tolist() for r in out if r["chunk"] is not None] == [[3 * big, 3]] * 3
    assert next(r["n"] for r in out if r["c"] == -2) == 3 * big + 3
