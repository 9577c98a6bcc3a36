"""Brute-force versions of op1, op3 and op5 on the small tables and on odd rows."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstrata.llm import decontaminate, packing, simhash

SF = "/root/testdata/sf0.001"
ODD = [
    (900001, None, "x"),
    (900002, "", "x"),
    (900003, " \t\n ", "x"),
    (900004, "One", "x"),
    (900005, "a b " * 3000, "x"),
    (900006, "Ünïcode wörds — 日本語 \x00 end " * 9, "x"),
    (900007, "z" * 5000, "x"),
    (900008, "tail <|endoftext|> special", "x"),
    (900004, "One", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + ODD
    return rows, spark.createDataFrame(rows, "doc_id long, text string, fp string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_xxh64_all_lengths():
    data = np.frombuffer(np.random.default_rng(1).bytes(4000), np.uint8)
    starts = np.arange(0, 600, 2)
    lengths = np.arange(300)
    got = simhash.xxh64(data, starts, lengths)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, lengths, strict=True)]


def test_simhash_against_brute_force(docs):
    rows, df = docs
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    fps = [(i, brute_fp(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in fps:
        for b, y in fps:
            if (x ^ y).bit_count() <= 2:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert Counter(got) == Counter((i, f"{x:016x}", root(i)) for i, x in fps)


@pytest.mark.parametrize("split", [10**6, 4])
def test_shards_lose_no_link(spark, split):
    """Families that vary in all bits, in few bands, or in one band only."""
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for base, lo, hi in ((12345678901234567, 0, 64), (98765432109876543, 30, 64), (55555555555555555, 40, 50), (77777777777777777, 12, 30)):
        for _ in range(60):
            x = base
            for k in rng.integers(lo, hi, rng.integers(0, 5)):
                x ^= 1 << int(k)
            fps.add(x & (2**64 - 1))
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    routed = simhash.shards(df, 2, split)
    met = {}
    for r in routed.collect():
        met.setdefault((r["band"], r["key"]), set()).add(r["rep"])
    together = {(a, b) for m in met.values() for a in m for b in m if a < b}
    links = {(i, j) for j, y in enumerate(fps) for i, x in enumerate(fps[:j]) if (x ^ y).bit_count() <= 2}
    assert links and links <= together
    if split == 4:
        whole = {}
        for r in simhash.route(df, 2).collect():
            whole.setdefault((r["band"], r["key"]), set()).add(r["rep"])
        assert len(together) < len({(a, b) for m in whole.values() for a in m for b in m if a < b})
    to = {}
    edges = routed.withColumn("bucket", F.lit(0)).groupBy("bucket").applyInArrow(simhash._shards(2), "a long, b long").collect()

    def root(x):
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for a, b in [(r["a"], r["b"]) for r in edges]:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    got = [root(i) for i in range(len(fps))]
    to = {}
    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    assert got == [root(i) for i in range(len(fps))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert packing.pack(none, packing.byte_bpe()).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    one = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert [r["items"] for r in decontaminate.contamination(one, bench).collect()] == [[]]


def test_packing_round_trip(docs):
    rows, df = docs
    tok = Tokenizer.from_file(packing.byte_bpe())
    want = Counter()
    ids_of = {}
    for i, t, _ in rows:
        ids_of[i] = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] += len(ids_of[i])
    got = packing.pack(df, packing.byte_bpe()).collect()
    have, seqs = Counter(), {}
    for r in got:
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        have[r["doc_id"]] += r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_is_balanced():
    lengths = np.random.default_rng(3).integers(1, 200, 4000).tolist()
    spent = Counter()
    for _, _, n, k, _ in packing.place(lengths):
        spent[k] += packing.cost(n)
    full = [spent[k] for k in sorted(spent)][: sum(lengths) // 1024]
    in_order, at, k = Counter(), 0, 0
    for n in lengths:
        while n:
            part = min(n, 1024 - at)
            in_order[k] += packing.cost(part)
            at, n = at + part, n - part
            if at == 1024:
                at, k = 0, k + 1
    plain = list(in_order.values())[:-1]
    assert np.std(full) <= np.std(plain)


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = [False] * len(words), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if windows and tuple(words[i : i + size]) in windows:
                found.add(item)
                hit[i : i + size] = [True] * size
    ids = ",".join(sorted(map(str, found)))
    return len(words), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), sum(hit) > 0


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_winnowing_against_brute_force(spark, docs, block, tmp_path):
    rows, _ = docs
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bench += [(500, "short item"), (501, None), (502, "..."), (503, "A b"), (503, "A b"), (504, "of"), (505, bench[0][1] + " and more of it")]
    extra = [(910001, f"x {bench[0][1]} y", ""), (910002, "pre short. ITEM post", ""), (910003, " ".join(bench[1][1].split()[1:11]), "")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, items string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    old = decontaminate.contamination.__defaults__
    decontaminate.contamination.__defaults__ = (block,)
    try:
        got = decontaminate.op5_winnowing(spark, str(tmp_path)).collect()
    finally:
        decontaminate.contamination.__defaults__ = old
    assert Counter(tuple(r) for r in got) == Counter((i, *brute_hits(t, [b for b in bench if b[1]])) for i, t, _ in rows + extra)


def test_long_blank_runs_are_encoded_like_the_library(spark):
    whole = Tokenizer.from_file(packing.byte_bpe())
    encode = packing.encoder(packing.byte_bpe())
    for text in ("\n" * 1_000_000, " " * 1_000_000 + "x", "a " + "\t \n" * 100_000 + "b", "word" + "　" * 60_000, " " * 50_001, " " * 50_000):
        assert list(encode(text)) == whole.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, "\n" * 300_000)], "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(df, packing.byte_bpe()).collect()) == len(whole.encode("\n" * 300_000, add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("n, m", [(400, 90), (40_000, 8_000)])
def test_winnowing_of_repeats_costs_no_product(n, m):
    items = [(1, "spam " * m), (2, "one two three four five six seven eight nine ten eleven"), (3, "spam " * 9), (4, "spam eggs " * (m // 2)), (5, "two")]
    texts = ["spam " * n + "x", "a spam eggs spam " + "eggs spam " * (n // 4), "zero one two three four five six seven eight nine ten", "spam " * 8]
    block = decontaminate.Block(items)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    began = time.time()
    words, hit, found = decontaminate.hits(data, offsets, block)
    assert time.time() - began < 10
    assert found == {0: {1, 3}, 1: {4}, 2: {2, 5}}
    last = np.cumsum(words)
    assert words[0] == n + 1 and hit[: n + 1].tolist() == [True] * n + [False]
    assert hit[n + 1 : last[1]].tolist() == [False] + [True] * (words[1] - 1)
    assert hit[last[1] : last[2]].tolist() == [False] + [True] * 10 and not hit[last[2] :].any()
