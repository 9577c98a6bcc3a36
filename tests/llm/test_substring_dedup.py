"""op9 against a dictionary of all windows; the suffix array against sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstrata.llm import substring_dedup as S
from inkstrata.llm.suffix_array import suffix_array

SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=40))
def test_suffix_array_is_sorted(symbols):
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert suffix_array(np.array(symbols, np.int64)).tolist() == want


def brute(rows):
    seen = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\x01" * 400
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()


def planted():
    rng = random.Random(6)

    def prose(n, letters="abcdefgh  \n"):
        return "".join(rng.choice(letters) for _ in range(n))

    base = prose(3000)
    out = [base, base[:1500] + "X" + base[1500:], base[:700] + prose(50) + base[1099:], prose(30) + base[500:899] + prose(10), prose(30) + base[500:900] + prose(10)]
    out += ["z" * 399, "z" * 400, "y" * 401, "ab" * 700, "ab" * 650 + "c" + "ab" * 300, prose(200) * 5, "é" * 350, None, "", "日本語" * 200 + prose(20)]
    common = prose(450)
    out += [prose(rng.randrange(5, 600)) + common + prose(rng.randrange(5, 600)) for _ in range(40)]
    near = prose(1200, "abc")
    out += [near[:k] + "#" + near[k + 1 :] for k in range(3, 1200, 40)]
    out += ["q" * 900 + prose(500), prose(450) + "q" * 700, "\x00" * 500 + base[:450], base]
    return [(600000 + k, t) for k, t in enumerate(out)] + [(600001, out[1])]


@pytest.mark.parametrize(("shard", "hot"), [(3 << 20, S.HOT), (20_000, 5)])
def test_removal_against_all_windows(spark, tmp_path, monkeypatch, shard, hot):
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    monkeypatch.setattr(S.remove_repeats, "__defaults__", (hot,))
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + planted()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rid int").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op9_suffix_dedup(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_get_the_ranges_of_one(spark, monkeypatch):
    rng, n = random.Random(3), 400
    text = "".join(rng.choice("abcdefgh ") for _ in range(3500))
    df = spark.range(n).selectExpr("7L AS doc_id", f"'{text}' AS text")
    assert [(r["n_removed"], r["count"]) for r in S.remove_repeats(df).groupBy("n_removed").count().collect()] == [(3500, n)]

    def sizes(batches):
        for b in batches:
            found = [len(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.int64()), pa.array(found, pa.int64()), pa.array([[]] * len(found), pa.list_(pa.int64())), pa.array([b""] * len(found))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    monkeypatch.setattr(S, "_remove", sizes)
    most = S.remove_repeats(df).agg(F.max("n_removed")).first()[0]
    assert 0 < most < 50  # the segments of one text, not of all its copies
