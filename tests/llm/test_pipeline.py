"""run() stage by stage against brute force on the small tables."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from inkstrata.llm import packing, quality, simhash
from inkstrata.llm._spark import staged, table
from test_simhash_pack_winnow import brute_fp, brute_hits
from test_spans import brute_pii

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "decontamination", "pii", "packing"]

    score = {r["doc_id"]: r["score"] for r in quality.op2_quality(spark, SF).collect()}
    one = staged(stages["quality"](spark, docs, SF), "t1")
    assert one.columns == docs.columns
    kept = {r["doc_id"]: r for r in one.collect()}
    assert set(kept) == {i for i, s in score.items() if s >= 0.3}

    two = staged(stages["simhash"](spark, one, SF), "t2")
    assert two.columns == docs.columns
    fps = {i: brute_fp(r["text"]) for i, r in kept.items()}
    top = {i: i for i in fps}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = root(a), root(b)
                top[max(ra, rb)] = min(ra, rb)
    left = {r["doc_id"]: r for r in two.collect()}
    assert set(left) == {i for i in fps if root(i) == i}

    three = staged(stages["decontamination"](spark, two, SF), "t3")
    assert three.columns == docs.columns
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    clean = {r["doc_id"]: r for r in three.collect()}
    assert set(clean) == {i for i, r in left.items() if not brute_hits(r["text"], bench)[4]}

    four = staged(stages["pii"](spark, three, SF), "t4")
    assert four.columns == docs.columns
    safe = {r["doc_id"]: r for r in four.collect()}
    assert set(safe) == set(clean)
    for i, r in safe.items():
        found = brute_pii(clean[i]["text"])
        assert (r["text"] != clean[i]["text"]) >= bool(found)
        assert r["n_chars"] == len(r["text"]) and not brute_pii(r["text"])
        if not found and not re.search(r"[0-9@]", clean[i]["text"]):
            assert r["text"] == clean[i]["text"]

    pieces = corpus_pipeline.run(spark, SF).collect()
    encode = packing.encoder(packing.byte_bpe())
    want = {i: len(encode(r["text"])) + 1 for i, r in safe.items()}
    have = Counter()
    for p in pieces:
        have[p["doc_id"]] += p["length"]
    assert have == want


def test_repeated_and_null_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "some words here now", "en", "s", 19), (2, "some words here now", "en", "s", 19)]
    df = staged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name == "simhash":
            assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]
        elif name in ("decontamination", "pii"):
            assert out.count() == 3


def test_null_and_shared_ids_keep_their_rows(spark):
    a, b, c, d = ("one clean text about rivers and hills", "quite another matter of ships at sea", "third words on bread with salt", "last of all a note on winter birds")
    rows = [(None, a), (None, b), (7, c), (7, d), (None, c), (3, d), (None, a)]
    df = staged(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "ids")
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, df, SF)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect())) == sorted([(0, a), (0, b), (7, c), (3, d)])


def test_ids_do_not_link_fingerprints(spark):
    rows = [(None, 0), (None, 1), (None, 2**40 - 1), (2, 2**50 - 1), (2, 2**60 - 1), (1, 2**60 - 2)]
    want = {0: None, 1: None, 2**40 - 1: None, 2**50 - 1: 2, 2**60 - 1: 1, 2**60 - 2: 1}
    texts = {f"{fp:x}": fp for _, fp in rows}
    df = spark.createDataFrame([(i, f"{fp:x}") for i, fp in rows], "doc_id long, text string")
    real = simhash._map

    def planted(batches):
        for batch in batches:
            fps = [texts[t] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    simhash._map = planted
    try:
        got = {int(r["fingerprint"], 16): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    finally:
        simhash._map = real
    assert got == want
