"""What one task, the driver or a plan holds stays bounded when ids, rows or benchmark blocks pile up."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import decontaminate, katz, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS long)", "7L", "id"])
def test_chunks_follow_texts_whatever_the_ids(spark, doc_id, monkeypatch):
    sizes = []
    staged = katz.staged

    def seen(df, name):
        out = staged(df, name)
        if name == "counts":
            sizes.extend(r["n"] for r in out.where("chunk is not null and ord = 1 and range = 0").selectExpr("octet_length(counts) AS n").collect())
        return out

    monkeypatch.setattr(katz, "staged", seen)
    df = spark.range(4000).selectExpr(f"{doc_id} AS doc_id", "concat_ws(' ', transform(sequence(1, 40), k -> concat('w', (id * 7919 + k * k * 31) % 20000))) AS text")
    got = katz.score(df, F.lit(True), chunk_bytes=50_000)
    assert got.count() == 4000
    assert len(sizes) > 10 and max(sizes) < 3 * np.median(sizes)


def test_fifty_blocks_of_a_benchmark(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    size = sum(len(r["text"].encode()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist())
    key = lambda df: sorted(map(repr, df.collect()))
    small = -(-size // 50)
    assert key(decontaminate.contamination(docs, bench, small)) == key(decontaminate.contamination(docs, bench))
    assert key(decontaminate.clean(docs, bench, small).select("doc_id")) == key(decontaminate.clean(docs, bench).select("doc_id"))


def test_one_row_of_a_labelled_document_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags: seen.append(len(bags)) or (np.zeros(3 << quality.BITS), 0.0))
    docs = spark.range(100_000).selectExpr("1L AS doc_id", "concat('text number ', id % 3) AS text").union(spark.range(2, 50).selectExpr("id", "'other'"))
    labels = spark.range(1, 50).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    quality.fit(docs, labels)
    assert 0 < seen[0] <= 49
