"""Null ids, all-null columns, clashing names and repeated rows through every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkstrata.llm import decontaminate, katz, packing, pii, quality, secrets, simhash, substring_dedup

ROWS = [(None, "some words of text here", 1, "a"), (None, None, None, None), (3, "some words of text here", 2, "b"), (3, "some words of text here", 2, "b"), (4, "x" * 900 + " mail a@b.cd 4111111111111111", 0, None), (5, "", 0, "")]
# every name that some operator uses inside
NAMES = "doc_id long, text string, row long, kind string"


def bench(spark):
    return spark.createDataFrame([(1, "words of text"), (None, "of"), (2, None)], "item_id long, text string")


OPERATORS = {
    "packing": lambda s, d: packing.pack(d, packing.byte_bpe()),
    "quality": lambda s, d: quality.score(d, *quality.fit(d, s.createDataFrame([(3, 1), (None, 0), (4, None)], "doc_id long, quality int"))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, bench(s)),
    "clean": lambda s, d: decontaminate.clean(d, bench(s)),
    "pii": lambda s, d: pii.find(d),
    "redact": lambda s, d: pii.redact(d),
    "secrets": lambda s, d: secrets.find(d),
    "katz": lambda s, d: katz.score(d, F.col("doc_id") == 3),
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("names", [NAMES, "doc_id long, text string, fp long, rid string", "doc_id long, text string, n_chars long, spans string", "doc_id long, text string, score long, bucket string"])
def test_odd_rows(spark, name, names):
    df = spark.createDataFrame(ROWS, names)
    got = OPERATORS[name](spark, df).collect()
    if name == "clean":
        assert len(got) == 3
    else:
        assert len(got) >= len(ROWS)
        assert sum(r["doc_id"] is None for r in got) >= 2
    if name == "simhash":
        one = {r["fingerprint"]: r["component_id"] for r in got if r["doc_id"] == 3}
        assert set(one.values()) == {3}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], NAMES)).count() == 0
