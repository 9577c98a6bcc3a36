"""The queries over whole tables: no row, text or later word is left out."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime, timedelta
from hashlib import sha1

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkstrata.operators import state as P
from inkstrata.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_expanded_lists_whole_has_every_document(spark, docs):
    got = QUERIES["expanded_lists_whole"](spark, SF).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got} == {r["doc_id"]: len([x for x in r["text"].split("\n") if x.strip(" ")]) or 1 for r in docs}


def test_stale_counts_each_later_commit(spark):
    t0 = datetime(2024, 1, 1)
    props = [(k % 25, "ab?"[k % 3], ["proposed", "parked", "resolved"][k % 4 % 3], t0 + timedelta(hours=7 * (k % 13)) if k % 11 else None) for k in range(40)]
    props = [(i, None if d == "?" else d, s, at) for i, d, s, at in props]
    commits = [("abc"[k % 3], t0 + timedelta(hours=5 * (k % 17))) for k in range(60)] + [(None, t0), ("a", None)]
    got = P.stale(spark.createDataFrame(props, "id int, domain string, status string, verified_at timestamp"), spark.createDataFrame(commits, "domain string, committed_at timestamp"))
    want = Counter()
    for i, d, s, at in props:
        if s != "resolved" and d and at:
            want[i] += sum(c == d and x is not None and x > at for c, x in commits)
    assert {r["id"]: r["commits"] for r in got.collect()} == {i: n for i, n in want.items() if n}


def test_stale_makes_no_pairs(spark):
    n = 200_000
    p = spark.range(n).select("id", F.lit("a").alias("domain"), F.lit("proposed").alias("status"), F.timestamp_seconds(F.col("id")).alias("verified_at"))
    got = P.stale(p, p.select("domain", F.col("verified_at").alias("committed_at")))
    assert got.agg(F.count("id"), F.sum("commits")).first()[:] == (n - 1, n * (n - 1) // 2)


def test_stale_items_whole_has_every_order(spark):
    rows = pq.read_table(f"{SF}/orders.parquet").to_pylist()
    last = {}
    for r in rows:
        last[r["o_orderpriority"]] = max(last.get(r["o_orderpriority"], r["o_orderdate"]), r["o_orderdate"])
    got = QUERIES["stale_items_whole"](spark, SF).select("id").collect()
    assert sorted(r[0] for r in got) == sorted(r["o_orderkey"] for r in rows if r["o_orderstatus"] != "F" and r["o_orderdate"] < last[r["o_orderpriority"]])


def test_query_terms_whole_reads_past_200_characters(spark, docs):
    got = {r["doc_id"]: r["terms"] for r in QUERIES["query_terms_whole"](spark, SF).collect()}
    plain = {r["doc_id"]: len(re.findall("[A-Za-z0-9]+", r["text"])) for r in docs if r["text"].isascii()}
    assert plain and max(map(len, (r["text"] for r in docs))) > 200
    assert plain == {k: got[k] for k in plain}


def test_all_words_of_a_text_are_findings(spark, docs):
    want, books = Counter(), {}
    for r in docs:
        for w in re.findall("[A-Za-z]+", r["text"]):
            want[w] += 1
            books.setdefault(w, set()).add(r["source"])
    groups = QUERIES["residual_groups_whole"](spark, SF).collect()
    assert {r["tex"]: (r["total_occ"], r["books"]) for r in groups} == {w: (n, len(books[w])) for w, n in want.items()}
    assert {r["tex"]: r["occ"] for r in QUERIES["judged_formulas_whole"](spark, SF).collect()} == want
    ids = sorted(r["gid"] for r in QUERIES["finding_ids_whole"](spark, SF).collect())
    assert ids == sorted({"b:" + sha1(b"0\0" + w.encode()).hexdigest()[:8] for w in want})


def test_merges_and_units_whole_return_every_row(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r["quality"] for r in QUERIES["fill_only_merge_whole"](spark, SF).collect()}
    assert got == {r["doc_id"]: -1 for r in docs} | labels
    assert sum(QUERIES["override_merge_counts_whole"](spark, SF).first()) == pq.read_table(f"{SF}/customer.parquet").num_rows
    assert {(r["lang"], r["field"]): r["n"] for r in QUERIES["text_units_whole"](spark, SF).collect()} == Counter((r["lang"], f) for r in docs for f in ("text", "source") if r[f].strip(" "))
