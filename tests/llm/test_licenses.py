"""Licence scan against a plain scan of every place."""

from __future__ import annotations

import re

import pytest

from inkstrata.llm import licenses as L
from inkstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
UPPER = str.maketrans(L.UPPER, L.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(text):
    w = words(text)
    at = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def df_of(texts, vocab):
    return {v: n for v in vocab if (n := sum(v in set(words(t)) for t in texts))}


def plain_labels(texts):
    """All labels of each text: votes and verified phrases counted place by place."""
    found = L.entries()
    df = df_of(texts, L.vocabulary(found))
    out = []
    for t in texts:
        w, got = words(t), {}
        for e in found:
            rare = sorted(set(e.words), key=lambda x: (x not in df, df.get(x, 0), -len(x), x))[: L.posted_words(e)]
            if e.base:
                if any(w[k : k + len(e.words)] == list(e.words) for k in range(len(w))):
                    got[e.label] = 1.0
                continue
            votes = [(k - r, r) for k, x in enumerate(w) for r, y in enumerate(e.words) if x == y and x in rare]
            keys = [(k - a, n) for n, (a, p) in enumerate(e.keys) for k in range(len(w)) if w[k : k + len(p)] == list(p)]
            for s, _ in votes + keys:
                share = min(1.0, len({r for v, r in votes if abs(v - s) <= L.SLACK}) / len(rare))
                if len({n for v, n in keys if abs(v - s) <= L.SLACK}) == len(e.keys) and share >= L.SHARE:
                    got[e.label] = max(got.get(e.label, 0), share)
        out.append((",".join(sorted(got)), max(got.values(), default=0.0)))
    return out


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_licenses"](spark, SF).collect()}
    labels = plain_labels([r["text"] for r in rows])
    assert len(got) == len(rows)
    for r, (want, score) in zip(rows, labels, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == plain(r["text"])
        assert (g["labels"], g["score"]) == (want, pytest.approx(score))
    assert any(g["labels"] for g in got.values())


def test_labels_beyond_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"] for r in rows if "gnu general public license version 3" in " ".join(words(r["text"]))}
    got = {r["doc_id"] for r in QUERIES["op12_licenses"](spark, sf).collect() if "gpl-3" in r["labels"].split(",")}
    assert want and got == want


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEXTS = [
    MIT,
    MIT.replace("free of charge, ", ""),  # a mandatory phrase is missing
    MIT.replace("obtaining a copy of", "who is obtaining one full copy of"),  # moved by two words
    "rights merge publish sublicense permission charge granted restriction limitation",  # rare words at no common place
    "under the MIT license, Under The MIT License; under the mit-license" + " x" * 3000 + " under the mit license",
    "Apache License, Version 2.0 and CC BY-NC 4.0",
    "this is Free and unencumbered software, released into the public domain.",
    "mit " * 2000 + "under the mit",
    "CC BY NCé and ÀCC BY NC",
    "dedicated the wor\u212a to the public domain; dedicated the wor\u212a; LİCENSE ÄÖ wor\u212a",
    "",
    None,
]


def test_planted_texts(spark):
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for k, (t, (labels, score)) in enumerate(zip(TEXTS, plain_labels(TEXTS), strict=True)):
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"], got[k]["base_labels"]) == plain(t)
        assert (got[k]["labels"], got[k]["score"]) == (labels, pytest.approx(score))
    assert [got[k]["labels"] for k in range(len(TEXTS))] == ["mit", "", "mit", "", "mit", "apache-2,cc-by-nc", "unlicense", "", "", "", "", ""]


def test_rarest_words_follow_the_corpus():
    found = [L.Entry("mit", ("under", "the", "mit", "license"), ((0, ("under", "the", "mit", "license")),), True)]
    assert L.postings(found, {"mit": 5, "the": 9, "under": 7, "license": 2})[0]["word"] == "license"
    assert L.postings(found, {"mit": 1, "the": 9, "under": 7, "license": 2})[0]["word"] == "mit"


def test_odd_rows(spark):
    rows = [(None, "under the mit license", 1, "a"), (None, None, None, None), (3, "cc by nc", 2, "b"), (3, "cc by nc", 2, "b"), (4, "x" * 100_000, 0, ""), (5, "", 0, "")]
    for names in ("doc_id long, text string, row long, word string", "doc_id long, text string, start long, label string", "doc_id long, text string, n_words long, c string"):
        got = L.scan(spark.createDataFrame(rows, names)).collect()
        assert sorted((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in got) == [(0, 0, ""), (0, 4, "mit"), (3, 3, "cc-by-nc"), (3, 3, "cc-by-nc"), (4, 1, ""), (5, 0, "")]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_and_one_shuffle_in_the_plan(spark):
    plan = QUERIES["op12_licenses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1
