"""Licence scan: a positional rare-token index over licence templates.

Native DataFrame functions only.

1. How many documents hold each licence word is counted over all documents:
   the words of the templates are a fixed vocabulary, so that is one small
   count per word.
2. The index posts, for every template, its words of highest inverse document
   frequency with their places (a third of its words, `RARE` at most), and for
   every phrase the rarest of its words alone.  A template with a mandatory
   word that no document holds can stand nowhere and is not posted.
3. Each file looks its words up: those that are posted are its highest-IDF
   licence words.  A posting says where the template would start; postings
   that agree on the start within `SLACK` words are votes for one place, so
   an inserted name or year costs nothing.  A phrase is verified against the
   words around its hit, so every occurrence is found, none is guessed.
4. A template counts where at least `SHARE` of its rare words vote for a place
   and all its mandatory phrases stand, verified, at the same place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.llm._spark import table, texts

RARE = 8
SLACK = 4
SHARE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"

# The base phrases and their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Passages of public licences and usual notices: label, words, mandatory phrases (parts of the words).
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "sublicense and or sell copies"],
    ),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["merchantability fitness for a particular purpose and noninfringement"]),
    ("mit", "licensed under the mit license", ["the mit license"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ["apache license version 2", "except in compliance with the license"],
    ),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2"]),
    (
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["endorse or promote products derived from this software"],
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "redistributions of source code must retain"],
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "either version 2 of the license"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "either version 3 of the license"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license v 2"]),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("boost-1", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ["boost software license version 1"]),
]


@dataclass(frozen=True)
class Entry:
    """Something to be found: a base phrase (a template whose only key is itself) or a passage."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool


def place(words: tuple[str, ...], phrase: tuple[str, ...]) -> int:
    """Where a phrase first stands in a passage."""
    return next(k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase)


def entries() -> list[Entry]:
    out = [Entry(label, tuple(p.split()), ((0, tuple(p.split())),), True) for label, p in BASE]
    for label, text, keys in TEMPLATES:
        words = tuple(text.split())
        out.append(Entry(label, words, tuple((place(words, tuple(k.split())), tuple(k.split())) for k in keys), False))
    return out


def vocabulary(found: list[Entry]) -> list[str]:
    return sorted({w for e in found for w in e.words})


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z in lower case.

    lower() is used for its speed: other letters that it changes stay outside
    ASCII and licence words are ASCII.  The Kelvin sign alone becomes a k, so
    texts with it are translated.
    """
    low = F.when(text.contains(KELVIN), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BETWEEN), "")


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def frequencies(docs: DataFrame, vocab: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands, over all documents: at most one number per word."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), literal(vocab))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def posted_words(e: Entry, rare: int = RARE) -> int:
    return min(rare, max(2, -(-len(set(e.words)) // 3)))


def postings(found: list[Entry], df: dict[str, int], rare: int = RARE) -> list[dict]:
    """The index.  The fewer documents hold a word, the higher its IDF; equal words go by length, then name.

    Words that no document holds come last: looking them up finds nothing, and
    a template whose mandatory phrase has one is left out.
    key null: a vote of a rare word, `rel` its place in the passage.  Otherwise
    the rarest word of key number `key`, which starts at place `at` of the passage.
    """
    out = []

    def common(w: str) -> tuple:
        return (df.get(w, 0) == 0, df.get(w, 0), -len(w), w)

    for i, e in enumerate(found):
        if any(w not in df for _, phrase in e.keys for w in phrase):
            continue
        order = sorted(set(e.words), key=common)[: posted_words(e, rare)]
        for k, (at, phrase) in enumerate(e.keys):
            word = min(phrase, key=common)
            out.append({"word": word, "entry": i, "label": e.label, "base": e.base, "rel": at + phrase.index(word), "key": k, "at": at, "phrase": list(phrase), "keys": len(e.keys), "votes": len(order)})
        if not e.base:
            out += [{"word": w, "entry": i, "label": e.label, "base": False, "rel": r, "key": None, "at": 0, "phrase": [], "keys": len(e.keys), "votes": len(order)} for r, w in enumerate(e.words) if w in order]
    return out


POSTING = "array<struct<word:string,entry:int,label:string,base:boolean,rel:int,key:int,at:int,phrase:array<string>,keys:int,votes:int>>"


def hits(docs: DataFrame, posted: list[str], around: int) -> DataFrame:
    """row, doc_id, n_words and, for each posted word of a document, word, pos, near (the words around it) and first (place of near).

    A document without any gives one row with a null word.
    """

    def looked_up(words: Column) -> Column:
        head = F.struct(F.size(words).cast("long").alias("n_words"), F.lit(None).cast("string").alias("word"), F.lit(-1).alias("pos"), F.array().cast("array<string>").alias("near"), F.lit(0).alias("first"))
        places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*posted))

        def one(x: Column) -> Column:
            first = F.greatest(x["i"] - around, F.lit(0))
            return F.struct(F.size(words).cast("long").alias("n_words"), x["w"].alias("word"), x["i"].alias("pos"), F.slice(words, first + 1, F.lit(2 * around + 1)).alias("near"), first.alias("first"))

        some = F.size(F.array_intersect(words, literal(posted))) > 0
        return F.when(some, F.transform(places, one)).otherwise(F.array(head))

    # bound once, so each text is cut into words once
    found = F.flatten(F.transform(F.array(words_of(F.col("text"))), looked_up))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.select("row", "doc_id", F.explode(found).alias("c")).select("row", "doc_id", "c.*")


def matches(docs: DataFrame, found: list[Entry] | None = None, rare: int = RARE, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """row, doc_id, n_words and one row per place: label, base, start, score; null labels for documents without any.

    Null texts are empty; one document per input row; other columns are ignored.
    """
    found = entries() if found is None else found
    own = texts(docs)
    index = postings(found, frequencies(own, vocabulary(found)), rare)
    around = max((len(p["phrase"]) for p in index), default=1) - 1
    # a fixed number of rows: the templates' rare words
    table_ = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(index)), POSTING))).withColumnRenamed("word", "posted")
    rows = hits(own, sorted({p["word"] for p in index}), around)
    rows = rows.join(F.broadcast(table_), F.col("word") == F.col("posted"), "left").drop("posted", "word")
    start = F.col("pos") - F.col("rel")
    key_at = start + F.col("at")
    stands = (key_at >= 0) & (F.slice("near", F.greatest(key_at - F.col("first"), F.lit(0)) + 1, F.greatest(F.size("phrase"), F.lit(0))) == F.col("phrase"))
    rows = rows.withColumn("start", start).withColumn("ok", F.col("key").isNull() | stands).drop("near", "phrase", "first", "pos", "at")
    # one shuffle, by document, serves the places and the sums per document
    near = Window.partitionBy("row", "entry").orderBy("start").rangeBetween(-slack, slack)
    voted = F.size(F.collect_set(F.when(F.col("ok") & F.col("key").isNull(), F.col("rel"))).over(near))
    keyed = F.size(F.collect_set(F.when(F.col("ok"), F.col("key"))).over(near))
    rows = rows.repartition("row").withColumn("voted", voted).withColumn("keyed", keyed)
    score = F.when(F.col("base"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("voted") / F.col("votes")))
    counts = F.col("ok") & (F.col("base") | ((F.col("keyed") == F.col("keys")) & (score >= share)))
    none = F.lit(None)
    good = F.coalesce(counts, F.lit(False))
    return rows.select("row", "doc_id", "n_words", F.when(good, F.col("label")).alias("label"), F.when(good, F.col("base")).alias("base"), F.when(good, F.col("start")).otherwise(none).alias("start"), F.when(good, score).alias("score"))


def scan(docs: DataFrame, found: list[Entry] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a passage's rare words found at one of its
    places, 1 for a base phrase, 0 without any label.
    """
    base = F.col("base")
    joined = [F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",").alias(n) for c, n in ((base, "base_labels"), (F.col("label").isNotNull(), "labels"))]
    return (
        matches(docs, found)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            *joined,
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
