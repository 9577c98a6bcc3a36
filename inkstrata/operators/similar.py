"""Titles that are alike: a set-similarity join by prefixes of rare tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import titles as T


def _ordered(rows: DataFrame, key: str, ranks: DataFrame) -> DataFrame:
    """key, tokens in order of rank: the rarest first."""
    flat = rows.select(key, F.explode("tokens").alias("token")).join(ranks, "token")
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda s: s["token"]).alias("tokens"))


def _prefix(tokens: Column, least: float) -> Column:
    """The tokens of which two sets of that similarity must share one: all but the last ceil(least * n) - 1."""
    n = F.size(tokens)
    return F.slice(tokens, F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)


def alike(left: DataFrame, right: DataFrame, key: str, other: str, title: str, least: float) -> DataFrame:
    """key, other, n and similarity: for every title of the left the token sets of the right whose Jaccard similarity is at least `least`.

    Equal token sets of the right are one row: other is the smallest of their
    ids, n how many there are, so copies never become all pairs of themselves.
    A pair of sets meets where both hold one token within their prefixes, in the
    order of how rare tokens are over both sides, and counts at the first such
    token only; sizes must agree too.  Titles without tokens, and null keys, match nothing.
    0 < least <= 1.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")

    def sets(rows: DataFrame, own: str) -> DataFrame:
        found = rows.where(F.col(own).isNotNull()).select(F.col(own).alias("_own"), F.array_sort(T.title_tokens(F.col(title))).alias("tokens")).where(F.size("tokens") > 0)
        return found.withColumn("_set", F.xxhash64("tokens"))

    a, b = sets(left, key), sets(right, other)
    one = [x.select("_set", "tokens").dropDuplicates(["tokens"]) for x in (a, b)]
    ranks = one[0].unionByName(one[1]).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def posted(x: DataFrame, side: str) -> DataFrame:
        rows = _ordered(x, "_set", ranks)
        return rows.select(F.col("_set").alias(f"{side}_set"), F.col("tokens").alias(f"{side}_tokens"), F.posexplode(_prefix(F.col("tokens"), least)).alias(f"{side}_at", "token"))

    x, y = F.col("a_tokens"), F.col("b_tokens")
    met = posted(one[0], "a").join(posted(one[1], "b"), "token").where((F.size(y) >= F.size(x) * least - 1e-9) & (F.size(x) >= F.size(y) * least - 1e-9))
    # tokens stand in one order on both sides: another shared one before this place would have met first
    first = F.size(F.array_intersect(F.slice(x, F.lit(1), F.col("a_at")), F.slice(y, F.lit(1), F.col("b_at")))) == 0
    shared = F.size(F.array_intersect(x, y))
    similarity = shared / (F.size(x) + F.size(y) - shared)
    pairs = met.where(first).select("a_set", "b_set", similarity.alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    ids = a.select(F.col("_own").alias(key), F.col("_set").alias("a_set"))
    held = b.groupBy(F.col("_set").alias("b_set")).agg(F.min("_own").alias(other), F.count(F.lit(1)).alias("n"))
    return ids.join(pairs.join(held, "b_set"), "a_set").select(key, other, "n", "similarity")


def best_alike(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """The most similar partner of each key, the smaller one of equals."""
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), other)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
