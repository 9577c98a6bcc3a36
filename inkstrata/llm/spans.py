"""Regex spans with code-point positions, in DataFrame functions only.

A text is cut at the matches of a pattern; the gaps between them and the
matches themselves alternate, so a running sum of their lengths gives each
start.  Patterns are written with possessive repeats and anchored run starts,
so no text makes the matcher backtrack or recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 32


def candidates(docs: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per match: row, doc_id, text_hash, gen, m, start, end, pre, post.

    patterns: generator -> (Java regex, cheap condition on `text` without which
    there is no match).  A document without any match gives one row with a
    null gen.  pre and post are up to CONTEXT characters around the match,
    inside the gaps to its neighbours.  `row` tells repeated doc_ids apart.
    """

    def one(gen: str) -> Column:
        pattern = patterns[gen][0]
        # bound once, so each text is cut and matched once; only lengths and CONTEXT characters of a gap go on
        both = F.array(F.struct(F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m")))
        rows = F.transform(
            both,
            lambda x: F.transform(
                x["m"],
                lambda m, i: F.struct(
                    F.lit(gen).alias("gen"),
                    i.alias("i"),
                    F.length(F.get(x["gaps"], i)).alias("gap"),
                    m.alias("m"),
                    F.right(F.get(x["gaps"], i), F.lit(CONTEXT)).alias("pre"),
                    F.left(F.get(x["gaps"], i + 1), F.lit(CONTEXT)).alias("post"),
                ),
            ),
        )
        return F.when(F.col(f"gate_{gen}"), F.get(rows, F.lit(0))).otherwise(F.array().cast("array<struct<gen:string,i:int,gap:int,m:string,pre:string,post:string>>"))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text", *[gate.alias(f"gate_{g}") for g, (_, gate) in patterns.items()])
    flat = numbered.select("row", "doc_id", "text_hash", F.explode_outer(F.concat(*[one(g) for g in patterns])).alias("c")).select("row", "doc_id", "text_hash", "c.*")
    order = Window.partitionBy("row", "gen").orderBy("i")
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("m")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return flat.withColumn("start", start).withColumn("end", F.col("start") + F.length("m")).drop("gap", "i")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of at most 19 digits."""
    at = F.sequence(F.lit(1), F.length(number))
    total = F.aggregate(
        at,
        F.lit(0),
        lambda s, k: s
        + F.when((F.length(number) - k) % 2 == 0, F.substr(number, k, F.lit(1)).cast("int")).otherwise(
            F.when(F.substr(number, k, F.lit(1)).cast("int") > 4, F.substr(number, k, F.lit(1)).cast("int") * 2 - 9).otherwise(F.substr(number, k, F.lit(1)).cast("int") * 2)
        ),
    )
    return (F.length(number) > 0) & (total % 10 == 0)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs that is already in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clear_of(flag: str, *by: str) -> tuple[Column, Column]:
    """(largest end of flagged rows before, smallest start of flagged rows after) each row, by start, end and gen.

    Both frames run from their first row to the one before, the second in
    descending order: each is one pass over the sorted rows of a document.
    """
    down = Window.partitionBy(*by).orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*by).orderBy(F.desc("start"), F.desc("end"), F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1)
    return F.max(F.when(F.col(flag), F.col("end"))).over(down), F.min(F.when(F.col(flag), F.col("start"))).over(up)
