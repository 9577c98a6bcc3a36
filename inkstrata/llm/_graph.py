"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm._spark import staged

#: Up to so many links (16 bytes each) one executor task finishes the work; more go through star rounds.
ONE_TASK = 500_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: every linked node with its smallest fellow."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    yield pa.record_batch([pa.array(list(top), pa.int64()), pa.array([root(x) for x in list(top)], pa.int64())], ["node", "root"])


def components(edges: DataFrame, name: str, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node reachable.

    A checked small number of links is united in one task.  Beyond that each
    round joins neighbour lists with their minima (aggregated map-side, so
    a hub costs one row per task) and is staged as a table; rounds grow with
    the logarithm of the longest chain.  Nothing is collected but a checksum.
    Null ends and loops are dropped; repeated edges count once.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now, before = staged(now, f"{name}-edges"), None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if before is None and sign["n"] <= one_task:
            return now.repartition(1).mapInArrow(_unite, "node long, root long")
        if not sign["n"] or (sign["n"], sign["s"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = (sign["n"], sign["s"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-stars")
