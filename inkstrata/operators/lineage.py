"""Records that name what they were made from: roots, depths and cycles by pointer doubling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.sources import shared_dir


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lineage(links: DataFrame, child: str, parent: str) -> DataFrame:
    """child, root, depth and status of every record: `root`, `derived` or `cycle` (root and depth null).

    A record has at most one parent; of several the smallest counts.  A parent
    that is no record itself, or null, makes its child a root.  Each round joins
    every record with what its ancestor points to, so chains of length n take
    log2(n) rounds; rounds end when no pointer moves, or after as many as the
    longest chain without a cycle could need.
    """
    rows = links.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("up"))
    known = rows.select(F.col("node").alias("up"))
    start = rows.join(known.withColumn("there", F.lit(True)), "up", "left").select("node", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    # up: the ancestor `depth` steps above, null at a root; at: the last one known
    held = _written(start.select("node", "up", F.coalesce("up", "node").alias("at"), "depth"), "lineage")
    for _ in range(max(1, held.count().bit_length())):
        if not held.where("up is not null").head(1):
            break
        above = held.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        moved = held.where("up is not null").join(above, "up").select("node", F.col("_up").alias("up"), F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"))
        held = _written(moved.unionByName(held.where("up is null")), "lineage")
    status = F.when(F.col("up").isNotNull(), "cycle").when(F.col("depth") == 0, "root").otherwise("derived")
    open_ = F.col("up").isNull()
    return held.select(F.col("node").alias(child), F.when(open_, F.col("at")).alias("root"), F.when(open_, F.col("depth")).alias("depth"), status.alias("status"))
