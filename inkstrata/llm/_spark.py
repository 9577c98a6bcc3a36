"""Session-level helpers: inputs, the shared work folder, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.sources import shared_dir, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; small ones that carry texts or vectors are dealt over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "embeddings") else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/inkstrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null doc_id where ids are compared or hashed; larger than any real one.
NO_ID = 2**63 - 1


def texts(docs: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id and whole text only (null text: empty), whatever other columns there are; with ids a null doc_id is NO_ID."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select((F.coalesce(doc_id, F.lit(NO_ID)) if ids else doc_id).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def given(c: str):
    """Back from NO_ID to null."""
    return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
