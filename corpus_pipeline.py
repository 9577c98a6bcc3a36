"""A training corpus from documents: quality, near-duplicates, leakage, privacy, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet before the next one reads it.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm import decontaminate, packing, pii, quality, simhash
from inkstrata.llm._spark import staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(spark, docs, sf_dir)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, null ids last.

    Rows are numbered, so null and repeated ids stand for as many rows as they have.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    named = rows.select("_row", F.col("doc_id").cast("long").alias("id")).join(groups, "_row")
    keep = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("k")).select("k._row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by the name of its kind; n_chars follows the text."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, packing.byte_bpe())


STAGES = [
    ("quality", good_quality),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The classifier and the tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
