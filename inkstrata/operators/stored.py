"""A search index kept as files: posting segments by token bucket, added to batch by batch.

    postings/batch=N/bucket=K   book, token, segment, offsets
    chunks/batch=N              book, chunk, gone, parts: the chunks that came with a batch
    replaced/batch=N            chunk, was: earlier versions that batch N took out

A segment holds the chunks of one token whose ids lie in one range of
numbers (`search.SPAN`), as offsets from the start of that range, so no list outgrows a
segment however common its token is.  A token's bucket follows its first
two characters: exact and prefix lookups of a term read one bucket and no text.
A chunk that comes again, or comes with a null text (it is gone), takes
its earlier versions out without touching their files.  The batch number
is part of the path and a batch that runs again replaces its own folders,
so the writers need no bookkeeping beyond Spark's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.operators import search as S

BUCKETS = 64
POSTINGS = "token string, segment long, offsets array<int>, batch int, bucket int"


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.left(token, F.lit(2))), F.lit(buckets)).cast("int")


def gathered(found: DataFrame, book: str, chunk: str, buckets: int = BUCKETS) -> DataFrame:
    """Postings (book, chunk, token) as segments with their buckets, files dealt by bucket."""
    return S.segments(found, book, chunk).withColumn("bucket", bucket(F.col("token"), buckets)).hint("rebalance", "bucket")


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A part of the index; empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).limit(0)  # known to be empty: joins with it fall away


def add(batch: DataFrame, path: str, number: int, book: str, chunk: str, text: str = "text", buckets: int = BUCKETS) -> dict[str, int]:
    """Write batch `number`: its postings, its chunks and what it replaces.  Gives the rows read and of each part.

    The columns book and chunk keep their names; a book is a string, a chunk a
    whole number.  Rows of one batch with equal ids are parts of one chunk,
    which is gone where all their texts are null; rows without an id are counted and
    cannot be found.
    """
    spark = batch.sparkSession
    own = batch.select(F.col(book).cast("string").alias(book), F.col(chunk).cast("long").alias(chunk), F.col(text).cast("string").alias(text))
    found = S.postings(own.where(F.col(chunk).isNotNull()), [book, chunk], text)
    gathered(found, book, chunk, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    own.groupBy(book, chunk).agg(F.bool_and(F.col(text).isNull()).alias("gone"), F.count(F.lit(1)).alias("parts")).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
    chunks = _held(spark, f"{path}/chunks", _chunks(book, chunk)).where(F.col(chunk).isNotNull())
    fresh = chunks.where(F.col("batch") == number).select(chunk).distinct()
    earlier = chunks.where(F.col("batch") < number).select(chunk, F.col("batch").alias("was"))
    earlier.join(fresh, chunk, "left_semi").write.mode("overwrite").parquet(f"{path}/replaced/batch={number}")
    counts = spark.read.parquet(f"{path}/chunks/batch={number}").agg(F.sum("parts").alias("read"), F.count(chunk).alias("chunks")).first()
    rows = {part: spark.read.parquet(f"{path}/{part}/batch={number}").count() for part in ("postings", "replaced")}
    return {"read": counts["read"] or 0, "chunks": counts["chunks"], **rows}


def _chunks(book: str, chunk: str) -> str:
    return f"{book} string, {chunk} long, gone boolean, parts long, batch int"


def _current(rows: DataFrame, path: str, chunk: str) -> DataFrame:
    """Rows (chunk, batch) that no later batch took out."""
    gone = _held(rows.sparkSession, f"{path}/replaced", f"{chunk} long, was int, batch int").select(chunk, F.col("was").alias("batch"))
    return rows.join(gone, [chunk, "batch"], "left_anti")


def live_chunks(spark: SparkSession, path: str, book: str, chunk: str) -> DataFrame:
    """(book, chunk) of every chunk that is there."""
    held = _held(spark, f"{path}/chunks", _chunks(book, chunk)).where(~F.col("gone") & F.col(chunk).isNotNull())
    return _current(held, path, chunk).select(book, chunk)


def postings(spark: SparkSession, path: str, book: str, chunk: str, terms: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Live (book, chunk, token); with terms only tokens that begin with one of them, from their buckets alone.

    A term of one character may be in any bucket and reads them all.
    """
    held = _held(spark, f"{path}/postings", f"{book} string, {POSTINGS}")
    if terms is not None:
        if all(len(t) > 1 for t in terms):
            held = held.where(F.col("bucket").isin(*[bucket(F.lit(t), buckets) for t in terms]))
        held = held.where(reduce(Column.__or__, [F.col("token").startswith(t) for t in terms]))
    return _live(held, path, book, chunk)


def _live(held: DataFrame, path: str, book: str, chunk: str) -> DataFrame:
    """(book, chunk, token) of stored segments, without what was replaced."""
    flat = held.select(book, "token", "batch", F.col("segment"), F.explode("offsets").alias("offset")).select(book, "token", "batch", (F.col("segment") * S.SPAN + F.col("offset")).alias(chunk))
    return _current(flat, path, chunk).select(book, chunk, "token")


def segments(spark: SparkSession, path: str, book: str, chunk: str) -> DataFrame:
    """Live postings as book, token, segment, offsets.

    Segments none of whose chunks was replaced are taken as they are stored; only the
    others are taken apart.  Those of several batches are put together.
    """
    held = _held(spark, f"{path}/postings", f"{book} string, {POSTINGS}")
    gone = _held(spark, f"{path}/replaced", f"{chunk} long, was int, batch int").select(F.floor(F.col(chunk) / S.SPAN).cast("long").alias("segment"), F.col("was").alias("batch")).distinct()
    whole = held.join(gone, ["segment", "batch"], "left_anti").select(book, "token", "segment", "offsets")
    parts = S.segments(_live(held.join(gone, ["segment", "batch"], "left_semi"), path, book, chunk), book, chunk)
    one = whole.unionByName(parts).groupBy(book, "token", "segment")
    return one.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))


def candidates(spark: SparkSession, path: str, book: str, chunk: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """book, chunk, score by the rules of `search.candidates`, from the stored index alone."""
    return S.scored(postings(spark, path, book, chunk, terms, buckets), live_chunks(spark, path, book, chunk), book, chunk, terms)


def compact(spark: SparkSession, path: str, to: str, book: str, chunk: str, buckets: int = BUCKETS) -> None:
    """The live postings and chunks of an index as the one batch of a new one."""
    gathered(postings(spark, path, book, chunk), book, chunk, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/postings/batch=0")
    live_chunks(spark, path, book, chunk).select(book, chunk, F.lit(False).alias("gone"), F.lit(1).cast("long").alias("parts")).write.mode("overwrite").parquet(f"{to}/chunks/batch=0")

