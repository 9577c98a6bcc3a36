"""The jobs as registered queries: each runs twice into one new folder, the second time over what is already taken."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.plans.overlay import HASH
from inkstrata.plans.registry import ORACLE_SQL as SQL
from inkstrata.plans.search import TOKENS
from inkstrata.sources import shared_dir
from jobs import publish_library, search_index


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    config = {"documents": f"{sf_dir}/documents.parquet", "index": f"{folder}/index", "checkpoint": f"{folder}/checkpoint"}
    search_index.run(spark, config)
    search_index.run(spark, config)
    return search_index.read(spark, config)


def job2_publish_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"documents": f"{sf_dir}/documents.parquet", "library": _folder(spark, "job2")}
    publish_library.run(spark, config)
    publish_library.run(spark, config)
    pages, books = publish_library.read(spark, config)
    both = pages.withColumn("part", F.lit("page")).unionByName(books.withColumn("part", F.lit("book")), allowMissingColumns=True)
    return both.select("part", "lang", "source", "doc_id", "anchor", "preview", "n_chars", "n_terms", "fault", "copy_of", "chapters", "empty", "copies", "faults", "first_chapter", "status")


QUERIES = {"job1_search_index": job1_search_index, "job2_publish_library": job2_publish_library}

JOB1_SQL = f"""
WITH {TOKENS}
SELECT lang, token, doc_id // 65536 AS segment, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS chunks FROM tok WHERE doc_id IS NOT NULL GROUP BY lang, token, segment
"""

JOB2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(nullif(lang, ''), 'none') AS lang, coalesce(nullif(source, ''), 'none') AS source, coalesce(text, '') AS text FROM documents),
v AS ({SQL["preview_text"].replace("FROM documents", "FROM d")}),
f AS ({SQL["delimiter_faults"].replace("FROM documents", "FROM d")}),
t AS (SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) BETWEEN 2 AND 30))) AS n_terms FROM d),
c AS (SELECT lang, source, text, min(doc_id) AS first FROM d WHERE text <> '' GROUP BY lang, source, text),
p AS (SELECT d.lang, d.source, d.doc_id, {HASH.replace("(text", "(d.text")} AS anchor, v.preview, length(d.text) AS n_chars, t.n_terms, f.fault, CASE WHEN c.first <> d.doc_id THEN c.first END AS copy_of
      FROM d JOIN v ON v.doc_id = d.doc_id JOIN f ON f.doc_id = d.doc_id JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.lang = d.lang AND c.source = d.source AND c.text = d.text),
b AS (SELECT lang, source, count(*) AS chapters, count(*) FILTER (n_chars = 0) AS empty, count(copy_of) AS copies, count(fault) AS faults, sum(n_chars) AS n_chars, min(doc_id) AS first_chapter FROM p GROUP BY lang, source)
SELECT 'page' AS part, lang, source, doc_id, anchor, preview, n_chars, n_terms, fault, copy_of, CAST(NULL AS BIGINT) AS chapters, CAST(NULL AS BIGINT) AS empty, CAST(NULL AS BIGINT) AS copies, CAST(NULL AS BIGINT) AS faults, CAST(NULL AS BIGINT) AS first_chapter, CAST(NULL AS VARCHAR) AS status FROM p
UNION ALL
SELECT 'book', lang, source, NULL, NULL, NULL, CAST(n_chars AS BIGINT), NULL, NULL, NULL, chapters, empty, copies, faults, first_chapter,
       CASE WHEN chapters < 2 OR empty = chapters THEN 'blocked' WHEN copies > chapters * 0.5 OR faults > chapters * 0.2 THEN 'review' ELSE 'ready' END FROM b
"""

ORACLE_SQL = {"job1_search_index": JOB1_SQL, "job2_publish_library": JOB2_SQL}
