"""Full-text index, ranked search, previews and facets over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkstrata.functions import text as T
from inkstrata.operators import search as S
from inkstrata.operators import stored as X
from inkstrata.plans.registry import query
from inkstrata.sources import read, shared_dir

TERMS = ["ther", "onen", "th"]
STORED_TERMS = ["ch", "enen", "con"]

TOKENS = r"""
    tok AS (SELECT DISTINCT lang, doc_id, token FROM (SELECT lang, doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS token FROM documents)
            WHERE length(token) BETWEEN 2 AND 30),
    n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    df AS (SELECT t.lang, token, count(*) AS df, min(doc_id) AS first_chunk, any_value(CASE WHEN n > 5 THEN greatest(3, CAST(floor(n * 0.6) AS BIGINT)) ELSE n + 1 END) AS cut
           FROM tok t JOIN n ON t.lang = n.lang GROUP BY t.lang, token)"""


@query(f"WITH {TOKENS} SELECT lang, token, df, df >= cut AS common, CASE WHEN df < cut THEN first_chunk END AS first_chunk, CASE WHEN df < cut THEN df END AS n_chunks FROM df")
def search_index_postings(spark, d):
    ix = S.index(read(spark, d, "documents"), "lang", "doc_id")
    first = F.min(F.col("segment") * S.SPAN + F.get("offsets", F.lit(0)))
    return ix.groupBy("lang", "token", "df", "common").agg(first.alias("first_chunk"), F.sum(F.when(F.col("offsets").isNotNull(), F.size("offsets"))).alias("n_chunks"))


@query(f"WITH {TOKENS} SELECT lang, token, df FROM df WHERE df >= cut")
def search_common_tokens(spark, d):
    return S.document_frequency(read(spark, d, "documents"), "lang").where("common").select("lang", "token", "df")


RANKED = """
    q AS (SELECT * FROM (VALUES (0, '{0}'), (1, '{1}'), (2, '{2}')) v(k, term)),
    asked AS (SELECT d.lang, q.k, d.token, d.df >= d.cut AS common, d.token = q.term AS exact FROM df d JOIN q ON starts_with(d.token, q.term)),
    mode AS (SELECT lang, k, CASE WHEN bool_or(exact AND NOT common) THEN 'exact' WHEN bool_or(exact AND common) THEN 'all' WHEN bool_or(NOT common) THEN 'prefix' ELSE 'all' END AS mode FROM asked GROUP BY lang, k),
    full_ AS (SELECT lang, count(*) FILTER (mode = 'all') AS everywhere FROM mode GROUP BY lang HAVING count(*) = 3),
    used AS (SELECT a.lang, a.k, a.token FROM asked a JOIN mode m ON a.lang = m.lang AND a.k = m.k WHERE (mode = 'exact' AND exact) OR (mode = 'prefix' AND NOT common)),
    hits AS (SELECT t.lang, t.doc_id, count(DISTINCT u.k) AS own FROM tok t JOIN used u ON t.lang = u.lang AND t.token = u.token GROUP BY t.lang, t.doc_id),
    s AS (SELECT d.lang, d.doc_id, coalesce(own, 0) + everywhere AS score FROM documents d JOIN full_ f ON d.lang = f.lang LEFT JOIN hits h ON h.lang = d.lang AND h.doc_id = d.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT lang, doc_id, score, rank FROM r WHERE rank <= 12
"""


@query(f"WITH {TOKENS}, {RANKED.format(*TERMS)}")
def search_ranked_candidates(spark, d):
    return S.ranked(S.candidates(read(spark, d, "documents"), "lang", "doc_id", TERMS), "lang", "doc_id", 12)


#: Documents after a second batch: those with a label of low quality come again in other words, toxic ones are gone.
CHANGED = """changed AS (SELECT d.lang, d.doc_id, CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 0 THEN concat('again ', replace(text, 'e', 'o')) ELSE text END AS text FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
    now AS (SELECT * FROM changed WHERE text IS NOT NULL)"""


def _first_batch(spark, d):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select("lang", "doc_id", "text")
    X.add(docs, path, 0, "lang", "doc_id")
    return path, docs


def _second_batch(spark, d, path, docs):
    """Adds the changed rows alone to the stored index."""
    marks = read(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).where("toxic = 1 OR quality = 0")
    text = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.concat(F.lit("again "), F.translate("text", "e", "o")))
    X.add(docs.join(marks, "doc_id").withColumn("text", text), path, 1, "lang", "doc_id")


@query(f"WITH {TOKENS}, {RANKED.format(*STORED_TERMS)}")
def stored_search(spark, d):
    """The same search from the stored index: the buckets of three terms are read, no text is."""
    path, _ = _first_batch(spark, d)
    return S.ranked(X.candidates(spark, path, "lang", "doc_id", STORED_TERMS), "lang", "doc_id", 12)


@query(f"WITH {CHANGED}, {TOKENS.replace('documents', 'now')}, {RANKED.replace('documents', 'now').format(*STORED_TERMS)}")
def maintained_search(spark, d):
    """The search after a second batch of changed and deleted documents, as over an index made anew."""
    path, docs = _first_batch(spark, d)
    _second_batch(spark, d, path, docs)
    return S.ranked(X.candidates(spark, path, "lang", "doc_id", STORED_TERMS), "lang", "doc_id", 12)


@query(f"WITH {CHANGED}, {TOKENS.replace('documents', 'now')} SELECT lang, token, count(*) AS df, min(doc_id) AS first_chunk, max(doc_id) AS last_chunk, sum(doc_id) AS ids FROM tok GROUP BY lang, token")
def compacted_index(spark, d):
    """Every posting after the second batch, from an index written anew without what was replaced."""
    path, docs = _first_batch(spark, d)
    _second_batch(spark, d, path, docs)
    X.compact(spark, path, f"{path}-compact", "lang", "doc_id")
    found = X.postings(spark, f"{path}-compact", "lang", "doc_id")
    return found.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_chunk"), F.max("doc_id").alias("last_chunk"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'ther') AND contains(strip_accents(lower(text)), 'onen') AND contains(strip_accents(lower(text)), 'th')")
def search_verified_hits(spark, d):
    return S.verified(read(spark, d, "documents"), TERMS).select("doc_id", "lang")


@query("""
    WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM documents),
    b AS (SELECT *, left(line, 200) AS cut FROM a),
    c AS (SELECT *, CASE WHEN length(line) <= 200 THEN line WHEN instr(cut, ' ') > 0 AND 200 - instr(reverse(cut), ' ') > 120 THEN left(cut, 200 - instr(reverse(cut), ' ')) ELSE cut END AS body FROM b),
    e AS (SELECT *, CASE WHEN (length(body) - length(replace(body, '$', ''))) % 2 = 1 THEN rtrim(left(body, length(body) - instr(reverse(body), '$'))) ELSE body END AS text FROM c)
    SELECT doc_id, text || CASE WHEN length(line) > 200 THEN '…' ELSE '' END AS preview FROM e
""".replace("\\\\", "\\"))
def preview_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def term_snippets(spark, d):
    """Snippets of the verified hits (checked against a plain version in the tests)."""
    return S.verified(read(spark, d, "documents"), TERMS[:2]).select("doc_id", T.snippet(TERMS[:2])(F.col("text")).alias("snippet"))


query()(term_snippets)


@query("SELECT p_brand, p_type, count(*) AS n, 2 - grouping(p_brand) - grouping(p_type) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)")
def facet_counts_nested(spark, d):
    return S.tree_counts(read(spark, d, "part"), "p_brand", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#7' AND contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'ring')")
def facet_filter_search(spark, d):
    return S.facet_filter(read(spark, d, "part"), "Ring", ["p_name", "p_type", "p_brand"], p_brand="Brand#7").select("p_partkey", "p_name")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counts_by_key(spark, d):
    return S.counts_by(read(spark, d, "events"), "event_type")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def visible_range(spark, d):
    c = read(spark, d, "customer")
    return S.page(c.withColumn("_o", -F.col("c_acctbal")), ["_o", "c_custkey"], 50, 25).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000)")
def late_materialized(spark, d):
    keys = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return S.late(keys, read(spark, d, "orders"), ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def baked_text(spark, d):
    return S.bake(read(spark, d, "conversations"), ["conv_id"], "turn")
