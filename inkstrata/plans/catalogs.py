"""References, contexts, catalogue counts, audits and repair candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import numbers as N
from inkstrata.operators import catalogs as C
from inkstrata.plans.registry import query
from inkstrata.sources import read


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS slug, CAST(l_suppkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_returnflag = 'R' THEN 'b' ELSE '' END AS ref FROM lineitem),
    h AS (SELECT DISTINCT l_orderkey AS slug, CAST(l_suppkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS num FROM lineitem WHERE l_quantity > 10),
    w AS (SELECT DISTINCT l_orderkey AS slug, CAST(l_suppkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS ref FROM lineitem WHERE l_tax = 0)
    SELECT slug, ref FROM r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.slug = r.slug AND h.num = r.ref) AND NOT EXISTS (SELECT 1 FROM h WHERE h.slug = r.slug AND h.num = regexp_replace(r.ref, '[a-z]$', '') AND r.ref LIKE '%b')
      AND NOT EXISTS (SELECT 1 FROM w WHERE w.slug = r.slug AND w.ref = r.ref)
""")
def ref_missing(spark, d):
    rows = read(spark, d, "lineitem")
    num = F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    refs = rows.select(F.col("l_orderkey").alias("slug"), F.lit("figure").alias("kind"), F.concat(num, F.when(F.col("l_returnflag") == "R", "b").otherwise("")).alias("ref")).distinct()
    have = rows.where("l_quantity > 10").select(F.col("l_orderkey").alias("slug"), F.lit("figure").alias("kind"), num.alias("num"))
    waived = rows.where("l_tax = 0").select(F.col("l_orderkey").alias("slug"), F.lit("figure").alias("kind"), num.alias("ref"))
    return C.uncovered(refs, have, ["slug"], waived).select("slug", "ref")


@query("""
    WITH w AS (SELECT conv_id, turn, role, last_value(CASE WHEN role <> 'assistant' AND trim(text) <> '' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      first_value(CASE WHEN role <> 'assistant' AND trim(text) <> '' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
      row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) AS ordinal FROM conversations)
    SELECT conv_id, turn, before, after, ordinal FROM w WHERE role = 'assistant'
""")
def nearest_context(spark, d):
    c = read(spark, d, "conversations")
    said = F.when(F.trim("text") != "", F.col("turn").cast("string"))
    out = C.nearest_text(c, ["conv_id"], "turn", F.col("role") == "assistant", said)
    return out.select("conv_id", "turn", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), F.col("ordinal").cast("long").alias("ordinal"))


@query("""
    WITH r AS (SELECT user_id, event_id AS pos, CASE WHEN event_type <> 'error' THEN event_id % 50 END AS num FROM events), t AS (SELECT DISTINCT user_id, 20 AS target FROM events),
    b AS (SELECT t.user_id, target, arg_max(pos, num) FILTER (num < target) AS lo, arg_min(pos, num) FILTER (num > target) AS hi FROM t JOIN (SELECT user_id, min(pos) AS pos, num FROM r WHERE num IS NOT NULL GROUP BY 1, 3) r ON r.user_id = t.user_id GROUP BY 1, 2)
    SELECT b.user_id, min(pos) AS pos FROM b JOIN r ON r.user_id = b.user_id WHERE r.num IS NULL AND pos > lo AND pos < hi GROUP BY b.user_id HAVING count(*) = 1
""")
def sequence_gap_fill(spark, d):
    e = read(spark, d, "events")
    numbered = e.where("event_type <> 'error'").groupBy("user_id", (F.col("event_id") % 50).alias("num")).agg(F.min("event_id").alias("pos"))
    rows = numbered.select("user_id", "pos", "num").unionByName(e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("pos"), F.lit(None).cast("long").alias("num")))
    wanted = e.select("user_id", F.lit(20).cast("long").alias("target")).distinct()
    return C.gap_candidates(rows, wanted, ["user_id"]).select("user_id", "pos")


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS figure, count(*) FILTER (l_returnflag = 'N') AS \"table\", count(*) FILTER (l_returnflag = 'R') AS equation FROM lineitem GROUP BY l_suppkey")
def pivot_counts(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "figure").when(F.col("l_returnflag") == "N", "table").otherwise("equation")
    return C.counts(read(spark, d, "lineitem").withColumn("type", kind), ["l_suppkey"])


@query("""
    WITH c AS (SELECT 'C1' AS code, CAST(doc_id AS VARCHAR) AS item FROM documents WHERE length(text) < 60 UNION ALL SELECT 'C2', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'C3', CAST(min(doc_id) AS VARCHAR) FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'C4', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
    SELECT k.code, coalesce(n, 0) AS n FROM (VALUES ('C1'), ('C2'), ('C3'), ('C4')) k(code) LEFT JOIN (SELECT code, count(*) AS n FROM c GROUP BY code) x ON x.code = k.code
""")
def audit_findings(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels").select("doc_id")
    checks = {
        "C1": docs.where(F.length("text") < 60).select(F.col("doc_id").alias("item")),
        "C2": docs.join(labels, "doc_id", "left_anti").select(F.col("doc_id").alias("item")),
        "C3": docs.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("item")).where("n > 1").select("item"),
        "C4": labels.join(docs, "doc_id", "left_anti").select(F.col("doc_id").alias("item")),
    }
    return C.audit_counts(C.audit(checks, ["item"]), list(checks))


@query("""
    WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0)),
    b AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0)))
    SELECT a.l_orderkey, a.l_partkey, b.l_suppkey FROM a JOIN b USING (l_orderkey, k, n)
""")
def zip_groups(spark, d):
    """Every line item is on one side; groups of equal size are zipped by their order."""
    rows = read(spark, d, "lineitem").withColumn("left", F.expr("l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0)"))
    a = rows.where("left").select("l_orderkey", "l_partkey", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("oa"))
    b = rows.where("NOT left").select("l_orderkey", "l_suppkey", F.struct("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice").alias("ob"))
    return C.zip_by_ordinal(a, b, ["l_orderkey"], "oa", "ob").select("l_orderkey", "l_partkey", "l_suppkey")
