"""Formulas: skeletons, clusters, signals, delimiters, containment, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import mathx as M
from inkstrata.operators import residual as R
from inkstrata.plans.registry import query
from inkstrata.sources import read


def _words(spark, d, *keep):
    """Every word of every text."""
    return read(spark, d, "documents").select(*keep, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("tex"))


@query("""
    WITH w AS (SELECT source AS slug, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tex FROM documents)
    SELECT tex, count(*) AS total_occ, count(DISTINCT slug) AS books FROM w GROUP BY tex
""")
def residual_groups_whole(spark, d):
    rows = _words(spark, d, F.col("source").alias("slug")).select("*", F.lit(1).alias("occ"), F.lit(False).alias("display"))
    return R.groups(rows).select("tex", "total_occ", "books")


@query("""
    WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{6,}')) AS span FROM documents), s AS (SELECT doc_id % 50 AS unit, span, count(*) AS n FROM u WHERE doc_id % 100 < 50 GROUP BY 1, 2), o AS (SELECT doc_id % 50 AS unit, span, count(*) AS n FROM u WHERE doc_id % 100 >= 50 GROUP BY 1, 2)
    SELECT unit, bool_and(coalesce(o.n, 0) >= coalesce(s.n, 0)) AS contains, bool_or(coalesce(o.n, 0) > coalesce(s.n, 0)) AS extra FROM s FULL JOIN o USING (unit, span) GROUP BY unit
""")
def multiset_containment(spark, d):
    u = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("unit"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))).alias("w"))
    s, o = (R.span_counts(u.where(c), ["unit"], F.col("w")) for c in ("doc_id % 100 < 50", "doc_id % 100 >= 50"))
    return R.containment(s, o, ["unit"])


HALVES = "e AS (SELECT *, CAST(floor(value) AS BIGINT) AS place FROM events), b AS (SELECT DISTINCT user_id, event_type, place FROM e WHERE event_id % 2 = 0), a AS (SELECT DISTINCT user_id, event_type, place FROM e WHERE event_id % 2 = 1)"


@query(f"WITH {HALVES} SELECT user_id, event_type, place, CASE WHEN a.x IS NULL THEN 'fixed' WHEN b.x IS NULL THEN 'collateral' ELSE 'still_bad' END AS change FROM (SELECT *, 1 AS x FROM b) b FULL JOIN (SELECT *, 1 AS x FROM a) a USING (user_id, event_type, place)")
def report_diff(spark, d):
    """Every event is a bad place of the report before (even ids) or after (odd ones)."""
    e = read(spark, d, "events").withColumn("place", F.floor("value").cast("long"))
    return R.diff(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type", "place"])


@query("""
    WITH b AS (SELECT user_id, count(*) AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT user_id, count(*) AS a FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT sum(coalesce(b, 0)) AS before_occ, sum(coalesce(a, 0)) AS after_occ, count(*) FILTER (coalesce(a, 0) > coalesce(b, 0)) AS regressed, sum(coalesce(a, 0)) - sum(coalesce(b, 0)) AS delta,
      sum(coalesce(a, 0)) < sum(coalesce(b, 0)) AND count(*) FILTER (coalesce(a, 0) > coalesce(b, 0)) = 0 AS ok FROM b FULL JOIN a USING (user_id)
""".replace("sum(coalesce(b, 0)) AS before_occ", "CAST(sum(coalesce(b, 0)) AS BIGINT) AS before_occ").replace("sum(coalesce(a, 0)) AS after_occ", "CAST(sum(coalesce(a, 0)) AS BIGINT) AS after_occ").replace("sum(coalesce(a, 0)) - sum(coalesce(b, 0)) AS delta", "CAST(sum(coalesce(a, 0)) - sum(coalesce(b, 0)) AS BIGINT) AS delta"))
def regression_gate(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "slug")
    b = e.where("event_id % 2 = 0").groupBy("slug").agg(F.count(F.lit(1)).alias("occ"))
    a = e.where("event_id % 2 = 1").groupBy("slug").agg(F.count(F.lit(1)).alias("occ"))
    return R.gate(b, a)


@query(r"""
    WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\$\$')) AS dd, length(regexp_replace(regexp_replace(text, '\${2,}', '', 'g'), '[^$]', '', 'g')) AS one FROM documents)
    SELECT doc_id, CASE WHEN dd % 2 = 1 THEN 'unbalanced display dollar' WHEN one % 2 = 1 THEN 'unbalanced inline dollar' END AS fault FROM c
""")
def delimiter_faults(spark, d):
    return read(spark, d, "documents").select("doc_id", M.delimiter_fault(F.col("text")).alias("fault"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'signup' THEN 'missing' WHEN value < 5 THEN 'unrecoverable' WHEN event_type = 'error' THEN 'render_err' WHEN value < 20 THEN 'render_fail' WHEN event_type = 'purchase' THEN 'semantic_fail' WHEN user_id % 2 = 0 THEN 'locate_fail' ELSE 'accepted' END AS outcome FROM events
""")
def batch_outcomes(spark, d):
    t = F.col("event_type")
    out = R.batch_outcome(F.when(t != "signup", t), F.col("value") < 5, F.when(t != "error", F.col("value") >= 20), F.when(t == "purchase", "x"), F.col("user_id") % 2 != 0)
    return read(spark, d, "events").select("event_id", out.alias("outcome"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'no-node' WHEN p_size <= 5 THEN 'converged' WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'fixpoint' ELSE 'due' END AS decision FROM part")
def sweep_decisions(spark, d):
    s = F.col("p_size")
    out = R.sweep_decision(s % 10 != 0, s, F.lit(5), s % 3 == 0, s, s % 2 != 0)
    return read(spark, d, "part").select("p_partkey", out.alias("decision"))


def formula_regions(spark, d):
    """Formula regions of the documents (checked against a plain scanner in the tests)."""
    docs = read(spark, d, "documents").where(F.col("text").contains("$")).select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(M.math_regions(F.col("text"))).alias("pos", "r")).select("doc_id", "pos", "r.start", "r.stop", "r.display")


query()(formula_regions)


@query("SELECT DISTINCT 'b' || ':' || left(sha1('0' || chr(0) || w), 8) AS gid FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)")
def finding_ids_whole(spark, d):
    return _words(spark, d).distinct().select(R.gid(F.lit("b"), F.col("tex"), F.lit(False)).alias("gid")).distinct()


@query("SELECT lang, 'text' AS field, count(*) AS n FROM documents WHERE length(trim(text)) > 0 GROUP BY lang UNION ALL SELECT lang, 'source', count(*) FROM documents WHERE length(trim(source)) > 0 GROUP BY lang")
def text_units_whole(spark, d):
    """Documents of every language."""
    u = R.units(read(spark, d, "documents"), ["lang"], ["text", "source"])
    return u.groupBy("lang", "field").agg(F.count(F.lit(1)).alias("n"))
