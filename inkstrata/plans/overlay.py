"""Guarded patches, overrides, coverage, batches and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import text as T
from inkstrata.operators import overlay as O
from inkstrata.plans.registry import query
from inkstrata.sources import read

SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
HASH = f"left(sha1('md' || chr(31) || {SQUEEZED}), 8)"
PATCHES = f"""
    p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {HASH} WHEN 1 THEN '00000000' END AS a, 'patched ' || CAST(doc_id AS VARCHAR) AS value FROM documents WHERE doc_id % 4 <> 3),
    o AS (SELECT d.doc_id, d.text, p.value, CASE WHEN p.value IS NULL THEN 'none' WHEN p.a IS NULL AND {SQUEEZED.replace("text", "d.text")} <> '' THEN 'legacy' WHEN p.a IS NULL THEN 'blank' WHEN p.a = {HASH.replace("(text", "(d.text")} THEN 'applied' ELSE 'drift' END AS outcome
          FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id)"""


def _patched(spark, d, bilingual=False):
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("md"))
    a = F.when(F.col("doc_id") % 4 == 0, O.anchor(md=F.col("md"))).when(F.col("doc_id") % 4 == 1, F.lit("00000000"))
    patches = docs.where("doc_id % 4 <> 3").select("doc_id", a.alias("a"), F.concat(F.lit("patched "), F.col("doc_id").cast("string")).alias("value"))
    return O.apply_patches(docs, patches, ["doc_id"], "md", bilingual)


@query(f"SELECT doc_id, {HASH} AS a FROM documents")
def content_anchor(spark, d):
    return read(spark, d, "documents").select("doc_id", O.anchor(md=F.col("text")).alias("a"))


@query(f"WITH {PATCHES} SELECT doc_id, CASE WHEN outcome IN ('applied', 'legacy') THEN value ELSE text END AS md FROM o")
def overlay_replace(spark, d):
    return _patched(spark, d).select("doc_id", "md")


@query(f"WITH {PATCHES} SELECT doc_id, length(text) AS n, CASE WHEN outcome IN ('applied', 'legacy') THEN value END AS md_zh FROM o")
def overlay_bilingual(spark, d):
    return _patched(spark, d, True).select("doc_id", F.length("md").cast("long").alias("n"), "md_zh")


@query(f"WITH {PATCHES} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def overlay_drift_report(spark, d):
    return _patched(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT lang, count(*) AS translatable, count(l.doc_id) AS translated, count(*) FILTER (l.doc_id IS NULL AND length(text) >= 100) AS real_miss, count(*) FILTER (l.doc_id IS NULL AND length(text) < 100) AS empty_miss,
      round(count(l.doc_id) / count(*), 6) AS ratio, grouping(lang) = 1 AS is_total
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY ROLLUP (lang)
""")
def overlay_coverage(spark, d):
    units = read(spark, d, "documents").select("doc_id", "lang", "text")
    return O.coverage(units, read(spark, d, "labels").select("doc_id"), ["doc_id"], "lang", F.length("text") >= 100)


@query(f"""
    WITH n AS (SELECT lang, {SQUEEZED} AS t, count(DISTINCT doc_id) AS n, min(doc_id) AS idx FROM documents GROUP BY 1, 2)
    SELECT d.doc_id, CASE WHEN n = 1 THEN idx END AS match_idx FROM documents d JOIN n ON n.lang = d.lang AND n.t = {SQUEEZED.replace("text", "d.text")}
""")
def realign_unique_match(spark, d):
    docs = read(spark, d, "documents").select("lang", "doc_id", T.squeeze(F.col("text")).alias("t"))
    return O.unique_match(docs.withColumnRenamed("doc_id", "idx"), docs, ["lang"], "t").select("doc_id", "match_idx")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS BIGINT) AS batch FROM conversations")
def batch_units(spark, d):
    return O.batches(read(spark, d, "conversations"), ["conv_id"], ["turn"], 2).select("conv_id", "turn", "batch")


@query("""
    WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role <> 'system') AS got, count(*) FILTER (role <> 'system' AND length(text) < 60) AS blank FROM conversations GROUP BY conv_id)
    SELECT conv_id, concat_ws(',', CASE WHEN got < n THEN 'missing' END, CASE WHEN blank > 0 THEN 'empty' END) AS faults FROM c
""")
def marker_validate(spark, d):
    c = read(spark, d, "conversations")
    pair = F.struct(F.col("turn").cast("string").alias("key"), F.when(F.length("text") < 60, "").otherwise(F.col("text")).alias("value"))
    per = c.groupBy("conv_id").agg(F.collect_set(F.col("turn").cast("string")).alias("expected"), F.map_from_entries(F.collect_list(F.when(F.col("role") != "system", pair))).alias("got"))
    return per.select("conv_id", F.array_join(O.marker_faults(F.col("expected"), F.col("got")), ",").alias("faults"))


PROBLEMS = "p AS (SELECT o_orderkey, o_custkey % 10 AS ch, CAST(o_orderkey % 700 AS VARCHAR) || '.' || CAST(o_custkey % 9 AS VARCHAR) AS num FROM orders)"
ANSWERS = "s AS (SELECT ch, num, max(qty) AS solution FROM (SELECT l_suppkey % 10 AS ch, CAST(l_partkey % 700 AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS num, l_quantity AS qty FROM lineitem) GROUP BY 1, 2)"


def _problems(spark, d):
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("ch"), F.concat_ws(".", (F.col("o_orderkey") % 700).cast("string"), (F.col("o_custkey") % 9).cast("string")).alias("num"))


def _answers(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("ch"), F.concat_ws("-", (F.col("l_partkey") % 700).cast("string"), F.col("l_linenumber").cast("string")).alias("num"), "l_quantity")
    return rows.groupBy("ch", "num").agg(F.max("l_quantity").alias("solution"))


@query(f"WITH {PROBLEMS}, {ANSWERS} SELECT o_orderkey, p.ch, p.num, solution FROM p LEFT JOIN s ON s.ch = p.ch AND s.num = replace(p.num, '.', '-')")
def align_left_join(spark, d):
    return O.align(_problems(spark, d), _answers(spark, d), ["ch"], "num", dash=True)


@query(f"WITH {PROBLEMS}, {ANSWERS} SELECT p.ch, count(*) AS problems, count(solution) AS matched, round(count(solution) / count(*), 6) AS rate FROM p LEFT JOIN s ON s.ch = p.ch AND s.num = replace(p.num, '.', '-') GROUP BY p.ch")
def align_stats(spark, d):
    return O.align_stats(align_left_join(spark, d), ["ch"])


@query(f"WITH {PROBLEMS}, {ANSWERS} SELECT ch, num, solution FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ch = s.ch AND replace(p.num, '.', '-') = s.num)")
def align_unmatched(spark, d):
    return O.unmatched(_answers(spark, d), _problems(spark, d), ["ch"], "num", dash=True)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_key_wins(spark, d):
    return O.last_wins(read(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fill_only_merge_whole(spark, d):
    """All labels, and every document that has none."""
    base = read(spark, d, "labels").select("doc_id", "quality")
    return O.fill_only(base, read(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '!' ELSE p_type END AS p_type, CASE p_partkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'noop' WHEN 2 THEN 'skip-drift' ELSE 'none' END AS outcome FROM part
""")
def overrides_outcome(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_type")
    k = F.col("p_partkey") % 4
    rows = part.where(k != 3).select("p_partkey", F.when(k == 2, "other").otherwise(F.col("p_type")).alias("expect"), F.when(k == 1, F.col("p_type")).otherwise(F.concat("p_type", F.lit("!"))).alias("new"))
    return O.apply_overrides(part, rows, ["p_partkey"], "p_type").select("p_partkey", "p_type", "outcome")


@query("SELECT count(*) FILTER (s_suppkey IS NULL) AS added, count(s_suppkey) AS replaced FROM customer LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier) s ON s_suppkey = c_custkey")
def override_merge_counts_whole(spark, d):
    """All suppliers as base, all customers as overrides of the same ids."""
    base = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return O.merge_overrides(base, read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))[1]


@query("SELECT conv_id, turn, instr(text, substr(text, 11, 20)) AS at FROM conversations")
def quote_locate(spark, d):
    c = read(spark, d, "conversations")
    quote = F.substr("text", F.lit(11), F.lit(20))
    return c.select("conv_id", "turn", O.locate_quote(F.col("text"), F.lit("\x00"), quote, F.lit(None).cast("string")).cast("long").alias("at"))
