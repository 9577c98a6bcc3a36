"""Ordered streams: blocks, sections, guards, gaps, ids, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.operators import segment as G
from inkstrata.plans.registry import query
from inkstrata.sources import read, tail, upsert

LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


@query("SELECT doc_id, k - 1 AS idx, lines[k] AS line FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))")
def doc_blocks(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def noise_filter(spark, d):
    return G.without_noise(read(spark, d, "conversations").withColumnRenamed("role", "type"), ["system"]).select("conv_id", "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def section_carry(spark, d):
    return G.carry_section(read(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'sec-' || CAST(turn AS VARCHAR) ELSE 'sec-' || CAST(conv_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) END AS anchor
    FROM conversations WHERE role = 'user'
""")
def section_anchors(spark, d):
    heads = read(spark, d, "conversations").where("role = 'user'").withColumn("id", F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")))
    return G.section_anchors(heads, ["conv_id"], "turn", "id", "conv_id").select("conv_id", "turn", "anchor")


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem l JOIN (SELECT o_orderkey, o_custkey % 3 + 1 AS start, o_custkey % 3 + 4 AS stop FROM orders) r ON l.l_orderkey = r.o_orderkey
    WHERE l_linenumber >= start AND l_linenumber < stop GROUP BY 1, 2
""")
def range_slice(spark, d):
    ranges = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 3 + 1).alias("start"), (F.col("o_custkey") % 3 + 4).alias("stop"))
    return G.slice_ranges(read(spark, d, "lineitem"), ranges, ["l_orderkey"], "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, coalesce(min(CASE WHEN l_quantity >= 45 THEN l_linenumber END), count(*)) AS first_idx FROM lineitem GROUP BY l_orderkey")
def first_after_page(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("page_idx"))
    return G.first_after_page(rows, ["l_orderkey"], F.lit(45)).withColumn("first_idx", F.col("first_idx").cast("long"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND 1 < cap AND cap < n THEN cap ELSE n END AS stop
    FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, CAST(floor(len(string_split(text, chr(10))) * 0.8) AS BIGINT) AS cap FROM documents)
""")
def backmatter_cap(spark, d):
    n = F.size(F.split("text", "\n")).cast("long")
    cap = F.floor(n * 0.8).cast("long")
    return read(spark, d, "documents").select("doc_id", G.capped_end(F.lit(1), n, cap, F.col("doc_id") % 2).alias("stop"))


@query(f"""
    SELECT l_orderkey, {LINE_SQL}, before IS NULL OR before <= 0 OR l_linenumber > before AS accepted
    FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem)
""")
def increasing_guard(spark, d):
    return G.increasing(read(spark, d, "lineitem"), ["l_orderkey"], LINE, "l_linenumber").select("l_orderkey", *LINE, "accepted")


@query("""
    WITH e AS (SELECT event_id, user_id, ts, (hash_value * 7 + user_id) % 24 AS hour, hash_value AS day FROM (SELECT *, CAST(value AS BIGINT) % 28 AS hash_value FROM events))
    SELECT event_id, before IS NULL OR day * 100 + hour > before AS accepted
    FROM (SELECT *, max(day * 100 + hour) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
""".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def tuple_guard(spark, d):
    day = F.floor("value") % 28
    e = read(spark, d, "events").withColumn("n", F.array(day, (day * 7 + F.col("user_id")) % 24))
    return G.increasing(e, ["user_id"], ["ts", "event_id"], "n").select("event_id", "accepted")


@query("""
    WITH t AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, unnest(generate_series(1, top)) AS l_linenumber FROM t)
    SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS expected FROM s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.l_linenumber)
""")
def number_gaps(spark, d):
    rows = read(spark, d, "lineitem")
    known = rows.select("l_orderkey", F.explode(F.array(*[F.lit(k).cast("long") for k in (2, 4, 6)])).alias("l_linenumber"))
    return G.missing_numbers(rows, ["l_orderkey"], "l_linenumber", known)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_numbers(spark, d):
    return G.duplicate_numbers(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
    WITH c AS (SELECT user_id % 7 AS book, CAST(floor(date_part('day', ts)) AS BIGINT) AS num, count(*) * 3 AS body_count, count(*) FILTER (event_type = 'click') AS problem_count, count(*) FILTER (event_type = 'error') AS empty_bodies FROM events GROUP BY 1, 2),
    w AS (SELECT *, lag(body_count) OVER (PARTITION BY book ORDER BY num) AS prior FROM c)
    SELECT book, num, 'H1' AS code FROM w WHERE body_count < 20 AND problem_count > 30 UNION ALL
    SELECT book, num, 'H3' FROM w WHERE problem_count > 0 AND empty_bodies = problem_count UNION ALL
    SELECT book, num, 'H5' FROM w WHERE prior >= 50 AND body_count >= 50 AND greatest(body_count, prior) * 1.0 / least(body_count, prior) > 5
""")
def smoke_checks(spark, d):
    e = read(spark, d, "events").withColumn("book", F.col("user_id") % 7).withColumn("num", F.dayofmonth("ts").cast("long"))
    c = e.groupBy("book", "num").agg((F.count(F.lit(1)) * 3).alias("body_count"), F.count_if(F.col("event_type") == "click").alias("problem_count"), F.count_if(F.col("event_type") == "error").alias("empty_bodies")).withColumn("duplicate_numbers", F.lit(0))
    return G.smoke(c, ["book"], "num")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '--' || CAST(n - 1 AS VARCHAR) END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def dedupe_ids(spark, d):
    return G.dedupe_ids(read(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_name").select("p_partkey", "unique_id")


@query("""
    WITH w AS (SELECT event_id, event_type, event_type = 'error' AS alias, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER p AS so_far, row_number() OVER p AS rn, first_value(value < 30) OVER p AS f0,
               first_value(event_type = 'error') OVER p AS first_alias, CAST(floor(value / 10) AS BIGINT) AS ident
               FROM events WINDOW p AS (PARTITION BY user_id, CAST(floor(value / 10) AS BIGINT) ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN rn = 1 OR alias OR so_far - (CASE WHEN first_alias THEN 0 ELSE 1 END) = 0 THEN CAST(ident AS VARCHAR) ELSE CAST(ident AS VARCHAR) || '--' || CAST(so_far - (CASE WHEN first_alias THEN 0 ELSE 1 END) AS BIGINT) END AS unique_id FROM w
""")
def alias_aware_dedupe(spark, d):
    e = read(spark, d, "events").withColumn("ident", F.floor(F.col("value") / 10).cast("string")).withColumn("alias", F.col("event_type") == "error")
    return G.dedupe_ids_with_aliases(e, ["user_id"], ["ts", "event_id"], "ident", "alias").select("event_id", "unique_id")


@query("""
    WITH h AS (SELECT l_suppkey, l_partkey % 40 AS num, l_returnflag = 'R' AS toc, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
    b AS (SELECT l_suppkey, num, min((CASE WHEN toc THEN 1 ELSE 0 END) * 1000000000000 + pos) % 1000000000000 AS pos FROM h GROUP BY 1, 2),
    i AS (SELECT *, num - row_number() OVER (PARTITION BY l_suppkey ORDER BY num) AS island, min(num) OVER (PARTITION BY l_suppkey) - 1 AS first FROM b)
    SELECT l_suppkey, num, pos FROM i WHERE island = first
""")
def chapter_run(spark, d):
    h = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 40).alias("num"), (F.col("l_returnflag") == "R").alias("toc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return G.chapter_run(h, ["l_suppkey"], "num", "pos", F.col("toc"))


@query("""
    SELECT p_partkey, s AS start, least(s + 19, pages) AS stop FROM (SELECT p_partkey, pages, unnest(generate_series(1, greatest(1, pages - 2), 18)) AS s FROM (SELECT p_partkey, p_size * 7 AS pages FROM part))
""")
def plan_chunks(spark, d):
    rows = read(spark, d, "part").withColumn("pages", F.col("p_size") * 7)
    return rows.select("p_partkey", F.inline(G.plan_chunks(F.col("pages"), 20, 2))).select("p_partkey", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("""
    WITH c AS (SELECT user_id, event_id AS chunk_idx, CAST(floor(value) AS BIGINT) + 5 AS pages FROM events),
    s AS (SELECT *, coalesce(sum(pages - 2) OVER (PARTITION BY user_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM c)
    SELECT user_id, chunk_idx, CAST(start AS BIGINT) AS start, CAST(start + pages - 1 AS BIGINT) AS stop FROM s
""")
def rebuild_ranges(spark, d):
    c = read(spark, d, "events").select("user_id", F.col("event_id").alias("chunk_idx"), (F.floor("value") + 5).alias("pages"))
    return G.rebuild_ranges(c, ["user_id"], 2).select("user_id", "chunk_idx", "start", "stop")


@query("SELECT l_orderkey, l_partkey, l_linenumber + (l_suppkey % 5) AS page_idx, count(*) AS n FROM lineitem WHERE l_suppkey % 5 = 0 OR l_linenumber >= 2 GROUP BY 1, 2, 3")
def assemble_pages(spark, d):
    c = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("page"), (F.col("l_suppkey") % 5).alias("chunk_idx"), (F.col("l_suppkey") % 5 + 1).alias("start"))
    return G.assemble(c, ["l_orderkey"], 2).groupBy("l_orderkey", "l_partkey", "page_idx").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 40")
def log_tail(spark, d):
    return tail(read(spark, d, "events"), "event_id", 40).select("event_id", "event_type")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    e = read(spark, d, "events")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")
