"""States, roll-ups, selection, matching and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import numbers as N
from inkstrata.functions import titles as T
from inkstrata.operators import universe as U
from inkstrata.plans.registry import query
from inkstrata.sources import read

NOW = "2001-06-01 00:00:00"

WORKS = """
    inv AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000),
    w AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, inv.k IS NOT NULL AS owned,
            CASE c_custkey % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'found' WHEN 2 THEN 'not_found' END AS link, c_custkey % 5 = 3 AS absent,
            CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN NULL ELSE c_custkey % 2 = 0 END AS eligible, CASE WHEN c_custkey % 4 < 3 THEN true END AS matches FROM customer LEFT JOIN inv ON inv.k = c_custkey),
    s AS (SELECT *, CASE WHEN owned THEN 'owned' WHEN link = 'not_found' OR (absent AND link IS NULL) THEN 'rejected' WHEN eligible = false THEN 'rejected' WHEN link = 'found' THEN CASE WHEN coalesce(eligible, false) AND coalesce(matches, false) THEN 'qualified' ELSE 'pending' END ELSE 'candidate' END AS state FROM w)"""


def _works(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").withColumn("slug", k.cast("string"))
    works = c.withColumn("eligible", F.when(k % 3 == 0, True).when(k % 3 == 2, k % 2 == 0)).withColumn("matches_pref", F.when(k % 4 < 3, True)).withColumn("aligned", F.lit(None).cast("boolean"))
    inventory = read(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 450000").select(F.col("o_custkey").cast("string").alias("slug"))
    links = c.select("slug", F.when((k % 5) < 2, "found").when(k % 5 == 2, "not_found").alias("link"), (k % 5 == 3).alias("absent"))
    return U.classify(works, inventory, links)


@query(f"WITH {WORKS} SELECT c_custkey, state FROM s")
def five_state(spark, d):
    return _works(spark, d).select("c_custkey", "state")


@query(f"WITH {WORKS} SELECT c_mktsegment AS field, count(*) AS total, count(*) FILTER (state = 'candidate') AS candidate, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'qualified') AS qualified, count(*) FILTER (state = 'owned') AS owned, count(*) FILTER (state = 'rejected') AS rejected, grouping(c_mktsegment) = 1 AS is_total FROM s GROUP BY ROLLUP (c_mktsegment)")
def state_rollup(spark, d):
    return U.progress(_works(spark, d).withColumnRenamed("c_mktsegment", "field"))


@query(f"WITH {WORKS} SELECT c_custkey FROM s WHERE state = 'qualified' AND c_acctbal > 0 AND c_custkey % 11 <> 0 ORDER BY c_nationkey, c_custkey LIMIT 20")
def select_next(spark, d):
    w = _works(spark, d).withColumn("link_id", F.when(F.col("c_acctbal") > 0, F.col("slug"))).withColumn("link_hash", F.col("slug"))
    return U.select_next(w, 20, ["c_nationkey", "c_custkey"], w.where("c_custkey % 11 = 0").select("slug")).select("c_custkey")


@query("""
    WITH inv AS (SELECT DISTINCT o_custkey AS k FROM orders), u AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
    SELECT side, count(*) AS n FROM (SELECT 'owned_not_listed' AS side FROM inv WHERE k NOT IN (SELECT k FROM u) UNION ALL SELECT 'listed_not_owned' FROM u WHERE k NOT IN (SELECT k FROM inv)) GROUP BY side
""")
def reconcile(spark, d):
    inv = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("slug"))
    return U.reconcile(read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("slug")), inv).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 45 DAY AS resting FROM orders")
def cooldown_actionable(spark, d):
    return read(spark, d, "orders").select("o_orderkey", U.resting(F.col("o_orderdate"), F.lit(NOW).cast("timestamp"), 45).alias("resting"))


TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('the','a','an','of','and','for','to','in','on','with','vol','volume','edition','ed')))"


@query(f"""
    WITH p AS (SELECT a.p_partkey, {TOK.format("a.p_name || ' ' || a.p_type")} AS x, {TOK.format("b.p_name || ' of ' || b.p_brand")} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS overlap FROM p
""")
def title_overlap(spark, d):
    a = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("x"))
    b = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" of ", "p_name", "p_brand").alias("y"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("""
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 10.0 ELSE 0.0 END + CASE WHEN mb BETWEEN 3 AND 80 THEN 5.0 WHEN mb >= 1.5 AND mb <= 150 THEN 1.0 WHEN mb < 1.5 THEN -3.0 ELSE 0.0 END + 2.0 + CASE WHEN yr >= 2000 THEN least((yr - 2000) / 10.0, 2.0) ELSE 0.0 END + least(p_size / 2.0, 2.5) + CASE WHEN p_size * 3 > 50 THEN 1.0 ELSE 0.0 END AS score
    FROM (SELECT *, p_retailprice / 10 - 88 AS mb, 1990 + p_size AS yr FROM part)
""")
def suitability_score(spark, d):
    p = read(spark, d, "part")
    size = (F.col("p_retailprice") / 10 - 88) * 1e6
    s = T.suitability(size, F.when(F.col("p_type") == "PROMO", "PDF").otherwise("djvu"), F.col("p_brand"), (F.col("p_size") + 1990).cast("string"), F.col("p_size").cast("string"), F.col("p_size") * 3)
    return p.select("p_partkey", s.alias("score"))


@query("""
    WITH s AS (SELECT DISTINCT left(p_name, 4) AS slug FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size > 25), k AS (SELECT DISTINCT p_name || '_x' AS key FROM part)
    SELECT key, arg_max(slug, length(slug)) AS slug FROM k JOIN s ON starts_with(key, slug) GROUP BY key
""")
def longest_prefix(spark, d):
    p = read(spark, d, "part")
    slugs = p.select(F.left("p_name", F.lit(4)).alias("slug")).union(p.where("p_size > 25").select("p_name"))
    return U.longest_prefix(p.select(F.concat("p_name", F.lit("_x")).alias("key")).distinct(), slugs)


@query("SELECT p_partkey, row_number() OVER (ORDER BY coalesce(n_regionkey, 9999), p_size, p_retailprice, p_partkey) AS rank FROM part LEFT JOIN nation ON n_nationkey = p_size")
def universe_order(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("field_id"), F.col("p_size").alias("subject_rank"), F.col("p_retailprice").alias("book_rank"), F.lit("main").alias("kind"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("slug"))
    fields = read(spark, d, "nation").select(F.col("n_nationkey").alias("field_id"), F.col("n_regionkey").alias("field_order"))
    return U.ordered(p, fields).select("p_partkey", F.col("rank").cast("long").alias("rank"))
