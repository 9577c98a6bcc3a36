"""Stages, gates, funnels, timelines, sessions, proposals and reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import numbers as N
from inkstrata.operators import state as P
from inkstrata.plans.registry import query
from inkstrata.sources import read

STAGED = """
    b AS (SELECT c_custkey, c_custkey % 2 = 0 AS uni, c_custkey % 3 = 0 AS parsed, c_custkey % 5 = 0 AS pending, c_custkey % 7 = 0 AS raw, c_custkey % 4 <> 1 AS rules, c_custkey % 9 = 0 AS blocked, c_nationkey AS problems, c_nationkey % 3 AS solved, c_acctbal > 5000 AS zh FROM customer),
    s AS (SELECT *, CASE WHEN NOT uni AND NOT parsed THEN CASE WHEN pending THEN '0.5 ocr' WHEN raw THEN '0 ingest' ELSE 'X missing' END WHEN NOT rules THEN CASE WHEN blocked THEN 'R audit-blocked' ELSE '1 audit' END WHEN NOT parsed THEN '2 parse'
          ELSE CASE WHEN problems > 0 AND solved > 0 THEN '4 merged' ELSE '3 parsed' END || CASE WHEN zh THEN ' +zh' ELSE '' END END AS stage FROM b)"""


def _staged(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return read(spark, d, "customer").withColumn("stage", P.stage(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 4 != 1, k % 9 == 0, n, n % 3, F.col("c_acctbal") > 5000))


@query(f"WITH {STAGED} SELECT c_custkey, stage FROM s")
def stage_derivation(spark, d):
    return _staged(spark, d).select("c_custkey", "stage")


@query(f"""
    WITH {STAGED}, x AS (SELECT c_custkey, stage, CASE WHEN starts_with(stage, 'R') OR starts_with(stage, 'X') THEN 'stuck' WHEN starts_with(stage, '0.5') THEN 'ocr' WHEN starts_with(stage, '0') THEN 'ingest' WHEN starts_with(stage, '1') THEN 'audit' WHEN starts_with(stage, '2') THEN 'parse' WHEN c_custkey % 6 = 0 THEN 'live' ELSE 'deploy' END AS bucket FROM s)
    SELECT k.bucket, count(x.bucket) AS total, count(*) FILTER (x.bucket IS NOT NULL AND c_custkey % 10 < 3) AS held FROM (VALUES ('triage'), ('qc'), ('ingest'), ('ocr'), ('audit'), ('parse'), ('catalog'), ('deploy'), ('live'), ('stuck')) k(bucket) LEFT JOIN x ON x.bucket = k.bucket GROUP BY k.bucket
""")
def depth_histogram(spark, d):
    rows = _staged(spark, d).withColumn("bucket", P.depth(F.col("stage"), F.lit("-"), F.col("c_custkey") % 6 == 0))
    return P.histogram(rows, "bucket", P.DEPTHS, F.col("c_custkey") % 10 < 3).select("bucket", "total", "held")


RULES = "(0, '3', 'error', 'hold'), (1, '*', 'click', 'allow'), (2, '5', '*', 'allow'), (3, '*', 'signup', 'hold'), (4, '7', 'purchase', 'allow')"


@query(f"""
    WITH r AS (SELECT * FROM (VALUES {RULES}) r(rule_idx, slug, stage, action)), e AS (SELECT event_id, CASE WHEN user_id % 4 > 0 THEN CAST(user_id AS VARCHAR) END AS slug, event_type FROM events)
    SELECT event_id, coalesce(arg_min(action, rule_idx), 'hold') = 'allow' AS allowed FROM e LEFT JOIN r ON (r.slug = '*' OR r.slug = e.slug) AND (r.stage = '*' OR r.stage = e.event_type) GROUP BY event_id
""")
def first_match_gates(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 > 0, F.col("user_id").cast("string")).alias("slug"), "event_type")
    return P.gates(e, spark.sql(f"SELECT * FROM VALUES {RULES} AS r(rule_idx, slug, stage, action)"), "slug", "event_type").select("event_id", "allowed")


@query("SELECT user_id, epoch_us(min(ts)) AS first_us FROM events GROUP BY user_id")
def first_seen(spark, d):
    return P.first_seen(read(spark, d, "events"), ["user_id"], "ts").select("user_id", F.unix_micros("first_seen").alias("first_us"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def stage_timeline(spark, d):
    return P.timeline(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
    WITH u AS (SELECT user_id, date_trunc('second', min(ts)) AS entered, date_trunc('second', min(ts) FILTER (event_type = 'purchase' AND value > 25)) AS deployed, max(CASE WHEN event_type = 'error' AND value > 60 THEN 'x' END) AS stuck FROM events GROUP BY 1)
    SELECT CASE WHEN deployed IS NOT NULL THEN 'deployed' WHEN stuck IS NOT NULL THEN 'stuck' ELSE 'inflight' END AS bucket, count(*) AS n, round(avg(CASE WHEN deployed IS NOT NULL THEN epoch(deployed) - epoch(entered) END), 3) AS lead_s FROM u WHERE entered >= TIMESTAMP '2024-01-01 00:30:00' GROUP BY 1
""")
def cohort_funnel(spark, d):
    e = read(spark, d, "events")
    u = e.groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).alias("entered"), F.date_trunc("second", F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") > 25), F.col("ts")))).alias("deployed"), F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 60), "x")).alias("stuck"))
    return P.funnel(u, F.lit("2024-01-01 00:30:00").cast("timestamp"), "entered", "deployed", "stuck")


@query("""
    WITH f AS (SELECT *, CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200 THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS duration_s FROM s GROUP BY 1, 2
""")
def session_index(spark, d):
    return P.session_index(read(spark, d, "events"), "user_id", "ts", 7200).select("user_id", "session", "events", "duration_s")


@query("""
    SELECT user_id AS session, count(*) AS events, count(*) FILTER (event_type = 'click') AS total_calls FROM events WHERE user_id % 3 <> 0 GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-29 22:00:00'
""")
def session_rebuild(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("user_id").alias("session"), F.date_trunc("second", "ts").alias("t"), F.when(F.col("event_type") == "click", "tool").otherwise("text").alias("kind"))
    index = e.where("user_id % 3 = 0").select(F.col("user_id").alias("session")).distinct()
    return P.session_rebuild(index, log, F.lit("2024-01-29 23:00:00").cast("timestamp"), 3600).select("session", "events", "total_calls")


@query("SELECT user_id, count(*) AS sessions, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS unknown, CAST(sum(CASE WHEN value > 10 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS seconds FROM events GROUP BY user_id")
def tri_state_outcomes(spark, d):
    t = F.col("event_type")
    ok = F.when(t == "error", False).when(t != "signup", True)
    return P.outcomes(read(spark, d, "events"), "user_id", ok, F.when(F.col("value") > 10, F.floor("value")))


@query("""
    WITH l AS (SELECT event_id, user_id, CASE WHEN event_type IN ('click', 'view') THEN event_id * 10 END AS told FROM events)
    SELECT event_id, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS effective FROM l
""")
def carried_timestamps(spark, d):
    lines = read(spark, d, "events").withColumn("at", F.when(F.col("event_type").isin("click", "view"), F.col("event_id") * 10))
    return P.carried_time(lines, ["user_id"], "event_id", "at").select("event_id", "effective")


@query("""
    WITH n AS (SELECT event_type AS provider, count(*) AS workers, count(*) FILTER (value > 12) AS failures FROM events GROUP BY 1)
    SELECT k.provider, coalesce(workers, 0) AS workers, coalesce(failures, 0) AS failures, CASE WHEN coalesce(workers, 0) = 0 THEN 'idle' WHEN failures * 2 > workers THEN 'degraded' ELSE 'fallback' END AS status
    FROM (VALUES ('absent'), ('click'), ('error'), ('view')) k(provider) LEFT JOIN n ON n.provider = k.provider
""")
def provider_health(spark, d):
    w = read(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("value") > 12).alias("failed"))
    return P.provider_health(w, ["absent", "click", "error", "view"]).select("provider", "workers", "failures", "status")


@query("""
    WITH s AS (SELECT s_suppkey AS account, unnest(generate_series(1, s_suppkey % 4)) AS slot FROM supplier WHERE s_suppkey % 4 > 0), k AS (SELECT *, row_number() OVER (ORDER BY account, slot) AS k FROM s), p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer)
    SELECT c_custkey, account, slot FROM p JOIN k USING (k)
""")
def quota_slots(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), (F.col("s_suppkey") % 4).alias("remaining"))
    p = read(spark, d, "customer").withColumn("o", -F.col("c_acctbal"))
    return P.quota_slots(a, p, ["o", "c_custkey"], F.floor(F.col("o") / 100)).select("c_custkey", "account", F.col("slot").cast("long").alias("slot"))


@query("SELECT o_orderpriority AS domain, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS actionable, count(*) FILTER (o_orderstatus = 'P') AS parked, count(*) FILTER (o_orderstatus = 'F') AS terminal, grouping(o_orderpriority) = 1 AS is_total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def frontier_buckets(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "P", "parked").otherwise("resolved")
    return P.frontier(read(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), s.alias("status")))


@query("""
    WITH c AS (SELECT o_orderpriority AS domain, o_orderdate AS at, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o.o_orderkey AS id, CAST(sum(c.n) AS BIGINT) AS commits FROM orders o JOIN c ON c.domain = o.o_orderpriority AND c.at > o.o_orderdate WHERE o.o_orderstatus <> 'F' GROUP BY 1
""")
def stale_items_whole(spark, d):
    """Every order as a proposal and as a commit."""
    s = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "P", "parked").otherwise("resolved")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), s.alias("status"), F.col("o_orderdate").alias("at"))
    return P.stale(o.withColumnRenamed("at", "verified_at"), o.select("domain", F.col("at").alias("committed_at")))


@query("SELECT user_id, count(*) AS touched, count(*) FILTER (value / 60 >= 0.02) AS started, count(*) FILTER (value / 60 >= 0.9) AS read, max(event_id) AS last_at FROM events GROUP BY user_id")
def reading_stats(spark, d):
    return P.reading_stats(read(spark, d, "events").withColumn("ratio", F.col("value") / 60), "user_id", "ratio", "event_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE value / 60 >= 0.02 GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 4")
def recent_items(spark, d):
    e = read(spark, d, "events").withColumn("ratio", F.col("value") / 60).withColumn("at", F.col("event_id"))
    return P.recent(e, "user_id", "event_id", "ratio", "at").select("user_id", "event_id")


@query("SELECT coalesce(b.k, a.k) AS path, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 5 > 0) b FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS v FROM part WHERE p_partkey % 7 > 0) a ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def file_changes(spark, d):
    p = read(spark, d, "part")
    b = p.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("sha"))
    a = p.where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 3 == 0, "new").otherwise(F.col("p_name")).alias("sha"))
    return P.file_changes(b, a)


@query("SELECT count(*) AS in_flight, count(*) FILTER (NOT u) AS harvestable, count(*) FILTER (NOT u OR ts > TIMESTAMP '2024-01-29 22:00:00') AS occupied FROM (SELECT *, event_type IN ('click', 'view') AS u, date_trunc('second', ts) AS ts FROM (SELECT event_type, ts FROM events)) q")
def upload_capacity(spark, d):
    m = read(spark, d, "events").select(F.col("event_type").isin("click", "view").alias("uploading"), F.col("ts").alias("submitted_at"))
    return P.capacity(m, F.lit("2024-01-29 23:00:00").cast("timestamp"), 3600)


@query("SELECT CAST(date_part('day', ts) AS BIGINT) AS day, event_type AS account, count(DISTINCT user_id) * 7 AS pages FROM events GROUP BY 1, 2")
def usage_daily(spark, d):
    e = read(spark, d, "events").select(F.dayofmonth("ts").cast("long").alias("day"), F.col("event_type").alias("account"), F.col("user_id").alias("slug"), F.lit(7).alias("pages"))
    return P.usage(e)


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN 'drop' WHEN p_size <= 20 THEN 'keep' WHEN p_size % 2 = 0 THEN 'terminate' WHEN p_size > 30 THEN 'kill' ELSE 'wait' END AS verdict FROM part")
def lease_verdicts(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", P.lease_verdict(s % 7 != 0, s % 11 != 0, s, F.lit(20), F.lit(10), s % 2 != 0).alias("verdict"))


@query("""
    WITH k AS (SELECT o_orderkey, o_orderpriority AS slug, o_orderdate AS started FROM orders), f AS (SELECT slug AS "of", o_orderkey, started FROM k UNION SELECT 'x' || CAST(o_orderkey % 5 AS VARCHAR), o_orderkey, started FROM k WHERE o_orderkey % 5 > 0)
    SELECT "of", o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY "of" ORDER BY started DESC, o_orderkey) AS n FROM f) WHERE n <= 6
""")
def sessions_by_slug(spark, d):
    k = F.col("o_orderkey")
    s = read(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("slug"), F.col("o_orderdate").alias("started"), F.when(k % 5 > 0, F.array(F.concat(F.lit("x"), (k % 5).cast("string")))).alias("touched"))
    return P.sessions_of(s, 6).select("of", "id")
