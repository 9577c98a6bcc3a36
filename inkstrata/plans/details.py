"""Scalar rules, repairs and reports over the driver tables, and goldens where the tables have no such text."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstrata.functions import mathx as M
from inkstrata.functions import numbers as N
from inkstrata.functions import text as T
from inkstrata.functions import titles as TT
from inkstrata.functions import web
from inkstrata.operators import catalogs as C
from inkstrata.operators import overlay as O
from inkstrata.operators import repair as Q
from inkstrata.operators import reports as R
from inkstrata.operators import residual as X
from inkstrata.operators import segment as G
from inkstrata.operators import state as P
from inkstrata.operators import universe as U
from inkstrata.plans.registry import query
from inkstrata.sources import changed, read, replace_field


def _rows(spark, values: str, names: str):
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({names})")


@query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages")
def plain_page_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.length(T.plain_text(F.col("html"))).cast("long").alias("n"))


@query("SELECT page_id, length(text) AS n_chars, left(trim(text), 180) AS cut FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages)".replace("\\\\", "\\"))
def context_snippets(spark, d):
    p = read(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("n_chars"), T.snippet_cut(F.col("text")).alias("cut"))


@query(r"""
    SELECT doc_id, len(list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS terms FROM documents
""")
def query_terms_whole(spark, d):
    """Terms of the whole text."""
    return read(spark, d, "documents").select("doc_id", F.size(T.query_terms(T.fold(F.col("text")))).cast("long").alias("terms"))


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS lead, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) END AS dashed FROM orders")
def number_prefixes(spark, d):
    k = F.concat_ws(".", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    raw = F.when(F.col("o_custkey") % 2 == 0, k).otherwise(F.replace(k, F.lit("."), F.lit("-")))
    return read(spark, d, "orders").select("o_orderkey", N.leading_int(raw).cast("long").alias("lead"), N.dashed(raw).alias("dashed"))


@query("""
    SELECT p_partkey, CASE WHEN p_retailprice * 20 < 90 THEN 's' WHEN p_retailprice * 20 < 5400 THEN CAST(CAST(round(p_retailprice * 20 / 60) AS BIGINT) AS VARCHAR) || 'm' ELSE CAST(round(p_retailprice * 20 / 3600, 1) AS VARCHAR) || 'h' END AS span,
      CASE WHEN p_size < 1 THEN 1 WHEN p_size > 10 THEN 10 ELSE p_size END AS step, lower(replace(p_name, ' ', '-')) AS slug FROM part
""")
def scalar_formats(spark, d):
    return read(spark, d, "part").select("p_partkey", N.span_text(F.col("p_retailprice") * 20).alias("span"), N.clamp_step(F.col("p_size"), 5).alias("step"), N.slugify(F.col("p_name")).alias("slug"))


@query("""
    SELECT p_partkey, concat_ws(',', CASE WHEN p_type NOT IN ('SMALL', 'PROMO') THEN 'subject_unknown' END, CASE WHEN p_size % 3 = 0 THEN 'edition_pattern' END, CASE WHEN p_partkey % 5 = 0 THEN 'author_comma' END) AS faults FROM part
""")
def metadata_faults(spark, d):
    p = read(spark, d, "part")
    ed = F.when(F.col("p_size") % 3 == 0, "four").otherwise("4th")
    who = F.when(F.col("p_partkey") % 5 == 0, "A, B").otherwise("A; B")
    return p.select("p_partkey", F.array_join(TT.metadata_faults(F.col("p_type"), ["SMALL", "PROMO"], ed, who), ",").alias("faults"))


@query("SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'owned' WHEN 1 THEN 'available' WHEN 2 THEN 'absent' ELSE 'pending' END AS public, CASE c_nationkey % 5 WHEN 0 THEN 'owned' WHEN 2 THEN 'absent' ELSE 'pending' END AS shelf FROM customer")
def public_states(spark, d):
    k = F.col("c_nationkey") % 5
    s = F.when(k == 0, "owned").when(k == 1, "qualified").when(k == 2, "rejected").when(k == 3, "pending").otherwise("candidate")
    c = read(spark, d, "customer").withColumn("public", U.public_state(s))
    return c.select("c_custkey", "public", web.shelf(F.col("public")).alias("shelf"))


@query("""
    WITH m AS (SELECT l_suppkey, avg(l_quantity * 20) AS chars, avg(l_discount * 10) AS cover, round(median(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 200 END)) AS dpi, avg(CASE WHEN l_quantity * 20 < 10 AND l_discount * 10 < 0.05 THEN 1 ELSE 0 END) AS blank FROM lineitem GROUP BY 1),
    t AS (SELECT *, CASE WHEN chars < 30 AND cover > 0.85 THEN 'scanned_image' WHEN chars >= 100 AND cover > 0.85 THEN 'ocr_sandwich' WHEN chars >= 600 AND cover < 0.6 THEN 'born_digital' ELSE 'hybrid' END AS type FROM m),
    q AS (SELECT *, CASE WHEN type IN ('scanned_image', 'ocr_sandwich') THEN CASE WHEN dpi IS NULL THEN 'marginal' WHEN dpi < 150 THEN 'bad' WHEN dpi < 250 THEN 'marginal' ELSE 'good' END ELSE 'good' END AS q0 FROM t),
    r AS (SELECT *, CASE WHEN blank > 0.25 AND q0 = 'good' THEN 'bad' ELSE q0 END AS quality FROM q)
    SELECT l_suppkey AS path, type, quality, CASE WHEN quality = 'good' AND (type = 'born_digital' OR (type = 'hybrid' AND chars > 300)) THEN 'proceed' ELSE 'review' END AS verdict FROM r
""")
def page_triage(spark, d):
    pages = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_quantity") * 20).alias("chars"), (F.col("l_discount") * 10).alias("cover"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 200).alias("dpi"))
    return U.triage(pages)


@query("SELECT DISTINCT CAST(o_custkey * 2 AS VARCHAR) || '_sol' AS slug FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def orphan_solutions(spark, d):
    """Customers are works; each order brings the solutions of the work with twice its customer's number, if there is one."""
    works = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"))
    solutions = read(spark, d, "orders").select(F.concat((F.col("o_custkey") * 2).cast("string"), F.lit("_sol")).alias("slug")).distinct()
    return U.orphans(works.union(solutions)).select("slug")


@query("SELECT count(*) FILTER (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND NOT (o_orderdate > TIMESTAMP '2001-01-01' - INTERVAL 90 DAY))) AS remaining FROM orders")
def work_remaining(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "candidate").when(F.col("o_orderstatus") == "P", "pending").otherwise("owned")
    w = read(spark, d, "orders").select(s.alias("state"), F.col("o_orderdate").alias("checked_at"))
    return U.work_remaining(w, F.lit("2001-01-01 00:00:00").cast("timestamp"), 90)


def _expanded(docs):
    b = docs.select("doc_id", F.lit("list").alias("type"), F.lit("").alias("text"), F.split("text", "\n").alias("list_items"), F.lit(1).alias("text_level"))
    return G.expand_lists(b, ["doc_id"]).select("doc_id", F.col("item").cast("long").alias("item"), "text")


@query("""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents), b AS (SELECT doc_id, CASE WHEN len(items) > 0 THEN items ELSE [''] END AS items FROM l)
    SELECT doc_id, k - 1 AS item, items[k] AS text FROM (SELECT doc_id, items, unnest(generate_series(1, len(items))) AS k FROM b)
""")
def expanded_lists_whole(spark, d):
    """Every document; one without items stays one block."""
    return _expanded(read(spark, d, "documents"))


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'section' ELSE 'subsection' END AS t, CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || CASE WHEN turn % 2 = 0 THEN '' ELSE '.1' END AS id, role AS title FROM conversations WHERE turn < 4
""")
def detected_headings(spark, d):
    c = read(spark, d, "conversations")
    s = F.concat(F.col("conv_id").cast("string"), F.lit(" ."), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, "").otherwise(".1"), F.lit("  "), F.col("role"))
    h = G.heading(s, F.when(F.col("turn") < 4, 1).otherwise(3), [1, 2], r"^(\d+\s*\.\d+)\s+(.*)$", r"^(\d+\s*\.\d+\.\d+)\s+(.*)$")
    return c.withColumn("h", h).where("h is not null").select("conv_id", "turn", "h.t", "h.id", "h.title")


@query("SELECT conv_id, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 99) AS stop FROM conversations WHERE role = 'user'")
def chapter_ranges(spark, d):
    s = read(spark, d, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("start"), F.lit(99).cast("long").alias("n_blocks"))
    return G.chapter_ranges(s, ["conv_id"]).select("conv_id", "start", "stop")


@query("SELECT conv_id, arg_max(lvl, n * 100 - lvl) AS level FROM (SELECT conv_id, turn % 3 + 1 AS lvl, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1, 2) GROUP BY conv_id")
def heading_level_mode(spark, d):
    c = read(spark, d, "conversations").withColumnRenamed("text", "said").withColumn("text", F.col("role")).withColumn("text_level", F.col("turn") % 3 + 1)
    return G.level_mode(c, ["conv_id"], "^(user|assistant)$")


@query("SELECT role AS type, count(*) AS n, false AS noise FROM conversations GROUP BY role")
def block_type_shares(spark, d):
    c = read(spark, d, "conversations").withColumn("all", F.lit(1)).withColumnRenamed("role", "type")
    return G.type_shares(c, ["all"], 1).select("type", "n", "noise")


@query("SELECT doc_id % 20 AS book, doc_id, sample FROM (SELECT doc_id, regexp_extract(text, '[0-9]{2,}', 0) AS sample, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS n FROM documents WHERE regexp_matches(text, '[0-9]{2,}')) WHERE n <= 5")
def pattern_samples(spark, d):
    docs = read(spark, d, "documents").withColumn("book", F.col("doc_id") % 20)
    return G.samples(docs, ["book"], "doc_id", "[0-9]{2,}", 5)


@query("SELECT l_orderkey AS slug, l_linenumber AS chunk_key, l_partkey AS anchor FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1, 2, 3 HAVING count(*) = 1")
def missing_anchor_entries(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("chunk_key"), F.col("l_partkey").alias("anchor"))
    once = rows.groupBy("slug", "chunk_key", "anchor").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return C.missing_anchors(once, rows.select("slug", "chunk_key", F.when(F.col("anchor") % 3 == 0, F.col("anchor")).alias("id")))


@query("SELECT p_partkey, CASE WHEN instr(p_name, 'r') = 0 THEN p_name WHEN p_size % 2 = 0 THEN replace(p_name, 'r', 'RR') ELSE left(p_name, instr(p_name, 'r') - 1) || 'RR' || substr(p_name, instr(p_name, 'r') + 1) END AS text FROM part")
def replaced_text(spark, d):
    return read(spark, d, "part").select("p_partkey", O.replace_text(F.col("p_name"), F.lit("r"), F.lit("RR"), F.col("p_size") % 2 == 0).alias("text"))


@query("SELECT o_orderkey, greatest(o_totalprice, coalesce(CASE WHEN o_custkey % 2 = 0 THEN 100000.0 END, 0)) AS ratio, o_custkey % 3 = 1 AS blocked FROM orders")
def progress_and_gates(spark, d):
    k = F.col("o_custkey")
    aligned = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return read(spark, d, "orders").select("o_orderkey", O.monotone_progress(F.col("o_totalprice"), F.when(k % 2 == 0, 100000.0)).alias("ratio"), O.merge_gate(aligned).alias("blocked"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'over ' || CAST(s_suppkey AS VARCHAR) ELSE s_name END AS s_name FROM supplier")
def overlaid_titles(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name")
    return O.overlay_titles(s, s.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("over "), F.col("s_suppkey").cast("string")).alias("s_name")), ["s_suppkey"], "s_name")


def _judged(rows):
    f = X.formulas(rows, "locator")
    v = f.select("tex", "display", (F.length("tex") % 2 == 1).alias("ok"), F.when(F.length("tex") % 2 == 0, "Missing } inserted").alias("err"))
    return X.judged(f, v).select("tex", "occ", "category")


@query("""
    WITH r AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tex FROM documents), f AS (SELECT tex, count(*) AS occ FROM r GROUP BY tex)
    SELECT tex, occ, CASE WHEN length(tex) % 2 = 0 THEN 'missing_brace' END AS category FROM f
""")
def judged_formulas_whole(spark, d):
    """Every word of every text."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return _judged(read(spark, d, "documents").select(words.alias("tex"), F.lit(False).alias("display"), F.col("doc_id").cast("string").alias("locator")))


@query("""
    SELECT source AS slug, sum(1) AS spans_total, count(*) AS unique_n, count(*) FILTER (n_chars % 3 = 0) AS bad_unique, CAST(sum(CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_occ FROM documents GROUP BY source
""".replace("sum(1) AS", "CAST(sum(1) AS BIGINT) AS"))
def book_reports(spark, d):
    rows = read(spark, d, "documents").select(F.col("source").alias("slug"), F.lit(1).alias("occ"), (F.col("n_chars") % 3 != 0).alias("ok"))
    return X.book_report(rows)


@query(r"""
    SELECT doc_id, 'delimiter' AS kind FROM (SELECT doc_id, len(regexp_extract_all(text, '\$\$')) AS dd, length(regexp_replace(regexp_replace(text, '\${2,}', '', 'g'), '[^$]', '', 'g')) AS one FROM documents) WHERE dd % 2 = 1 OR one % 2 = 1
""")
def math_audit_findings(spark, d):
    return X.math_audit(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query("""
    WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '2 parse' WHEN 1 THEN '1 audit' WHEN 2 THEN 'R audit-blocked' WHEN 3 THEN '3 parsed' WHEN 4 THEN '0.5 ocr' ELSE 'X missing' END AS stage FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'qc-reject: n' || CAST(c_custkey AS VARCHAR) WHEN starts_with(stage, 'X') THEN stage END AS reason FROM r
""")
def stuck_reasons(spark, d):
    k = F.col("c_custkey")
    stage = F.when(k % 6 == 0, "2 parse").when(k % 6 == 1, "1 audit").when(k % 6 == 2, "R audit-blocked").when(k % 6 == 3, "3 parsed").when(k % 6 == 4, "0.5 ocr").otherwise("X missing")
    none = F.lit(None).cast("string")
    return read(spark, d, "customer").select("c_custkey", P.stuck_reason(F.when(k % 11 == 0, "reject"), F.concat(F.lit("n"), k.cast("string")), none, none, stage).alias("reason"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'audit' WHEN c_custkey % 4 = 1 THEN 'parse' ELSE coalesce(nullif(concat_ws(' ', CASE WHEN c_nationkey > 12 THEN 'catalog_audit(' || CAST(c_nationkey AS VARCHAR) || ')' END, CASE WHEN c_acctbal < 0 THEN 'sol_ingest' END, CASE WHEN c_custkey % 3 > 0 THEN 'translate(optional)' END), ''), '-') END AS todo FROM customer
""")
def todo_lists(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    stage = F.when(k % 4 == 0, "1 audit").when(k % 4 == 1, "2 parse").otherwise("3 parsed")
    t = P.todo(stage, F.when(n > 12, n).otherwise(0), F.lit(False), F.col("c_acctbal") < 0, F.lit(0), F.lit(False), F.lit(False), k % 3 == 0)
    return read(spark, d, "customer").select("c_custkey", t.alias("todo"))


@query("SELECT c_custkey AS slug FROM customer WHERE c_custkey % 3 <> 0 AND c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def collectable_books(spark, d):
    b = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), (F.col("c_custkey") % 3 != 0).alias("deployed"), F.when(F.col("c_acctbal") > 0, "2024-01-01 00:00:00").otherwise("2024-03-01 00:00:00").cast("timestamp").alias("deployed_at"))
    busy = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.col("o_custkey").cast("string"), F.lit("_sol")).alias("slug"))
    return P.collectable(b, busy, F.lit("2024-03-02 00:00:00").cast("timestamp"), 30).select(F.col("slug").cast("long").alias("slug"))


@query("SELECT event_id, CASE WHEN value <= 10 THEN NULL WHEN event_type <> 'error' AND value / 2 <= 10 THEN 'lagging' ELSE 'stopped' END AS message, coalesce(CASE WHEN user_id % 2 = 0 THEN 'env' END, CASE WHEN user_id % 3 = 0 THEN 'stage' END, 'default') AS model FROM events")
def staleness_messages(spark, d):
    u = F.col("user_id")
    return read(spark, d, "events").select("event_id", P.staleness(F.col("value"), F.when(F.col("event_type") != "error", F.col("value") / 2), 10).alias("message"), P.resolved_config(F.when(u % 2 == 0, "env"), F.when(u % 3 == 0, "stage"), F.lit("default")).alias("model"))


@query("SELECT user_id, event_id, event_type FROM events WHERE user_id % 2 = 0 UNION ALL SELECT user_id, -1, 'seed' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 1)")
def seeded_timelines(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    seeds = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("seed").alias("event_type"))
    return P.seeded(e.where("user_id % 2 = 0"), seeds, ["user_id"])


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'downloading' WHEN user_id % 3 = 0 THEN 'idle' WHEN event_type = 'error' THEN 'quota_empty' WHEN value > 30 THEN 'holding' ELSE 'draining' END AS state FROM events")
def crawl_states(spark, d):
    u = F.col("user_id")
    return read(spark, d, "events").select("event_id", R.crawl_state(u % 3, F.when(F.col("event_type") == "error", 0).otherwise(1), F.when(F.col("value") > 30, 0).otherwise(1), u % 5 == 0).alias("state"))


@query("""
    SELECT user_id % 7 AS slug, count(*) AS chapters, CAST(sum(event_id % 9) AS BIGINT) AS blocks, CAST(sum(event_id % 4) AS BIGINT) AS problems FROM events GROUP BY 1
""")
def scorecards(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 7).alias("slug"), (F.col("event_id") % 9).alias("body_count"), (F.col("event_id") % 4).alias("problem_count"))
    none = e.select("slug").distinct()
    return R.scorecard(e, none.limit(0), none.withColumn("residual", F.lit(None).cast("long")), none.withColumn("flags", F.lit(""))).select("slug", "chapters", "blocks", "problems")


@query("SELECT p_partkey, CASE WHEN a = 0 AND p_size > 25 THEN 'unnumbered' WHEN a = 0 THEN 'no_anchor' WHEN p_size >= 3 AND a < greatest(2, floor(p_size / 2)) THEN 'partial' ELSE 'feasible' END AS verdict FROM (SELECT *, p_partkey % 9 AS a FROM part)")
def anchor_verdicts(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", R.anchor_verdict(F.col("p_partkey") % 9, F.when(s > 25, 1).otherwise(0), s).alias("verdict"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'fresh' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def merged_records(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", "c_name", F.when(k % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    fresh = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("fresh"), k.cast("string")).alias("c_name"), F.when(k % 3 == 0, "new").alias("c_mktsegment"))
    return R.merge_upsert(c, fresh, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("SELECT c_custkey AS slug, CASE WHEN c_custkey % 4 = 0 THEN 'skip' WHEN c_custkey % 3 = 0 THEN 'register' ELSE 'unresolved' END AS action FROM customer")
def unregistered_files(spark, d):
    f = read(spark, d, "customer").select(F.col("c_custkey").alias("slug"))
    return R.unregistered(f, f.where("slug % 3 = 0"), f.where("slug % 4 = 0"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' v2' ELSE p_name END AS p_name FROM part")
def point_updates(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    return replace_field(p, p.where("p_partkey % 5 = 0").select("p_partkey", F.concat("p_name", F.lit(" v2")).alias("new")), ["p_partkey"], "p_name")


@query("SELECT p_partkey AS path FROM part WHERE p_partkey % 4 = 0")
def changed_files(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("modified"), F.col("p_retailprice").alias("size"))
    return changed(p, p.withColumn("modified", F.when(F.col("path") % 4 == 0, -1).otherwise(F.col("modified")))).select("path")


@query("SELECT user_id, array_to_string(list(event_id ORDER BY ts DESC, event_id)[1:3], ',') AS newest FROM events GROUP BY user_id")
def newest_per_key(spark, d):
    e = read(spark, d, "events")
    rows = R.first_wins(e.withColumn("k", F.floor(F.col("event_id") / 1)), ["event_id"], ["ts"])
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.unix_micros("ts")).alias("t"), "event_id"))), 1, 3)
    return rows.groupBy("user_id").agg(top.alias("s")).select("user_id", F.array_join(F.transform("s", lambda x: x["event_id"].cast("string")), ",").alias("newest"))
