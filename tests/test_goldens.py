"""Goldens: hand-written rows with hand-written answers, run like the registered queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import mathx as M
from inkstrata.functions import numbers as N
from inkstrata.functions import titles as T
from inkstrata.functions import titles as TT
from inkstrata.functions import web
from inkstrata.operators import catalogs as C
from inkstrata.operators import overlay as O
from inkstrata.operators import repair as Q
from inkstrata.operators import residual as R
from inkstrata.operators import residual as X
from inkstrata.operators import search as S
from inkstrata.operators import segment as G
from inkstrata.operators import universe as U
from oracle import compare, connect

GOLDENS = {}


def query(sql):
    def add(f):
        GOLDENS[f.__name__] = (f, sql.strip())
        return f

    return add


def _rows(spark, values: str, names: str):
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({names})")


CAPTIONS = "(1, 'Fig. 1.4 Load and source'), (2, 'FIGURE 2-10b: Curves'), (3, 'Table 3.1 Values; see Fig. 1.2'), (4, 'Tab. 4–2 Sizes'), (5, 'no label here'), (6, 'as in Figure 9.9'), (7, '')"
LONG_CAPTIONS = CAPTIONS.replace("(1,", "(1L,").replace("(2,", "(2L,").replace("(3,", "(3L,").replace("(4,", "(4L,").replace("(5,", "(5L,").replace("(6,", "(6L,").replace("(7,", "(7L,")
NUM = "[A-Z]?[0-9]+[A-Z]?(?:[.\\-–—][0-9]+)+[A-Za-z]?"
TEX = [r"a^{x}^{y}", r"\frac{p}{q} + \left( r", r"\alpha_{1}", r"", r"x \\", r"\underline{{\left/ 30 \left. \right.}}"]
FINDINGS = r"""('b1', 'a^{x}^{y}', 3, 'Double superscript'), ('b2', 'p^{m}^{n}', 2, 'double exponent'), ('b1', '\\foo{x}', 4, 'Undefined control sequence \\foo'), ('b3', '\\foo + \\bar', 1, 'Undefined control sequence \\foo'), ('b2', '\\left( x', 5, 'Missing \\right')"""


def _findings(spark):
    rows = spark.sql(f"SELECT * FROM VALUES {FINDINGS} AS v(slug, tex, occ, err)")
    return rows.withColumn("category", M.category(F.col("err"))).withColumn("macro", M.macro(F.col("err")))


@query(f"""
    SELECT CAST(id AS BIGINT) AS id,
      CASE WHEN regexp_matches(s, '(?i)\\bFig(?:ure|\\.)?\\s*({NUM})') THEN 'fig-' || regexp_replace(regexp_extract(s, '(?i)\\bFig(?:ure|\\.)?\\s*({NUM})', 1), '[\\-–—]', '.', 'g') END AS fig,
      CASE WHEN regexp_matches(s, '(?i)\\b(?:Table|Tab\\.?)\\s*({NUM})') THEN 'tbl-' || regexp_replace(regexp_extract(s, '(?i)\\b(?:Table|Tab\\.?)\\s*({NUM})', 1), '[\\-–—]', '.', 'g') END AS tbl
    FROM (VALUES {CAPTIONS}) v(id, s)
""")
def caption_ids(spark, d):
    rows = spark.sql(f"SELECT * FROM VALUES {LONG_CAPTIONS} AS v(id, s)")
    return rows.select("id", N.figure_id(F.col("s")).alias("fig"), N.table_id(F.col("s")).alias("tbl"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'figure', '1.4', 'Figure 1.4: Load and source'), (2, 'figure', '2.10b', 'Figure 2.10b: Curves'), (3, 'table', '3.1', 'Table 3.1: Values; see'), (3, 'figure', '1.2', 'Figure 1.2'), (4, 'table', '4.2', 'Table 4.2: Sizes')) v(id, type, num, display)")
def caption_labels(spark, d):
    rows = spark.sql(f"SELECT * FROM VALUES {LONG_CAPTIONS} AS v(id, s)")
    return rows.select("id", F.inline(N.caption_labels(F.col("s")))).select("id", "type", "num", "display")


@query(f"""
    WITH t AS (SELECT * FROM (VALUES (1, 'see Fig. 1.4 and Figure 2.3b, Table 1.1'), (2, 'Figure 1.4 again; figures 7'), (3, 'Table 1.1 Table 1–2')) v(id, s)),
    r AS (SELECT id, 'figure' AS kind, unnest(regexp_extract_all(s, '(?i)\\b(?:Fig\\.?|Figure)\\s+({NUM})', 1)) AS ref FROM t UNION ALL SELECT id, 'table', unnest(regexp_extract_all(s, '(?i)\\b(?:Tab\\.?|Table)\\s+({NUM})', 1)) FROM t)
    SELECT kind, regexp_replace(ref, '[\\-–—]', '.', 'g') AS ref, CAST(min(id) AS BIGINT) AS first_id, count(*) AS total FROM r GROUP BY 1, 2
""")
def ref_extract(spark, d):
    t = spark.sql("SELECT 'b' AS slug, * FROM VALUES (1L, 'see Fig. 1.4 and Figure 2.3b, Table 1.1'), (2L, 'Figure 1.4 again; figures 7'), (3L, 'Table 1.1 Table 1–2') AS v(id, text)")
    found = C.text_references(t, ["slug"], "id")
    return found.groupBy("kind", "ref").agg(F.min("id").alias("first_id"), F.max("total").alias("total"))


@query("SELECT * FROM (VALUES ('body[7]', 'body', NULL, CAST(0 AS BIGINT), CAST(7 AS BIGINT)), ('problem:3.2:body[1]', 'problem.body', '3.2', 0, 1), ('problem:5#2:solution[0]', 'problem.solution', '5', 2, 0), ('junk', NULL, NULL, NULL, NULL)) v(path, section, num, occ, idx)")
def selectors(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('body[7]'), ('problem:3.2:body[1]'), ('problem:5#2:solution[0]'), ('junk') AS v(path)").withColumn("s", C.selector(F.col("path")))
    return rows.select("path", "s.section", "s.num", F.col("s.occ").cast("long").alias("occ"), F.col("s.idx").cast("long").alias("idx"))


@query("SELECT * FROM (VALUES ('ch03:body[7]', 'ch03', 'body[7]'), ('ch03:problem[5].solution[1]', 'ch03', 'problem:5:solution[1]'), ('appA:title', 'appA', 'title')) v(locator, chunk, selector)")
def locator_targets(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('ch03:body[7]'), ('ch03:problem[5].solution[1]'), ('appA:title') AS v(locator)").withColumn("t", C.target_of(F.col("locator")))
    return rows.select("locator", "t.chunk", "t.selector")


@query("SELECT * FROM (VALUES ('1.2b', CAST(10 AS BIGINT), 'x.png'), ('2.1', 20, 'y.png'), ('9.9', NULL, NULL)) v(ref, pos, src)")
def caption_candidates(spark, d):
    wanted = spark.sql("SELECT 's' AS slug, 'figure' AS kind, * FROM VALUES ('1.2b'), ('2.1'), ('9.9') AS v(ref)")
    found = spark.sql("SELECT 's' AS slug, 'figure' AS kind, * FROM VALUES ('1.2', 10L, 'x.png'), ('2.1', 20L, 'y.png'), ('2.1', 30L, 'z.png') AS v(num, pos, src)")
    return C.caption_candidates(found, wanted, ["slug"]).select("ref", "pos", "src")


@query(r"SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'x = 1', '3.2'), (1, 'y', NULL), (2, 'a $ b', NULL), (3, '\alpha', '1.4a')) v(id, tex, label)")
def equation_labels(spark, d):
    raw = ["$$\nx = 1 \\tag{3.2}\n$$", "$$ y $$", "a $ b", "\\alpha \\tag*{1.4a}"]
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in raw])).alias("id", "raw")).withColumn("t", N.strip_display(F.col("raw")))
    return rows.select(F.col("id").cast("long").alias("id"), N.without_label(F.col("t")).alias("tex"), N.equation_label(F.col("t")).alias("label"))


@query("SELECT * FROM (VALUES ('John David Jackson', 'jackson'), ('Goldstein, Poole & Safko', 'goldstein'), ('van der Berg', 'berg'), ('', '')) v(author, surname)")
def surnames(spark, d):
    return _rows(spark, "('John David Jackson'), ('Goldstein, Poole & Safko'), ('van der Berg'), ('')", "author").select("author", TT.surname(F.col("author")).alias("surname"))


@query("SELECT * FROM (VALUES ('Real Analysis: Modern', 'real analysis', false, NULL), ('Optics (4th)', 'optics', false, NULL), ('Solutions Manual to Optics', 'solutions manual to optics', true, 'companion'), ('Optics Study Guide', 'optics study guide', false, 'companion')) v(title, normal, solution, companion)")
def title_kinds(spark, d):
    t = _rows(spark, "('Real Analysis: Modern'), ('Optics (4th)'), ('Solutions Manual to Optics'), ('Optics Study Guide')", "title")
    return t.select("title", TT.normal_title(F.col("title")).alias("normal"), TT.is_solution(F.col("title")).alias("solution"), TT.companion(F.col("title")).alias("companion"))


@query("SELECT * FROM (VALUES ('3.2', 13, 'near'), ('5.1', 30, 'sibling'), ('3.12b', 7, 'local'), ('8.8', NULL, NULL)) v(target, pos, source)")
def repair_sources(spark, d):
    wanted = _rows(spark, "('s', '3.2', 10, 'h1'), ('s', '5.1', 90, 'h9'), ('s', '3.12b', 95, 'h9'), ('s', '8.8', 99, 'h9')", "slug, target, cite_pos, heading")
    rows = _rows(spark, "('s', 13, CAST(NULL AS string), CAST(NULL AS string), 'h1'), ('s', 8, NULL, NULL, 'h1'), ('s', 12, NULL, NULL, 'h2'), ('s', 30, '5.1a', '5.1a', 'h1'), ('s', 7, '12', '12', 'h7')", "slug, pos, num, ref, heading")
    best = C.first_of(wanted, ["slug"], local=Q.local_candidates(wanted, rows, ["slug"]), near=C.near_candidates(rows, wanted, ["slug"]), sibling=C.sibling_candidates(rows.drop("heading"), wanted.drop("heading"), ["slug"]))
    return best.select("target", "pos", "source")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), '1.1', 'figure', 'fig-1.1'), (2, '1.1', 'figure', 'fig-1.2'), (2, '1.1', 'table', 'tbl-1.3'), (3, '1.1', 'equation', 'eq-1.4'), (4, '1.1', 'figure', NULL)) v(ord, section, type, id)")
def catalogue_build(spark, d):
    b = _rows(
        spark,
        "('s', 'ch01', 0L, 'section', '1.1', CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string)), ('s', 'ch01', 1L, 'fig', NULL, 'Fig. 1.1 A', 'f.png', NULL, NULL), ('s', 'ch01', 2L, 'fig', 'fig-1.2', 'Fig. 1.2 B Table 1.3 C', 'g.png', NULL, NULL), ('s', 'ch01', 3L, 'eq', NULL, NULL, NULL, '1.4', 'x'), ('s', 'ch01', 4L, 'fig', 'fig-ch01-4', NULL, 'h.png', NULL, NULL)",
        "slug, chunk, ord, t, id, caption, src, label, tex",
    )
    return C.build(b).select("ord", "section", "type", "id")


@query("SELECT * FROM (VALUES (3, '1.2', 'Big one', 24), (2, '1.2', 'Big one', 22)) v(idx, num, caption, score)")
def context_references(spark, d):
    texts = _rows(spark, "('c', 1, 'see Figure 1.1 there'), ('c', 4, 'Figure 1.2 Big one'), ('c', 9, 'nothing')", "k, idx, text")
    return Q.context(_rows(spark, "('c', 3), ('c', 8), ('c', 2)", "k, idx"), texts, ["k"], "fig").select("idx", "num", "caption", "score")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'resolved', CAST(1 AS BIGINT)), (2, 'resolved', 0), (3, 'dup', NULL), (4, 'unmatched', NULL), (5, 'no_english', NULL)) v(pid, outcome, new_idx)")
def realigned_patches(spark, d):
    blocks = _rows(spark, "('c', 0L, 'alpha'), ('c', 1L, 'beta'), ('c', 2L, 'twice'), ('c', 3L, 'twice')", "c, idx, text")
    beta = O.anchor(md=F.lit("beta"))
    patches = _rows(spark, "('c', 1L, 'own', ''), ('c', 2L, '00000000', 'alpha'), ('c', 3L, NULL, 'alpha'), ('c', 4L, NULL, 'twice'), ('c', 5L, NULL, ' ')", "c, pid, a, english").withColumn("a", F.when(F.col("a") == "own", beta).otherwise(F.col("a")))
    return O.realign(patches, blocks, ["c"]).select("pid", "outcome", "new_idx")


@query("SELECT * FROM (VALUES ('p', CAST(6 AS BIGINT)), ('q', -1), ('r', 0)) v(id, live_occ)")
def live_occurrences(spark, d):
    g = spark.range(1).select(F.inline(F.array(F.struct(F.lit("\\foo x").alias("tex"), F.lit(4).cast("long").alias("total_occ")), F.struct(F.lit("\\foo\\bar").alias("tex"), F.lit(2).cast("long").alias("total_occ")))))
    det = spark.range(1).select(F.inline(F.array(F.struct(F.lit("p").alias("id"), F.array(F.lit("\\foo")).alias("tokens")), F.struct(F.lit("r").alias("id"), F.array(F.lit("\\baz")).alias("tokens")), F.struct(F.lit("q").alias("id"), F.array().cast("array<string>").alias("tokens")))))
    return X.live_occurrences(g, det)


@query(r"SELECT * FROM (VALUES ('a^{x}^{y}', CAST(0 AS BIGINT)), ('\alpha + \alpha', 1), ('', 0)) v(tex, words)")
def control_words(spark, d):
    rows = spark.range(1).select(F.explode(F.array(F.lit("a^{x}^{y}"), F.lit("\\alpha + \\alpha"), F.lit(""))).alias("tex"))
    return rows.select("tex", F.size(M.control_words(F.col("tex"))).cast("long").alias("words"))


@query("SELECT * FROM (VALUES ('#a%20b/ch/3/sec-1.2', 'a b', 'ch', '3', 'sec-1.2'), ('#slug', 'slug', NULL, NULL, NULL), ('', NULL, NULL, NULL, NULL)) v(hash, slug, kind, key, anchor)")
def parsed_routes(spark, d):
    rows = _rows(spark, "('#a%20b/ch/3/sec-1.2'), ('#slug'), ('')", "hash").withColumn("r", web.parse_route(F.col("hash")))
    return rows.select("hash", "r.slug", "r.kind", "r.key", "r.anchor")


@query("""SELECT * FROM (VALUES ('<table onclick="x"><tr><td colspan="2" style="a">a<script>bad()</script><b>c', '<table><tr><td colspan="2">a<b>c</b></td></tr></table>', 'abad()c'), ('<table><tr><th>A</th><td> b </td></tr></table>', '<table><tr><th>A</th><td> b </td></tr></table>', 'A' || chr(9) || 'b')) v(html, clean, text)""".replace("'abad()c'", "'abad()c'"))
def table_html(spark, d):
    raw = ['<table onclick="x"><tr><td colspan="2" style="a">a<script>bad()</script><b>c', "<table><tr><th>A</th><td> b </td></tr></table>"]
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in raw])).alias("html"))
    return rows.select("html", web.sanitized("html").alias("clean"), web.table_text("html").alias("text"))


@query("SELECT * FROM (VALUES ('1', 'alpha'), ('3', 'last')) v(key, value)")
def marked_reply(spark, d):
    rows = spark.range(1).select(O.marked(F.lit("junk <<<1>>> alpha <<<3>>>first\n<<<3>>> last ")).alias("m"))
    return rows.select(F.explode("m"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), '1', 'first' || chr(10) || 'more'), (1, '2', 'second tail'), (2, '1', 'chapter two')) v(ch, num, solution)")
def extract_solutions(spark, d):
    b = spark.sql("SELECT 'b' AS slug, * FROM VALUES (1L, 'intro'), (2L, 'Chapter I'), (3L, '[1] first'), (4L, 'more'), (5L, '[2] second tail'), (6L, 'Chapter II'), (7L, '[1] chapter two') AS v(pos, text)")
    out = O.extract_solutions(b, ["slug"], "pos", r"^Chapter ([IVX]+|\d+)$", r"\[(\d+)\] ?", roman=True)
    return out.select(F.col("ch").cast("long").alias("ch"), "num", "solution")


@query(r"""
    SELECT * FROM (VALUES (CAST(0 AS BIGINT), '· ^ { · } ^ { · }'), (1, '\frac { · } { · } · \left ·'), (2, '\alpha _ { · }'), (3, ''), (4, '· \\'), (5, '\underline { { \left · \left · \right · } }')) v(id, skeleton)
""")
def formula_skeletons(spark, d):
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in TEX])).alias("id", "tex"))
    return rows.select(F.col("id").cast("long").alias("id"), M.skeleton(F.col("tex")).alias("skeleton"))


@query(r"SELECT * FROM (VALUES ('double_script', '· ^ { · } ^ { · }', CAST(5 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT)), ('undefined_macro', '\foo', 5, 2, 2), ('left_right', '\left ·', 5, 1, 1)) v(category, signature, total_occ, uniques, books)")
def skeleton_clusters(spark, d):
    return R.clusters(_findings(spark)).select("category", "signature", "total_occ", "uniques", "books")


@query(r"SELECT * FROM (VALUES ('\foo', CAST(2 AS BIGINT), CAST(5 AS BIGINT), CAST(2 AS BIGINT)), ('\bar', 1, 1, 1), ('\left', 1, 5, 1)) v(token, uniques, occ, books)")
def token_signals(spark, d):
    return R.token_signals(_findings(spark))


@query(r"SELECT * FROM (VALUES ('Double superscript', 'double_script', NULL), ('Missing $ inserted', 'math_mode', NULL), ('Misplaced alignment tab', 'alignment', NULL), ('Missing } inserted', 'missing_brace', NULL), ('Extra \left', 'left_right', NULL), ('undefined control sequence \zeta', 'undefined_macro', '\zeta'), ('what', 'other', NULL)) v(err, category, macro)")
def error_categorize(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Double superscript", "Missing $ inserted", "Misplaced alignment tab", "Missing } inserted", "Extra \\left", "undefined control sequence \\zeta", "what")])).alias("err"))
    return rows.select("err", M.category(F.col("err")).alias("category"), M.macro(F.col("err")).alias("macro"))


@query(r"SELECT * FROM (VALUES ('$\mathrm{}$', 'empty_shell'), ('$N_2$', NULL), ('\def\x{1}', 'tex_primitive'), ('\[\left. \right.\]', NULL), ('$$\complement$$', NULL), ('', 'empty_shell')) v(new, fault)")
def semantic_faults(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (r"$\mathrm{}$", "$N_2$", r"\def\x{1}", r"\[\left. \right.\]", r"$$\complement$$", "")])).alias("new"))
    return rows.select("new", M.semantic_fault(F.col("new")).alias("fault"))


@query(r"""
    WITH s AS (SELECT * FROM (VALUES (1, '熱力學 第二定律 entropy'), (2, '場'), (3, '電磁場 and Thévenin'), (4, 'x yz')) v(id, s)),
    w AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(s)), '[\p{L}\p{N}]+')) AS w FROM s),
    c AS (SELECT id, w, regexp_matches(w, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') AS cjk FROM w)
    SELECT DISTINCT CAST(id AS BIGINT) AS id, token FROM (
      SELECT id, w AS token FROM c WHERE NOT cjk AND length(w) BETWEEN 2 AND 30 UNION ALL SELECT id, w FROM c WHERE cjk AND length(w) = 1
      UNION ALL SELECT id, substr(w, k, 2) FROM (SELECT id, w, unnest(generate_series(1, length(w) - 1)) AS k FROM c WHERE cjk AND length(w) > 1))
""")
def cjk_bigrams(spark, d):
    rows = spark.sql("SELECT * FROM VALUES (1L, '熱力學 第二定律 entropy'), (2L, '場'), (3L, '電磁場 and Thévenin'), (4L, 'x yz') AS v(id, s)")
    return S.postings(rows, ["id"], "s")


@query("""
    SELECT title, chapter, starts_with(raw, '*') AS has_solution, ltrim(raw, '*') AS num
    FROM (SELECT book_idx, chapter, unnest(nums) AS raw FROM (VALUES (0, 1, ['1', '*2', '3']), (1, 4, ['*1']), (0, 2, [])) v(book_idx, chapter, nums)) r
    JOIN (VALUES (0, 'Alpha'), (1, 'Beta')) b(book_idx, title) ON r.book_idx = b.book_idx
""")
def hydrate_rows(spark, d):
    rows = spark.sql("SELECT * FROM VALUES (0, 1, array('1', '*2', '3')), (1, 4, array('*1')), (0, 2, CAST(array() AS array<string>)) AS v(book_idx, chapter, nums)")
    return S.hydrate(rows, spark.sql("SELECT * FROM VALUES (0, 'Alpha'), (1, 'Beta') AS b(book_idx, title)"))


@query("""
    WITH b AS (SELECT * FROM (VALUES (1, 'Problem 1 alpha'), (2, 'more'), (3, '2. beta'), (4, '1. back'), (5, 'Section end'), (6, 'lost'), (7, '3. gamma')) v(idx, text)),
    s AS (SELECT *, TRY_CAST(regexp_extract(text, '^(?:Problem )?([0-9]+)\\.? ', 1) AS BIGINT) AS v FROM b),
    g AS (SELECT *, v IS NOT NULL AND v > coalesce(max(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok, starts_with(text, 'Section') AS halt FROM s),
    m AS (SELECT *, last_value(CASE WHEN halt THEN 0 WHEN ok THEN v END IGNORE NULLS) OVER (ORDER BY idx) AS num FROM g)
    SELECT CAST(idx AS BIGINT) AS idx, CAST(num AS VARCHAR) AS num, CASE WHEN ok THEN trim(regexp_replace(text, '^(?:Problem )?([0-9]+)\\.? ', '')) ELSE text END AS text FROM m WHERE num > 0 AND NOT halt
""".replace("\\\\", "\\"))
def split_items(spark, d):
    b = spark.sql("SELECT 'b' AS slug, * FROM VALUES (1L, 'Problem 1 alpha'), (2L, 'more'), (3L, '2. beta'), (4L, '1. back'), (5L, 'Section end'), (6L, 'lost'), (7L, '3. gamma') AS v(idx, text)")
    return G.split_items_fast(b, ["slug"], "idx", r"^(?:Problem )?([0-9]+)\.? ", "^Section").select("idx", "num", "text")


@query("SELECT * FROM (VALUES ('05:07', CAST(307 AS BIGINT)), ('1:00:01', 3601), ('2-03:00:00', 183600), ('x', NULL)) v(raw, seconds)")
def elapsed_seconds(spark, d):
    return spark.sql("SELECT * FROM VALUES ('05:07'), ('1:00:01'), ('2-03:00:00'), ('x') AS v(raw)").select("raw", N.elapsed(F.col("raw")).alias("seconds"))


@query("SELECT title, author, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('Signals and Systems', 'Alan Oppenheim', 1.0), ('Signals and Systems', 'Hall', 0.6), ('Organic Chemistry', 'Clayden', 0.3), ('Calculus', '', 0.0)) v(title, author, confidence)")
def match_confidence(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('Signals and Systems', 'Alan Oppenheim', 'Signals & Systems', 'Oppenheim, Willsky'), ('Signals and Systems', 'Hall', 'Signals and Systems', 'Marshall'), ('Organic Chemistry', 'Clayden', 'Chemistry of Food', 'X'), ('Calculus', '', 'Algebra', '') AS v(title, author, ct, ca)")
    return rows.select("title", "author", T.confidence(F.col("title"), F.col("author"), F.col("ct"), F.col("ca")).alias("confidence"))


@query("SELECT * FROM (VALUES ('sig', CAST(1 AS BIGINT))) v(slug, cid)")
def exact_unique_match(spark, d):
    targets = spark.sql("SELECT 'main' AS kind, * FROM VALUES ('sig', 'Signals and Systems', 'Alan Oppenheim'), ('org', 'Organic Chemistry', 'Clayden'), ('cal', 'Calculus', 'Spivak') AS v(slug, title, author)")
    found = spark.sql("SELECT 'pdf' AS extension, * FROM VALUES (1L, 'Signals and Systems: Second Edition', 'Oppenheim'), (2L, 'Organic Chemistry', 'Clayden'), (3L, 'Organic Chemistry (2nd)', 'Clayden'), (4L, 'Calculus', 'Spivak'), (5L, 'Signals and Systems', 'Haykin') AS v(cid, title, author)")
    return U.exact_unique(targets, found)


@query("SELECT slug, cid, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('sig', CAST(1 AS BIGINT), 1.0), ('org', 2, 1.0)) v(slug, cid, confidence)")
def best_candidates(spark, d):
    targets = spark.sql("SELECT 'main' AS kind, * FROM VALUES ('sig', 'Signals and Systems', 'Alan Oppenheim'), ('org', 'Organic Chemistry', 'Clayden') AS v(slug, title, author)")
    found = spark.sql("SELECT 'pdf' AS extension, * FROM VALUES ('sig', 1L, 'Signals and Systems', 'Oppenheim', 9.0), ('org', 2L, 'Organic Chemistry', 'Clayden', 8.0), ('org', 3L, 'Organic Chemistry', 'Clayden', 2.0), ('org', 4L, 'Solutions Manual to Organic Chemistry', 'Clayden', 9.9) AS v(slug, cid, title, author, score)")
    return U.pick(U.matched(targets, found)).select("slug", "cid", "confidence")


@query("SELECT * FROM (VALUES ('4', '4th'), ('11', '11th'), ('22', '22nd'), ('Seventh International Edition', '7th International'), ('3rd', '3rd'), ('Second Edition', '2nd'), ('weird', 'weird'), ('', NULL)) v(raw, edition)")
def edition_normalize(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('4'), ('11'), ('22'), ('Seventh International Edition'), ('3rd'), ('Second Edition'), ('weird'), ('') AS v(raw)")
    return rows.select("raw", T.edition(F.col("raw")).alias("edition"))


@query("SELECT * FROM (VALUES ('A. One and B. Two', 'A. One; B. Two'), ('A One, B Two', 'A One; B Two'), ('A; B, C', 'A; B, C'), (' X ', 'X')) v(raw, author)")
def author_normalize(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('A. One and B. Two'), ('A One, B Two'), ('A; B, C'), (' X ') AS v(raw)")
    return rows.select("raw", T.author(F.col("raw")).alias("author"))


@query("SELECT * FROM (VALUES ('a', 'chapter_gap(2->9),companion'), ('b', ''), ('c', 'partial_source(starts@8),title_mismatch(0%)'), ('d', 'no_problems_extracted')) v(slug, flags)")
def quality_flags(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('a', array(1, 2, 9), 'Optics Study Guide', 'Optics', 5L), ('b', array(8, 9), 'Quantum Mechanics', 'Quantum Mechanics Vol. 2', 5L), ('c', array(8), 'Botany', 'Quantum Mechanics', 5L), ('d', array(1), 'Optics', 'Optics', 0L) AS v(slug, nums, landed, wanted, problems)")
    flags = U.quality_flags(F.col("nums"), F.col("landed"), F.col("wanted"), F.lit(0), F.lit(True), F.col("problems"))
    return rows.select("slug", F.array_join(U.blocking(flags), ",").alias("flags"))


@query("SELECT * FROM (VALUES ('IV', CAST(4 AS BIGINT)), ('xlii', 42), ('MCMXC', 1990), ('IX', 9), ('ABC', NULL), ('', NULL)) v(raw, n)")
def roman_numbers(spark, d):
    return spark.sql("SELECT * FROM VALUES ('IV'), ('xlii'), ('MCMXC'), ('IX'), ('ABC'), ('') AS v(raw)").select("raw", N.roman(F.col("raw")).cast("long").alias("n"))


@query("SELECT * FROM (VALUES ('15–23B', '15.23B', '15.23', '15–23B'), ('3-2c', '3.2c', '3.2', '3-2c'), ('7.1', '7.1', NULL, '7-1'), ('A', 'A', NULL, 'A')) v(raw, canonical, parent, dashed)")
def canonical_numbers(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('15–23B'), ('3-2c'), ('7.1'), ('A') AS v(raw)")
    return rows.select("raw", N.canonical(F.col("raw")).alias("canonical"), N.parent(F.col("raw")).alias("parent"), N.dashed(F.col("raw")).alias("dashed"))


@query("SELECT * FROM (VALUES ('a', 'main', NULL), ('a_sol', 'solution', 'a'), ('b', 'main', NULL)) v(slug, kind, \"of\")")
def derived_solutions(spark, d):
    return U.with_solutions(spark.sql("SELECT * FROM VALUES ('a', true), ('b', false) AS v(slug, has_solution)")).select("slug", "kind", "of")


@pytest.mark.parametrize("name", sorted(GOLDENS))
def test_golden(spark, name):
    f, sql = GOLDENS[name]
    assert compare(f(spark, None), sql, connect("/root/testdata/sf0.001")) == ""
