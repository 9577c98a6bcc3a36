"""Scalar rules and small joins over texts composed from every row of a driver table.

Each input is spelled out of the columns of its row; the twin says the answer
from the same columns, without the rule under test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstrata.functions import mathx as M
from inkstrata.functions import numbers as N
from inkstrata.functions import titles as T
from inkstrata.functions import web
from inkstrata.operators import catalogs as C
from inkstrata.operators import overlay as O
from inkstrata.operators import repair as Q
from inkstrata.operators import residual as X
from inkstrata.operators import search as S
from inkstrata.operators import segment as G
from inkstrata.operators import universe as U
from inkstrata.plans.registry import query
from inkstrata.sources import read


# Columns are made when a query runs: the module is imported without a session too.


def p_key() -> Column:
    return F.col("p_partkey")


def p_size() -> Column:
    return F.col("p_size")


def p_name() -> Column:
    return F.col("p_name")


def p_type() -> Column:
    return F.col("p_type")


def p_brand() -> Column:
    return F.col("p_brand")


def no_text() -> Column:
    return F.lit(None).cast("string")



def _parts(spark, d):
    return read(spark, d, "part")


def _s(*parts) -> Column:
    """Strings and columns put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _turn(key: Column, *values: Column) -> Column:
    """The value for key modulo the number of values."""
    n, out = len(values), None
    for i, v in enumerate(values):
        out = F.when(key % n == i, v) if out is None else out.when(key % n == i, v)
    return out


def _caption() -> Column:
    return _turn(p_key(), _s("Fig. ", p_size(), ".", p_key(), " ", p_name()), _s("FIGURE ", p_size(), "-", p_key(), "b: ", p_name()), _s("Table ", p_size(), ".", p_key(), " ", p_name(), "; see Fig. ", p_size(), ".2"), _s("Tab. ", p_size(), "–", p_key(), " ", p_name()), p_name(), _s("as in Figure ", p_key(), ".", p_size()), F.lit(""))


@query("""
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'fig-' || p_size || '.' || p_partkey WHEN 1 THEN 'fig-' || p_size || '.' || p_partkey || 'b' WHEN 2 THEN 'fig-' || p_size || '.2' WHEN 5 THEN 'fig-' || p_partkey || '.' || p_size END AS fig,
      CASE WHEN p_partkey % 7 IN (2, 3) THEN 'tbl-' || p_size || '.' || p_partkey END AS tbl FROM part
""")
def caption_ids(spark, d):
    return _parts(spark, d).select("p_partkey", N.figure_id(_caption()).alias("fig"), N.table_id(_caption()).alias("tbl"))


@query("""
    SELECT p_partkey, 'figure' AS type, p_size || '.' || p_partkey AS num, 'Figure ' || p_size || '.' || p_partkey || ': ' || p_name AS display FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT p_partkey, 'figure', p_size || '.' || p_partkey || 'b', 'Figure ' || p_size || '.' || p_partkey || 'b: ' || p_name FROM part WHERE p_partkey % 7 = 1
    UNION ALL SELECT p_partkey, 'table', p_size || '.' || p_partkey, 'Table ' || p_size || '.' || p_partkey || ': ' || p_name || '; see' FROM part WHERE p_partkey % 7 = 2
    UNION ALL SELECT p_partkey, 'figure', p_size || '.2', 'Figure ' || p_size || '.2' FROM part WHERE p_partkey % 7 = 2
    UNION ALL SELECT p_partkey, 'table', p_size || '.' || p_partkey, 'Table ' || p_size || '.' || p_partkey || ': ' || p_name FROM part WHERE p_partkey % 7 = 3
""")
def caption_labels(spark, d):
    return _parts(spark, d).select("p_partkey", F.inline(N.caption_labels(_caption()))).select("p_partkey", "type", "num", "display")


@query("""
    WITH r AS (SELECT p_brand, p_partkey, 'figure' AS kind, p_size || '.1' AS ref FROM part UNION ALL SELECT p_brand, p_partkey, 'figure', p_size || '.3b' FROM part UNION ALL SELECT p_brand, p_partkey, 'table', p_size || '.2' FROM part)
    SELECT p_brand AS slug, kind, ref, min(p_partkey) AS first_id, count(*) AS total FROM r GROUP BY 1, 2, 3
""")
def ref_extract(spark, d):
    t = _parts(spark, d).select(p_brand().alias("slug"), p_key().alias("id"), _s("see Fig. ", p_size(), ".1 and Figure ", p_size(), ".3b; Table ", p_size(), "-2, figures ", p_key()).alias("text"))
    return C.text_references(t, ["slug"], "id").groupBy("slug", "kind", "ref").agg(F.min("id").alias("first_id"), F.max("total").alias("total"))


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'problem.body' WHEN 2 THEN 'problem.solution' END AS section, CASE p_partkey % 4 WHEN 1 THEN p_size || '.' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) END AS num,
      CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN p_size END AS BIGINT) AS occ, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN 0 END AS idx FROM part
""")
def selectors(spark, d):
    path = _turn(p_key(), _s("body[", p_key(), "]"), _s("problem:", p_size(), ".", p_key(), ":body[", p_key(), "]"), _s("problem:", p_key(), "#", p_size(), ":solution[0]"), p_name())
    return _parts(spark, d).withColumn("s", C.selector(path)).select("p_partkey", "s.section", "s.num", F.col("s.occ").cast("long").alias("occ"), F.col("s.idx").cast("long").alias("idx"))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'appA' ELSE 'ch' || p_size END AS chunk, CASE p_partkey % 3 WHEN 0 THEN 'body[' || p_partkey || ']' WHEN 1 THEN 'problem:' || p_partkey || ':solution[1]' ELSE p_type END AS selector FROM part
""")
def locator_targets(spark, d):
    where = _turn(p_key(), _s("ch", p_size(), ":body[", p_key(), "]"), _s("ch", p_size(), ":problem[", p_key(), "].solution[1]"), _s("appA:", p_type()))
    return _parts(spark, d).withColumn("t", C.target_of(where)).select("p_partkey", "t.chunk", "t.selector")


@query("""
    WITH c AS (SELECT p_brand, p_size || '.1' AS num, arg_min(p_partkey, p_partkey) AS pos, arg_min(p_name, p_partkey) AS src FROM part GROUP BY 1, 2), w AS (SELECT DISTINCT p_brand, (p_size + 1) || '.1' AS base, p_partkey % 2 = 1 AS lettered FROM part)
    SELECT w.p_brand AS slug, base || CASE WHEN lettered THEN 'b' ELSE '' END AS ref, pos, src FROM w LEFT JOIN c ON c.p_brand = w.p_brand AND c.num = w.base
""")
def caption_candidates(spark, d):
    p = _parts(spark, d).select(p_brand().alias("slug"), F.lit("figure").alias("kind"), _s(p_size(), ".1").alias("num"), p_key().alias("pos"), p_name().alias("src"), p_size().alias("size"))
    wanted = p.select("slug", "kind", F.concat(F.col("size") + 1, F.lit(".1"), F.when(F.col("pos") % 2 == 1, "b").otherwise("")).alias("ref")).distinct()
    return C.caption_candidates(p.drop("size"), wanted, ["slug"]).select("slug", "ref", "pos", "src")


@query(r"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x = ' || p_size WHEN 1 THEN p_name WHEN 2 THEN p_name || ' $ b' ELSE '\alpha' END AS tex, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || p_partkey WHEN 3 THEN p_size || '.' || p_partkey || 'a' END AS label FROM part")
def equation_labels(spark, d):
    raw = _turn(p_key(), _s("$$\nx = ", p_size(), " \\tag{", p_size(), ".", p_key(), "}\n$$"), _s("$$ ", p_name(), " $$"), _s(p_name(), " $ b"), _s("\\alpha \\tag*{", p_size(), ".", p_key(), "a}"))
    return _parts(spark, d).withColumn("t", N.strip_display(raw)).select("p_partkey", N.without_label(F.col("t")).alias("tex"), N.equation_label(F.col("t")).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN lower(c_mktsegment) ELSE '' END AS surname FROM customer")
def surnames(spark, d):
    seg = F.col("c_mktsegment")
    return read(spark, d, "customer").select("c_custkey", T.surname(_turn(F.col("c_custkey"), _s("John ", seg), _s(seg, ", Poole & Safko"), _s("van der ", seg), F.lit(""))).alias("surname"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name WHEN p_partkey % 4 = 2 THEN 'solutions manual to ' || p_name ELSE p_name || ' study guide' END AS normal, p_partkey % 4 = 2 AS solution, CASE WHEN p_partkey % 4 >= 2 THEN 'companion' END AS companion FROM part
""")
def title_kinds(spark, d):
    t = _turn(p_key(), _s(F.initcap(p_name()), ": Modern"), _s(p_name(), " (4th)"), _s("Solutions Manual to ", p_name()), _s(p_name(), " Study Guide"))
    return _parts(spark, d).withColumn("t", t).select("p_partkey", T.normal_title(F.col("t")).alias("normal"), T.is_solution(F.col("t")).alias("solution"), T.companion(F.col("t")).alias("companion"))


@query("""
    SELECT p_partkey AS slug, CASE p_partkey % 4 WHEN 0 THEN p_size || '.2' WHEN 1 THEN p_size || '.1' WHEN 2 THEN p_size || '.12b' ELSE '888.8' END AS target, CASE p_partkey % 4 WHEN 0 THEN 13 WHEN 1 THEN 30 WHEN 2 THEN 7 END AS pos, CASE p_partkey % 4 WHEN 0 THEN 'near' WHEN 1 THEN 'sibling' WHEN 2 THEN 'local' END AS source FROM part
""")
def repair_sources(spark, d):
    p = _parts(spark, d)
    target, cite = _turn(p_key(), _s(p_size(), ".2"), _s(p_size(), ".1"), _s(p_size(), ".12b"), F.lit("888.8")), _turn(p_key(), F.lit(10), F.lit(90), F.lit(95), F.lit(99))
    wanted = p.select(p_key().alias("slug"), target.alias("target"), cite.alias("cite_pos"), F.when(p_key() % 4 == 0, "h1").otherwise("h9").alias("heading"))
    one = [(13, no_text(), "h1"), (8, no_text(), "h1"), (12, no_text(), "h2"), (30, _s(p_size(), ".1a"), "h1"), (7, F.lit("12"), "h7")]
    rows = p.select(p_key().alias("slug"), F.inline(F.array(*[F.struct(F.lit(a).alias("pos"), n.alias("num"), n.alias("ref"), F.lit(h).alias("heading")) for a, n, h in one])))
    best = C.first_of(wanted, ["slug"], local=Q.local_candidates(wanted, rows, ["slug"]), near=C.near_candidates(rows, wanted, ["slug"]), sibling=C.sibling_candidates(rows.drop("heading"), wanted.drop("heading"), ["slug"]))
    return best.select("slug", "target", "pos", "source")


@query("""
    SELECT p_brand AS slug, p_partkey AS chunk, CAST(o AS BIGINT) AS ord, p_size || '.1' AS section, type, pre || p_size || post AS id
    FROM part, (VALUES (1, 'figure', 'fig-', '.1'), (2, 'figure', 'fig-', '.2'), (2, 'table', 'tbl-', '.3'), (3, 'equation', 'eq-', '.4'), (4, 'figure', NULL, NULL)) v(o, type, pre, post)
""")
def catalogue_build(spark, d):
    rows = [
        (0, "section", _s(p_size(), ".1"), no_text(), no_text(), no_text(), no_text()),
        (1, "fig", no_text(), _s("Fig. ", p_size(), ".1 A"), F.lit("f.png"), no_text(), no_text()),
        (2, "fig", _s("fig-", p_size(), ".2"), _s("Fig. ", p_size(), ".2 B Table ", p_size(), ".3 C"), F.lit("g.png"), no_text(), no_text()),
        (3, "eq", no_text(), no_text(), no_text(), _s(p_size(), ".4"), F.lit("x")),
        (4, "fig", F.lit("fig-ch01-4"), no_text(), F.lit("h.png"), no_text(), no_text()),
    ]
    names = ("id", "caption", "src", "label", "tex")
    b = _parts(spark, d).select(p_brand().alias("slug"), p_key().alias("chunk"), F.inline(F.array(*[F.struct(F.lit(o).cast("long").alias("ord"), F.lit(t).alias("t"), *[c.alias(n) for n, c in zip(names, r, strict=True)]) for o, t, *r in rows])))
    return C.build(b).select("slug", "chunk", "ord", "section", "type", "id")


@query("SELECT p_partkey AS k, idx, p_size || '.2' AS num, p_name AS caption, score FROM part, (VALUES (3, 24), (2, 22)) v(idx, score)")
def context_references(spark, d):
    p = _parts(spark, d)
    texts = p.select(p_key().alias("k"), F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), t.alias("text")) for i, t in ((1, F.lit("see Figure 1.1 there")), (4, _s("Figure ", p_size(), ".2 ", p_name())), (9, p_brand()))])))
    seen = p.select(p_key().alias("k"), F.explode(F.array(*map(F.lit, (3, 8, 2)))).alias("idx"))
    return Q.context(seen, texts, ["k"], "fig").select("k", "idx", "num", "caption", "score")


@query("SELECT p_partkey AS c, CAST(pid AS BIGINT) AS pid, outcome, CAST(new_idx AS BIGINT) AS new_idx FROM part, (VALUES (1, 'resolved', 1), (2, 'resolved', 0), (3, 'dup', NULL), (4, 'unmatched', NULL), (5, 'no_english', NULL)) v(pid, outcome, new_idx)")
def realigned_patches(spark, d):
    p = _parts(spark, d)
    blocks = p.select(p_key().alias("c"), F.posexplode(F.array(_s("alpha ", p_name()), p_brand(), F.lit("twice"), F.lit("twice"))).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))
    rows = [(1, O.anchor(md=p_brand()), F.lit("")), (2, F.lit("00000000"), _s("alpha ", p_name())), (3, no_text(), _s("alpha  ", p_name())), (4, no_text(), F.lit("twice")), (5, no_text(), F.lit(" "))]
    patches = p.select(p_key().alias("c"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("pid"), a.alias("a"), e.alias("english")) for i, a, e in rows])))
    return O.realign(patches, blocks, ["c"]).select("c", "pid", "outcome", "new_idx")


WORDS = "w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS word, sum(p_size) AS occ FROM part GROUP BY p_name)"


@query(f"WITH {WORDS} SELECT word AS id, CAST(sum(occ) AS BIGINT) AS live_occ FROM w GROUP BY word UNION ALL SELECT DISTINCT p_type, -1 FROM part UNION ALL SELECT DISTINCT p_brand, 0 FROM part")
def live_occurrences(spark, d):
    p = _parts(spark, d)
    tex = F.array_join(F.transform(F.split(p_name(), " "), lambda w: F.concat(F.lit("\\"), w)), " x ")
    found = p.groupBy(tex.alias("tex")).agg(F.sum("p_size").alias("total_occ"))
    word = p.select(F.explode(F.split(p_name(), " ")).alias("id")).distinct().select("id", F.array(F.concat(F.lit("\\"), F.col("id"))).alias("tokens"))
    none = p.select(p_type().alias("id"), F.array().cast("array<string>").alias("tokens")).distinct()
    absent = p.select(p_brand().alias("id"), F.array(F.lit("\\absent")).alias("tokens")).distinct()
    return X.live_occurrences(found, word.union(none).union(absent))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN len(list_distinct(string_split(p_name, ' '))) ELSE 0 END AS words FROM part")
def control_words(spark, d):
    tex = F.when(p_key() % 2 == 0, _s("\\", F.replace(p_name(), F.lit(" "), F.lit("_{1} + \\")), " \\", F.element_at(F.split(p_name(), " "), 1))).otherwise(p_name())
    return _parts(spark, d).select("p_partkey", F.size(M.control_words(tex)).cast("long").alias("words"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS slug, CASE p_partkey % 3 WHEN 0 THEN 'ch' END AS kind, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) END AS key, CASE p_partkey % 3 WHEN 0 THEN 'sec-' || p_partkey END AS anchor FROM part")
def parsed_routes(spark, d):
    hash_ = _turn(p_key(), _s("#", F.replace(p_name(), F.lit(" "), F.lit("%20")), "/ch/", p_size(), "/sec-", p_key()), _s("#", p_type()), F.lit(""))
    return _parts(spark, d).withColumn("r", web.parse_route(hash_)).select("p_partkey", "r.slug", "r.kind", "r.key", "r.anchor")


@query("""
    SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN '<table><tr><td colspan="' || p_size || '">' || p_name || '<b>' || p_partkey || '</b></td></tr></table>' ELSE '<table><tr><th>' || p_brand || '</th><td> ' || p_name || ' </td></tr></table>' END AS clean,
      CASE p_partkey % 2 WHEN 0 THEN p_name || 'bad()' || p_partkey ELSE p_brand || chr(9) || p_name END AS text FROM part
""")
def table_html(spark, d):
    raw = _turn(p_key(), _s('<table onclick="x"><tr><td colspan="', p_size(), '" style="a">', p_name(), "<script>bad()</script><b>", p_key()), _s("<table><tr><th>", p_brand(), "</th><td> ", p_name(), " </td></tr></table>"))
    return _parts(spark, d).withColumn("html", raw).select("p_partkey", web.sanitized("html").alias("clean"), web.table_text("html").alias("text"))


@query("SELECT p_partkey, '1' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, CAST(p_size + 1 AS VARCHAR), 'last ' || p_brand FROM part")
def marked_reply(spark, d):
    text = _s("junk <<<1>>> ", p_name(), " <<<", p_size() + 1, ">>>first\n<<<", p_size() + 1, ">>> last ", p_brand(), " ")
    return _parts(spark, d).select("p_partkey", F.explode(O.marked(text)))


@query("""
    SELECT p_partkey AS slug, CAST(1 AS BIGINT) AS ch, '1' AS num, p_name || chr(10) || 'more' AS solution FROM part UNION ALL SELECT p_partkey, 1, CAST(p_size + 1 AS VARCHAR), 'second ' || p_type FROM part UNION ALL SELECT p_partkey, 2, '1', p_brand FROM part
""")
def extract_solutions(spark, d):
    lines = [F.lit("intro"), F.lit("Chapter I"), _s("[1] ", p_name()), F.lit("more"), _s("[", p_size() + 1, "] second ", p_type()), F.lit("Chapter II"), _s("[1] ", p_brand())]
    b = _parts(spark, d).select(p_key().alias("slug"), F.posexplode(F.array(*lines)).alias("pos", "text"))
    out = O.extract_solutions(b, ["slug"], "pos", r"^Chapter ([IVX]+|\d+)$", r"\[(\d+)\] ?", roman=True)
    return out.select("slug", F.col("ch").cast("long").alias("ch"), "num", "solution")


@query(r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'kzjxwy', '\^_{}&'), '(?s)\\[a-zA-Z@]+|\\.|\\$|[\^_{}&]|[^\\\^_{}&]+') AS parts FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_filter(parts, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> ''), lambda p: CASE WHEN regexp_matches(p, '^[\\\^_{}&]') THEN p ELSE '·' END), ' ') AS skeleton FROM t
""")
def formula_skeletons(spark, d):
    """Every text with six of its letters read as TeX's structure characters."""
    tex = F.translate("text", "kzjxwy", "\\^_{}&")
    return read(spark, d, "documents").select("doc_id", M.skeleton(tex).alias("skeleton"))


def _findings(spark, d):
    """Every word of every document as a formula, six letters read as structure characters, with a message that follows from it."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    f = read(spark, d, "documents").select(F.col("source").alias("slug"), word.alias("w")).select("slug", F.translate("w", "kzjxwy", "\\^_{}&").alias("tex"))
    err = F.when(F.col("tex").startswith("\\"), _s("Undefined control sequence ", F.col("tex"))).when(F.col("tex").contains("^"), "Double superscript").when(F.col("tex").contains("&"), "Misplaced alignment tab").otherwise("near the end")
    p = f.groupBy("slug", "tex").agg(F.count(F.lit(1)).alias("occ")).withColumn("err", err)
    return p.withColumn("category", M.category(F.col("err"))).withColumn("macro", M.macro(F.col("err")))


FINDINGS = r"""
    w AS (SELECT source AS slug, translate(unnest(regexp_extract_all(text, '[A-Za-z]+')), 'kzjxwy', '\^_{}&') AS tex FROM documents),
    g AS (SELECT slug, tex, count(*) AS occ FROM w GROUP BY slug, tex),
    m AS (SELECT *, CASE WHEN starts_with(tex, '\') THEN nullif(regexp_extract('Undefined control sequence ' || tex, 'Undefined control sequence\s*(\\[A-Za-z@]+|\\.)', 1), '') END AS macro, list_filter(regexp_extract_all(tex, '(?s)\\[a-zA-Z@]+|\\.|\\$|[\^_{}&]|[^\\\^_{}&]+'), lambda p: trim(p) <> '') AS parts FROM g),
    f AS (SELECT slug, tex, occ, macro, CASE WHEN macro IS NOT NULL THEN 'undefined_macro' WHEN starts_with(tex, '\') THEN 'other' WHEN contains(tex, '^') THEN 'double_script' WHEN contains(tex, '&') THEN 'alignment' ELSE 'other' END AS category,
            array_to_string(list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '^[\\\^_{}&]') THEN p ELSE '·' END), ' ') AS skeleton FROM m)"""


@query(f"WITH {FINDINGS} SELECT category, coalesce(macro, skeleton) AS signature, CAST(sum(occ) AS BIGINT) AS total_occ, count(DISTINCT tex) AS uniques, count(DISTINCT slug) AS books, array_to_string(list_slice(list_sort(list(DISTINCT tex)), 1, 3), ' ') AS examples FROM f GROUP BY 1, 2")
def skeleton_clusters(spark, d):
    return X.clusters(_findings(spark, d)).withColumn("examples", F.array_join("examples", " "))


@query(rf"WITH {FINDINGS} SELECT token, count(DISTINCT tex) AS uniques, CAST(sum(occ) AS BIGINT) AS occ, count(DISTINCT slug) AS books FROM (SELECT slug, tex, occ, unnest(list_distinct(regexp_extract_all(tex, '\\[a-zA-Z@]+'))) AS token FROM f) GROUP BY token")
def token_signals(spark, d):
    return X.token_signals(_findings(spark, d))


@query(r"""
    WITH e AS (SELECT event_id, concat_ws('; ', CASE WHEN event_id % 2 = 0 AND value > 30 THEN 'Double superscript at ' || event_id END, CASE WHEN user_id % 3 = 0 THEN 'Missing $ inserted' END, CASE WHEN value < 5 THEN 'Misplaced alignment tab' END,
                      CASE WHEN event_id % 7 = 0 THEN 'Missing } inserted' END, CASE WHEN user_id % 5 = 0 THEN 'Extra \left' END, CASE WHEN event_type = 'signup' AND value > 10 THEN 'Undefined control sequence \u' || CAST(user_id AS VARCHAR) || ' or \' || event_type END, props) AS err FROM events),
    m AS (SELECT *, lower(err) AS low, nullif(regexp_extract(err, '[Uu]ndefined control sequence\s*(\\[A-Za-z@]+|\\.)', 1), '') AS macro FROM e)
    SELECT event_id, CASE WHEN macro IS NOT NULL THEN 'undefined_macro' WHEN contains(low, 'double superscript') OR contains(low, 'double subscript') OR contains(low, 'double exponent') THEN 'double_script' WHEN contains(low, 'missing $') OR contains(low, 'math mode') THEN 'math_mode'
      WHEN contains(low, 'extra alignment') OR contains(low, 'misplaced alignment') THEN 'alignment' WHEN contains(low, 'missing {') OR contains(low, 'missing }') OR contains(low, 'argument') THEN 'missing_brace' WHEN contains(low, '\left') OR contains(low, '\right') THEN 'left_right' ELSE 'other' END AS category, macro FROM m
""")
def error_categorize(spark, d):
    """Messages with several faults each: the first class that fits counts."""
    e, v, u = F.col("event_id"), F.col("value"), F.col("user_id")
    said = [
        F.when((e % 2 == 0) & (v > 30), _s("Double superscript at ", e)),
        F.when(u % 3 == 0, "Missing $ inserted"),
        F.when(v < 5, "Misplaced alignment tab"),
        F.when(e % 7 == 0, "Missing } inserted"),
        F.when(u % 5 == 0, "Extra \\left"),
        F.when((F.col("event_type") == "signup") & (v > 10), _s("Undefined control sequence \\u", u, " or \\", F.col("event_type"))),
        F.col("props"),
    ]
    err = F.concat_ws("; ", *said)
    return read(spark, d, "events").select("event_id", M.category(err).alias("category"), M.macro(err).alias("macro"))


#: Pieces that three numbers of an event choose from; the SQL judges what they make.
PIECES = ["\\mathrm{", "}", "\\left.", "\\right.", "x", "\\def", " ", "\\quad", "\\alpha", "~", "$", "$$"]


@query(rf"""
    WITH p AS (SELECT event_id, [{", ".join("'" + x + "'" for x in PIECES)}] AS p, CAST(floor(value) AS BIGINT) AS v, user_id AS u FROM events),
    n AS (SELECT event_id, trim('$' || p[event_id % 12 + 1] || p[(event_id + v) % 12 + 1] || p[(event_id * u + v) % 12 + 1] || '$') AS new FROM p),
    s AS (SELECT event_id, CASE WHEN regexp_matches(new, '(?s)^\$\$.*\$\$$') AND length(new) > 3 THEN substr(new, 3, length(new) - 4) ELSE substr(new, 2, length(new) - 2) END AS s FROM n)
    SELECT event_id, CASE WHEN regexp_matches(s, '{M.PRIMITIVES}') THEN 'tex_primitive' WHEN regexp_replace(regexp_replace(regexp_replace(s, '{M.WRAPPERS}', '', 'g'), '{M.CONTROL}', '§', 'g'), '[\^_{{}}&~\\,;:!\s]', '', 'g') = '' THEN 'empty_shell' END AS fault FROM s
""")
def semantic_faults(spark, d):
    """Replacements put together from an event's numbers: shells of wrappers and blanks, and primitives, must not be taken."""
    e, v, u = F.col("event_id"), F.floor("value"), F.col("user_id")
    p = F.array(*[F.lit(x) for x in PIECES])
    new = F.concat(F.lit("$"), *[F.get(p, (k % 12).cast("int")) for k in (e, e + v, e * u + v)], F.lit("$"))
    return read(spark, d, "events").select("event_id", M.semantic_fault(new).alias("fault"))


@query("SELECT p_partkey, unnest(list_distinct(['熱力', '力學', '場'] || string_split(p_name, ' ') || [lower(p_type)])) AS token FROM part")
def cjk_bigrams(spark, d):
    return S.postings(_parts(spark, d).select("p_partkey", _s("熱力學 ", p_name(), " 場 ", p_type()).alias("s")), ["p_partkey"], "s")


@query("SELECT n_name AS title, s_suppkey AS chapter, starts_with(raw, '*') AS has_solution, ltrim(raw, '*') AS num FROM (SELECT *, unnest(['1', '*2', CAST(s_suppkey + 3 AS VARCHAR)]) AS raw FROM supplier) JOIN nation ON n_nationkey = s_nationkey")
def hydrate_rows(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_nationkey").alias("book_idx"), F.col("s_suppkey").alias("chapter"), F.array(F.lit("1"), F.lit("*2"), (F.col("s_suppkey") + 3).cast("string")).alias("nums"))
    return S.hydrate(rows, read(spark, d, "nation").select(F.col("n_nationkey").alias("book_idx"), F.col("n_name").alias("title")))


ITEMS = "part, (VALUES (1, '1', 0), (2, '1', 1), (3, '2', 2), (4, '2', 3), (7, '3', 4)) v(idx, num, w)"


def _items(spark, d):
    lines = [F.lit("Problem 1 alpha"), F.lit("more"), _s("2. ", p_name()), F.lit("1. back"), F.lit("Section end"), F.lit("lost"), _s("3. ", p_brand())]
    return _parts(spark, d).select(p_key().alias("slug"), F.posexplode(F.array(*lines)).alias("idx", "text")).withColumn("idx", (F.col("idx") + 1).cast("long"))


@query(f"SELECT p_partkey AS slug, CAST(idx AS BIGINT) AS idx, num, ['alpha', 'more', p_name, '1. back', p_brand][w + 1] AS text FROM {ITEMS}")
def split_items(spark, d):
    return G.split_items_fast(_items(spark, d), ["slug"], "idx", r"^(?:Problem )?([0-9]+)\.? ", "^Section").select("slug", "idx", "num", "text")


#: Times as a process list writes them, and not quite: the numbers of an event choose the form.
CLOCK = r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$"


@query(rf"""
    WITH t AS (SELECT event_id, CAST(extract(day FROM ts) AS VARCHAR) AS d, lpad(CAST(extract(hour FROM ts) AS VARCHAR), 2, '0') AS h, lpad(CAST(extract(minute FROM ts) AS VARCHAR), 2, '0') AS m, lpad(CAST(extract(second FROM ts) AS VARCHAR), 2, '0') AS s, user_id AS u, CAST(floor(value) AS BIGINT) AS v FROM events),
    r AS (SELECT event_id, trim(CASE WHEN u % 3 = 0 AND v % 4 < 3 THEN d || '-' ELSE '' END || CASE WHEN v % 2 = 0 THEN h || ':' ELSE ' ' END || CASE WHEN v % 7 > 0 THEN m || ':' ELSE m END || s || CASE WHEN u % 11 = 10 THEN 's' ELSE '' END) AS raw FROM t)
    SELECT event_id, raw, CASE WHEN regexp_matches(raw, '{CLOCK}') THEN coalesce(try_cast(regexp_extract(raw, '{CLOCK}', 1) AS BIGINT), 0) * 86400 + coalesce(try_cast(regexp_extract(raw, '{CLOCK}', 2) AS BIGINT), 0) * 3600 + CAST(regexp_extract(raw, '{CLOCK}', 3) AS BIGINT) * 60 + CAST(regexp_extract(raw, '{CLOCK}', 4) AS BIGINT) END AS seconds FROM r
""")
def elapsed_seconds(spark, d):
    t, u, v = F.col("ts"), F.col("user_id"), F.floor("value")
    h, m, s = (F.lpad(f(t).cast("string"), 2, "0") for f in (F.hour, F.minute, F.second))
    raw = F.concat(F.when((u % 3 == 0) & (v % 4 < 3), _s(F.dayofmonth(t), "-")).otherwise(""), F.when(v % 2 == 0, F.concat(h, F.lit(":"))).otherwise(" "), F.when(v % 7 > 0, F.concat(m, F.lit(":"))).otherwise(m), s, F.when(u % 11 == 10, "s").otherwise(""))
    return read(spark, d, "events").select("event_id", F.trim(raw).alias("raw"), N.elapsed(raw).cast("long").alias("seconds"))


TITLES = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '//([^.]*)', 1) AS host FROM pages)"


@query(f"""
    WITH {TITLES},
    j AS (SELECT a.page_id, list_distinct(list_filter(regexp_extract_all(lower(a.title), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({", ".join("'" + w + "'" for w in T.MATCH_STOP)}))) AS want,
            list_distinct(regexp_extract_all(lower(b.title), '[a-z0-9]+')) AS has, list_distinct(list_filter(list_transform(regexp_extract_all(a.host || ' ' || right(a.title, 12), '[A-Za-z]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN ({", ".join("'" + w + "'" for w in T.NAME_DROP)}))) AS names,
            regexp_extract_all(lower(b.host || ' ' || b.title), '[a-z0-9_]+') AS hay FROM t a JOIN t b ON b.page_id = a.page_id + 1)
    SELECT page_id, CASE WHEN len(want) = 0 THEN 0 ELSE round(0.6 * (len(list_intersect(want, has)) / greatest(len(want), 1)) + 0.4 * CAST(list_has_any(names, hay) AS INT), 3) END AS confidence FROM j
""")
def match_confidence(spark, d):
    """Each page's title and host (as its author) against those of the next page."""
    t = read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "//([^.]*)", 1).alias("host"))
    after = t.select((F.col("page_id") - 1).alias("page_id"), F.col("title").alias("found"), F.col("host").alias("by"))
    author = F.concat("host", F.lit(" "), F.right("title", F.lit(12)))
    return t.join(after, "page_id").select("page_id", T.confidence(F.col("title"), author, F.col("found"), F.col("by")).alias("confidence"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS slug, p_partkey AS cid FROM part WHERE p_partkey % 3 = 0")
def exact_unique_match(spark, d):
    p = _parts(spark, d)
    title = _s(p_name(), " volume ", p_key())
    targets = p.select(F.lit("main").alias("kind"), p_key().cast("string").alias("slug"), title.alias("title"), F.lit("Alan Oppenheim").alias("author"))
    both = F.when(p_key() % 3 == 1, F.array(p_key(), p_key() + 1_000_000)).otherwise(F.array(p_key()))
    found = p.select(F.lit("pdf").alias("extension"), F.explode(both).alias("cid"), _s(title, ": Second Edition").alias("title"), F.when(p_key() % 3 == 2, "Haykin").otherwise("Oppenheim").alias("author"))
    return U.exact_unique(targets, found)


@query("SELECT CAST(p_partkey AS VARCHAR) AS slug, p_partkey + 1000000 AS cid, CAST(1.0 AS DOUBLE) AS confidence FROM part")
def best_candidates(spark, d):
    p = _parts(spark, d).withColumn("slug", p_key().cast("string"))
    targets = p.select("slug", F.lit("main").alias("kind"), p_name().alias("title"), F.lit("Alan Oppenheim").alias("author"))
    one = [(p_key(), p_name(), "Oppenheim", p_size()), (p_key() + 1_000_000, _s(p_name(), ": 2nd"), "Oppenheim", p_size() + 1), (p_key() + 2_000_000, _s("Solutions Manual to ", p_name()), "Oppenheim", p_size() + 9), (p_key() + 3_000_000, p_name(), "Haykin", p_size() + 9)]
    found = p.select("slug", F.lit("pdf").alias("extension"), F.inline(F.array(*[F.struct(c.alias("cid"), t.alias("title"), F.lit(a).alias("author"), s.alias("score")) for c, t, a, s in one])))
    return U.pick(U.matched(targets, found)).select("slug", "cid", "confidence")


ORDINAL = "p_size || CASE WHEN p_size % 100 IN (11, 12, 13) THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN {ORDINAL} WHEN 1 THEN {ORDINAL} || ' International' WHEN 2 THEN '2nd' WHEN 3 THEN p_name END AS edition FROM part")
def edition_normalize(spark, d):
    return _parts(spark, d).select("p_partkey", T.edition(_turn(p_key(), p_size().cast("string"), _s(p_size(), "th International Edition"), F.lit("Second Edition"), p_name(), F.lit(""))).alias("edition"))


@query(r"""
    WITH a AS (SELECT conv_id, turn, regexp_replace(trim(text, ' '), '\s+and\s+', '; ', 'g') AS a FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(a, ', ') AND NOT contains(a, '; ') THEN replace(a, ', ', '; ') ELSE a END AS author FROM a
""")
def author_normalize(spark, d):
    """Every turn read as a list of names: its commas separate only where no `and` does."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.author(F.col("text")).alias("author"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chapter_gap(2->' || (p_size + 6) || '),companion' WHEN 1 THEN '' WHEN 2 THEN 'partial_source(starts@' || (p_size + 1) || '),title_mismatch(0%)' ELSE 'no_problems_extracted' END AS flags FROM part")
def quality_flags(spark, d):
    one = F.lit(1)
    nums = _turn(p_key(), F.array(one, F.lit(2), p_size() + 6), F.array(p_size() + 1, p_size() + 2), F.array(p_size() + 1), F.array(one))
    landed, wanted = _turn(p_key(), _s(p_name(), " Study Guide"), p_name(), F.lit("Botany"), p_name()), _turn(p_key(), p_name(), _s(p_name(), " Vol. 2"), p_name(), p_name())
    flags = U.quality_flags(nums, landed, wanted, F.lit(0), F.lit(True), F.when(p_key() % 4 == 3, 0).otherwise(5))
    return _parts(spark, d).select("p_partkey", F.array_join(U.blocking(flags), ",").alias("flags"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 3999 + 1 END AS n FROM orders")
def roman_numbers(spark, d):
    n = (F.col("o_orderkey") % 3999 + 1).cast("int")
    digits_ = [("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]
    raw = F.concat(*[F.get(F.array(*map(F.lit, one)), (F.floor(n / 10 ** (3 - k)) % 10).cast("int")) for k, one in enumerate(digits_)])
    text = F.when(F.col("o_orderkey") % 5 == 4, F.col("o_orderpriority")).when(F.col("o_orderkey") % 2 == 0, F.lower(raw)).otherwise(raw)
    return read(spark, d, "orders").select("o_orderkey", N.roman(text).cast("long").alias("n"))


#: Pieces of catalogue numbers; three numbers of an event choose four of them.
NUMBER_PIECES = ["-", "–", "—", ".", "A", "b", " ", "7", "12", "3", "10"]
NUMBER_RAW = f"n AS (SELECT event_id, p[event_id % 11 + 1] || p[(event_id + v) % 11 + 1] || p[(event_id * u + v) % 11 + 1] || p[(v * 5 + u) % 11 + 1] AS raw FROM (SELECT event_id, user_id AS u, CAST(floor(value) AS BIGINT) AS v, {NUMBER_PIECES} AS p FROM events))"


def number_raw() -> Column:
    e, v, u = F.col("event_id"), F.floor("value"), F.col("user_id")
    p = F.array(*[F.lit(x) for x in NUMBER_PIECES])
    return F.concat(*[F.get(p, (k % 11).cast("int")) for k in (e, e + v, e * u + v, v * 5 + u)])


@query(f"WITH {NUMBER_RAW}, c AS (SELECT *, regexp_replace(trim(raw), '[-–—]', '.', 'g') AS canonical FROM n) SELECT event_id, canonical, nullif(regexp_extract(canonical, '^(.+[0-9])[a-zA-Z]$', 1), '') AS parent, regexp_replace(raw, '[.-]', '-', 'g') AS dashed FROM c")
def canonical_numbers(spark, d):
    raw = number_raw()
    return read(spark, d, "events").select("event_id", N.canonical(raw).alias("canonical"), N.parent(raw).alias("parent"), N.dashed(raw).alias("dashed"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, 'main' AS kind, NULL AS \"of\" FROM customer UNION ALL SELECT c_custkey || '_sol', 'solution', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0")
def derived_solutions(spark, d):
    return U.with_solutions(read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), (F.col("c_acctbal") > 0).alias("has_solution"))).select("slug", "kind", "of")
