from __future__ import annotations

import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import external, web
from inkstrata.operators import repair as Q
from inkstrata.operators import reports as R
from inkstrata.operators import rules
from inkstrata.operators import segment as G


def test_clean_tables(spark):
    assert web.clean_table('<table onclick="x"><tr><td colspan="2" style="a">a<script>bad()</script><b>c') == '<table><tr><td colspan="2">a<b>c</b></td></tr></table>'
    assert web.clean_table('<img src="images/a.jpg"><img src="javascript:x"><iframe>q</iframe>') == '<img src="images/a.jpg"><img>q'
    assert web.table_lines("<table><tr><th>A</th><td> b </td></tr><tr><td>c</td></tr></table>") == "A\tb\nc"
    df = spark.createDataFrame([("<table><tr><td>x",), (None,)], "h string")
    assert [tuple(r) for r in df.select(web.sanitized("h"), web.table_text("h")).collect()] == [("<table><tr><td>x</td></tr></table>", "x"), (None, "")]


def test_routes_round_trip(spark):
    df = spark.createDataFrame([("#a%20b/ch/3/sec-1.2?q=x",), ("#slug",), ("",), (None,)], "h string")
    got = [tuple(r["r"]) for r in df.select(web.parse_route(F.col("h")).alias("r")).collect()]
    assert got == [("a b", "ch", "3", "sec-1.2", "q=x"), ("slug", None, None, None, None), (None,) * 5, (None,) * 5]
    back = df.select(web.parse_route(F.col("h")).alias("r")).select(web.build_route(F.col("r.slug"), F.col("r.kind"), F.col("r.key"), F.col("r.anchor")))
    assert [r[0] for r in back.collect()] == ["#a%20b/ch/3/sec-1.2", "#slug", "#", "#"]


def test_external_scorer(spark):
    code = "import sys, json\nfor l in sys.stdin:\n  v = json.loads(l)\n  if v['s'] != 'lost': print(json.dumps({'i': v['i'], 'ok': 'bad' not in v['s'], 'err': None}))\n  print('noise')"
    df = spark.createDataFrame([("good", True), ("bad", True), ("lost", False), ("good", True)], "tex string, display boolean")
    got = {r["tex"]: r["ok"] for r in external.scored(df, [sys.executable, "-c", code]).collect()}
    assert got == {"good": True, "bad": False, "lost": None}


GOOD = {
    "slug": "a", "title": "T", "body_start_page": 1, "appendices_start_page": None, "chapters": [{"num": 1}, {"num": 2}], "section_re": r"^(\d+\.\d+)\s+(.+)$", "subsection_re": r"^(\d+\.\d+\.\d+)\s+(.+)$",
    "heading_priority": ["subsection_re", "section_re"], "problem_start_re": r"^(\d+)\.", "problem_chapter_must_match": False, "equation_strip_dollar": True, "equation_label_re": r"\\tag\{(.+?)\}", "filter_types": ["header"],
}


def test_rule_faults(spark):
    assert rules.faults(GOOD) == []
    bad = {**GOOD, "section_re": r"^(\d+\.\d+)\s*(.*)$", "problem_start_re": "(", "chapters": [{"num": 1}, {"num": 3}], "filter_types": ["text"], "heading_text_level": [0], "mystery": 1, "inline_problems": "yes"}
    assert rules.faults(bad) == ["unknown mystery", "problem_start_re does not compile", "section_re takes bare numbers", "heading_text_level", "inline_problems is no boolean", "filter_types text", "chapter numbers are not consecutive"]
    ch = spark.createDataFrame([("a", 1, 0, 5, 10), ("a", 2, 12, 11, 11), ("a", 3, 90, None, 200)], "slug string, num int, start int, problems int, stop int")
    size = spark.createDataFrame([("a", 100)], "slug string, n_blocks int")
    assert sorted((r["num"], r["fault"]) for r in rules.range_faults(ch, size).collect()) == [(2, "problems outside"), (2, "start after stop"), (3, "stop outside")]
    blocks = spark.createDataFrame([("a", 95, "text", "Exercises"), ("a", 96, "text", "1. x")], "slug string, idx int, type string, text string")
    assert [r["num"] for r in rules.unanchored(ch, blocks, r"^\d+\.", "^Exercises$").collect()] == [3]


def test_context_precedence(spark):
    texts = spark.createDataFrame([("c", 1, "see Figure 1.1 there"), ("c", 4, "Figure 1.2 Big one"), ("c", 9, "nothing")], "k string, idx int, text string")
    vis = spark.createDataFrame([("c", 3), ("c", 8), ("c", 2)], "k string, idx int")
    got = {r["idx"]: (r["num"], r["caption"], r["score"]) for r in Q.context(vis, texts, ["k"], "fig").collect()}
    assert got == {3: ("1.2", "Big one", 24), 2: ("1.2", "Big one", 22)}
    lead = spark.createDataFrame([(" Table 2.1: Sizes",), ("in Figure 1.1",), ("Fig. 3-4",)], "t string").select(Q.leading_reference(F.col("t")).alias("r")).collect()
    assert [tuple(r["r"]) if r["r"] else None for r in lead] == [("table", "2.1", "Sizes"), None, ("fig", "3.4", None)]
    need = spark.createDataFrame([(None, "fig-1.1", None), ("C", "fig-1.1", None), ("C", "fig-ch01-2", None), ("C", None, "x")], "c string, i string, e string")
    assert [r[0] for r in need.select(Q.needs_repair(F.col("c"), F.col("i"), F.col("e"), F.lit("Fig. 1.1"))).collect()] == [True, False, True, True]
    s = "struct<num:string,caption:string>"
    one = spark.createDataFrame([(("1.1", None), ("2.2", "near"), "fig-ch01-1", None), (None, ("2.2", "near"), "fig-ch01-1", None), (None, None, "fig-7.7", "own"), (None, None, None, None)], f"own {s}, near {s}, id string, caption string")
    i, c, src = Q.repaired("fig", F.col("own"), F.col("near"), F.col("id"), F.col("caption"), F.lit("made"))
    assert [tuple(r) for r in one.select(i, c, src).collect()] == [("fig-1.1", "near", "self"), ("fig-2.2", "near", "context"), ("fig-7.7", "own", "id"), (None, "made", "generated")]
    loc = Q.local_candidates(spark.createDataFrame([("s", "3.12b"), ("s", "3.9")], "k string, target string"), spark.createDataFrame([("s", "12", 7)], "k string, num string, pos int"), ["k"])
    assert [(r["target"], r["pos"]) for r in loc.collect()] == [("3.12b", 7)]
    al = spark.range(1).select(Q.with_alias(F.lit(None).cast("array<struct<type:string,id:string,source:string>>"), F.lit("figure"), F.lit("1.1"), F.lit("near")).alias("a"))
    assert len(al.select(Q.with_alias(F.col("a"), F.lit("figure"), F.lit("1.1"), F.lit("x"))).first()[0]) == 1


def test_health_and_times(spark):
    now = datetime(2024, 5, 2, 12, tzinfo=timezone.utc)
    assert [R.since(x, now).isoformat() for x in ("12h", "today", "90min", "2024-01-01")] == ["2024-05-02T00:00:00+00:00", "2024-05-02T00:00:00+00:00", "2024-05-02T10:30:00+00:00", "2024-01-01T00:00:00+00:00"]
    df = spark.createDataFrame([("2024-01-03T00:00:00Z", "2024-01-01T00:00:00Z", "bad"), (None, "2024-01-02T00:00:00", "2024-01-01T00:00:00Z"), (None, None, "bad")], "a string, b string, c string")
    got = [r[0] for r in df.select(F.date_format(R.entry_time(F.col("a"), F.col("b"), F.col("c")), "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-03", "2024-01-01", None]
    log = spark.createDataFrame([("tick start", "2024-01-01 00:00:00"), ("tick end", "2024-01-01 00:05:00"), ("other", "2024-01-01 00:06:00")], "line string, at string").withColumn("at", F.col("at").cast("timestamp"))
    h = R.daemon_health(log, 600, F.lit("2024-01-01 00:07:00").cast("timestamp")).first()
    assert (h["running"], h["duration_s"], h["next_in_s"]) == (False, 300, 480)
    states = spark.createDataFrame([(5, 1, 1, True), (0, 1, 1, False), (5, 0, 1, False), (5, 1, 0, False), (5, 1, 1, False)], "r int, q int, m int, d boolean")
    assert [r[0] for r in states.select(R.crawl_state(F.col("r"), F.col("q"), F.col("m"), F.col("d"))).collect()] == ["downloading", "idle", "quota_empty", "holding", "draining"]


def test_proposals(spark):
    rows = spark.createDataFrame(
        [("P-2024-01-01-a", "math", "macro", "proposed", None, None), ("P-2024-01-01-b", "math", "nope", "parked", None, None), ("bad", "zzz", "x", "rejected", "dup odd", None), ("P-2024-01-01-a", "catalog", "rule", "accepted", "", None)],
        "id string, domain string, type string, status string, resolution string, unblock_kind string",
    )
    got = sorted((r["id"], r["fault"]) for r in R.lint(rows, {"math": ["macro"], "catalog": ["rule"]}, ["re-source"], ["dup"]).collect())
    assert got == [("P-2024-01-01-a", "no resolution"), ("P-2024-01-01-a", "repeated id"), ("P-2024-01-01-a", "repeated id"), ("P-2024-01-01-b", "type"), ("P-2024-01-01-b", "unblock"), ("bad", "domain"), ("bad", "id"), ("bad", "reject code")]
    p = spark.createDataFrame([("m", "math", "s", False, "proposed"), ("c", "catalog", "s", False, "proposed"), ("e", "engine", "t", True, "proposed"), ("q", "crawl", "s", False, "proposed")], "id string, domain string, slug string, caption_gap boolean, status string")
    v = R.verify(p, spark.createDataFrame([("m", 4)], "id string, live_occ int"), spark.createDataFrame([("s", 0)], "slug string, critical int"))
    assert {r["id"]: r["verdict"] for r in v.collect()} == {"m": "live", "c": "resolved", "e": "inconclusive", "q": "inconclusive"}
    assert [r["id"] for r in R.superseded(p, v).where("status = 'superseded'").collect()] == ["c"]
    feed = spark.createDataFrame([("a", "proposed", "2024-01-01", "x"), ("b", "accepted", "2024-01-01", "2024-03-01"), ("c", "parked", "2024-02-01", "x"), ("d", "accepted", "2024-01-01", "2024-02-01")], "id string, status string, created string, updated string")
    assert [r["id"] for r in R.proposals_feed(feed, 1).orderBy("pos").collect()] == ["c", "a", "b"]


def test_upserts_and_registry(spark):
    base = spark.createDataFrame([("a", 1, None), ("b", 2, 2)], "slug string, x int, y int")
    fresh = spark.createDataFrame([("a", None, 9), ("c", 3, 3)], "slug string, x int, y int")
    assert sorted(tuple(r) for r in R.merge_upsert(base, fresh, ["slug"], ["x", "y"]).collect()) == [("a", 1, 9), ("b", 2, 2), ("c", 3, 3)]
    only = R.merge_upsert(base, spark.createDataFrame([("b", 7, 7), ("a", 7, 7)], "slug string, x int, y int"), ["slug"], ["x", "y"], only_missing=True)
    assert sorted(tuple(r) for r in only.collect()) == [("a", 1, 7), ("b", 2, 2)]
    f = spark.createDataFrame([("a",), ("b",), ("z",)], "slug string")
    assert {r["slug"]: r["action"] for r in R.unregistered(f, f.where("slug < 'c'"), f.where("slug = 'b'")).collect()} == {"a": "register", "b": "skip", "z": "unresolved"}
    w = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "3")], "slug string, link_id string")
    links = spark.createDataFrame([("a", "1")], "slug string, link_id string")
    assert {r["slug"]: r["outcome"] for r in R.valid_commit(w, links).collect()} == {"a": "kept", "b": "conflict", "c": "added"}
    assert spark.range(1).select(R.valid_chain(F.array(F.lit("x"), F.lit("y")), ["x"])).first()[0] is None


def test_flatten_parse_and_headers(spark):
    b = "array<struct<t:string,md:string>>"
    chunks = spark.createDataFrame([("s", "ch01", [("p", "a"), ("p", "b")], [("1", [("p", "q")], [("p", "sol")]), ("1", [("p", "again")], None)])], f"slug string, stem string, body {b}, problems array<struct<num:string,body:{b},solution:{b}>>")
    got = sorted((r["locator"], r["occ"], r["md"]) for r in G.flatten_chunks(chunks).collect())
    assert got == [("ch01:body[0]", 0, "a"), ("ch01:body[1]", 0, "b"), ("ch01:problem[1].body[0]", 0, "q"), ("ch01:problem[1].body[0]", 1, "again"), ("ch01:problem[1].solution[0]", 0, "sol")]
    rows = spark.createDataFrame([("s", 0, "3.1 Head", True), ("s", 1, "4. spill", False), ("s", 2, "3.2 Real", True), ("s", 3, "1. first", False)], "k string, o int, text string, h boolean")
    assert [r["o"] for r in G.running_headers(rows, ["k"], "o", F.col("h"), r"^(\d+)\.").where("running").collect()] == [0]
    from test_operators import BLOCK, block

    raw = [block(type="header", text="x", idx=0), block(type="text", text="1.1 Start", text_level=1, idx=1), block(type="text", text="prose", idx=2), block(type="text", text="late", idx=9)]
    blocks = spark.createDataFrame(raw, BLOCK).withColumn("slug", F.lit("s"))
    ranges = spark.createDataFrame([("s", 1, 0, 5)], "slug string, chapter int, start int, stop int")
    out = G.parse(blocks, ranges, ["header"], r"^(\d+\.\d+)\s+(.+)$", r"^(\d+\.\d+\.\d+)\s+(.+)$", [1]).orderBy("idx").collect()
    assert [(r["t"], r["id"], r["title"], r["md"]) for r in out] == [("section", "1.1", "Start", None), ("p", None, None, "prose")]
    lv = G.level_mode(blocks, ["slug"], r"^\d").first()
    assert lv["level"] == 1
    heads = spark.createDataFrame([("s", 5, "Index"), ("s", 3, "References"), ("s", 4, "Appendix A"), ("s", 7, "Index")], "k string, o int, text string")
    assert sorted((r["kind"], r["o"]) for r in G.boundaries(heads, ["k"], "o").collect()) == [("appendix", 4), ("bibliography", 3), ("index", 5)]


def test_scorer_starts_once_for_each_partition(spark, tmp_path):
    log = tmp_path / "starts"
    code = f"import sys, json\nopen({str(log)!r}, 'a').write('x')\nfor l in sys.stdin:\n  v = json.loads(l)\n  print(json.dumps({{'i': v['i'], 'ok': len(v['s']) % 2 == 0, 'err': v['s'][-2:]}}), flush=True)"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(3000).selectExpr("concat('f', id) AS tex", "id % 2 = 0 AS display")
        got = external.scored(df, [sys.executable, "-c", code]).collect()
        parts = external.scored(df, [sys.executable, "-c", code]).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["tex"], r["display"], r["ok"], r["err"]) for r in got) == sorted((f"f{k}", k % 2 == 0, len(f"f{k}") % 2 == 0, f"f{k}"[-2:]) for k in range(3000))
    assert 0 < len(log.read_text()) <= parts


@pytest.mark.parametrize(("code", "said"), [("import sys; sys.stdin.readline(); sys.stderr.write('no renderer'); sys.exit(3)", "no renderer"), ("import time; time.sleep(60)", "said nothing")])
def test_scorer_failures_fail_the_task(spark, code, said):
    df = spark.range(5).selectExpr("concat('f', id) AS tex", "true AS display").coalesce(1)
    with pytest.raises(Exception, match=said):
        external.scored(df, [sys.executable, "-c", code], timeout_s=2).collect()


def test_scorer_that_ends_early_leaves_the_rest_open(spark):
    df = spark.range(20_000).selectExpr("concat('formula ', id) AS tex", "true AS display")
    code = "import sys, json\nv = json.loads(sys.stdin.readline())\nprint(json.dumps({'i': v['i'], 'ok': True}))"
    got = external.scored(df, [sys.executable, "-c", code]).groupBy("ok").count().collect()
    assert {r["ok"]: r["count"] > 0 for r in got} == {True: True, None: True} and sum(r["count"] for r in got) == 20_000
