"""Goldens and brute-force checks of operators that no oracle query covers."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import mathx as M
from inkstrata.functions import numbers as N
from inkstrata.functions import text as T
from inkstrata.functions import titles as TT
from inkstrata.operators import catalogs as C
from inkstrata.operators import overlay as O
from inkstrata.operators import residual as R
from inkstrata.operators import search as S
from inkstrata.operators import segment as G
from inkstrata.operators import state as P
from inkstrata.operators import universe as U
from inkstrata.plans import QUERIES

SF = "/root/testdata/sf0.001"


def values(spark, expr, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_fold_agrees_with_decomposition(spark):
    words = ["Thévenin", "SCHRÖDINGER", "Gauß", "naïve façade", "Ångström ǅ", "e\u0301clair", "Ελληνικά", None, ""]

    def plain(t):
        return "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if unicodedata.category(c) != "Mn")

    assert values(spark, T.fold_exact, *words) == [plain(w) for w in words]
    assert values(spark, T.fold, *words[:4], *words[5:]) == [plain(w) for w in words[:4] + words[5:]]


def test_tokens(spark):
    got = values(spark, lambda c: T.tokens(T.fold(c)), "A bb Bb 熱力學 場 x1 " + "y" * 31, None)
    assert got == [["bb", "x1", "熱力", "力學", "場"], []]
    assert values(spark, lambda c: T.query_terms(T.fold(c)), "Thévenin's a-b") == [["thevenin", "s", "a", "b"]]


def test_preview_rules(spark):
    long = "word " * 60
    dollar = "x" * 150 + " $a + b " + "c" * 60
    got = values(spark, T.preview, " a \n b ", long, dollar, "$half", None)
    assert got[0] == "a b" and got[1] == ("word " * 40).strip() + "…"
    assert got[2] == "x" * 150 + "…" and got[3] == "" and got[4] == ""


def test_snippet_marks(spark):
    s = T.snippet(["cafe"], 5)
    assert values(spark, s, "the Café is <here> now", "none here") == ["the <mark>Café</mark> is &lt;h…", "none here"]
    assert T.mark_ranges("aaa", ["aa", "a"]) == [(0, 3)]
    assert QUERIES["term_snippets"](spark, SF).where("snippet not like '%<mark>%'").count() == 0


def scan(text):
    """Regions by a plain walk over characters."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("$$", "\\(", "\\["):
            close = {"$$": "$$", "\\(": "\\)", "\\[": "\\]"}[two]
            j = text.find(close, i + 2)
            if j < 0:
                out.append((i, len(text)))
                break
            if text[i + 2 : j].strip():
                out.append((i, j + 2))
            i = j + 2
        elif text[i] == "$":
            j = text.find("$", i + 1)
            if j < 0 or "\n" in text[i + 1 : j]:
                i += 1
                continue
            if text[i + 1 : j].strip():
                out.append((i, j + 1))
            i = j + 1
        else:
            i += 1
    return out


def test_regions_against_walk():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["$", "$$", "a", " ", "\n", "\\(", "\\)", "\\[", "\\]"]) for _ in range(rng.randrange(14)))
        assert [(a, b) for a, b, inner in M.regions(t) if inner.strip()] == scan(t)


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [
        (r"\tag{$7^{\prime$}}", r"\tag{$7^{\prime}$}"),
        (r"\tag{7'$}", r"\tag{7'}"),
        (r"a^{x}^{y}^{z}", r"a^{x y z}"),
        (r"a_{1}_{2}", r"a_{1 2}"),
        (r"a^{x} ^{y}", r"a^{x} ^{y}"),
        (r"2 \ifmmode \times \else \texttimes \fi 3", r"2 \times 3"),
        (r"\mathopen{}\mathclose\bgroup x \aftergroup\egroup", " x "),
        (r"R \mathord{\left/ {\vphantom{R Q}} \right. \kern - \delimiterspace} Q", "R / Q"),
        (r"\underline{{\left/ 30 \left. \right.}}", r"\underline{\angle 30}"),
        (r"\underline{x}", r"\underline{x}"),
        (r"\[x\(1\)\]", "x(1)"),
        ("", ""),
    ],
)
def test_formula_repair(raw, fixed):
    assert M.normalize(raw) == fixed
    assert M.normalize(fixed) == fixed


def test_formula_repair_inside_text(spark):
    assert M.normalize_inline(r"a $x^{1}^{2}$ b^{1}^{2} $$y_{1}_{2}$$ $open") == r"a $x^{1 2}$ b^{1}^{2} $$y_{1 2}$$ $open"
    assert values(spark, M.normalized, r"a^{x}^{y}", "plain") == ["a^{x y}", "plain"]
    assert values(spark, M.leaks_tex, r"text \alpha here", r"fine $\alpha$") == [True, False]
    assert values(spark, M.skeleton, r"a^{x}^{y}") == values(spark, M.skeleton, r"p^{m}^{n}")


def test_split_fast_equals_machine(spark):
    rng = random.Random(4)
    rows = []
    for book in range(60):
        for i in range(rng.randrange(3, 25)):
            rows.append((f"b{book}", i, "text", rng.choice([f"{rng.randrange(1, 9)}. item", "prose", "Section X", f"1.{rng.randrange(1, 9)} sub"]), 1))
    df = spark.createDataFrame(rows, "slug string, idx long, type string, text string, text_level int")
    start, stop = r"^([0-9]+(?:\.[0-9]+)?)\.? ", r"^Section"
    fast = {(r["slug"], r["idx"], r["num"], r["text"]) for r in G.split_items_fast(df, ["slug"], "idx", start, stop).collect()}

    def make():
        return {"start": re.compile(start), "section": re.compile(r"^Section\s*(\w*)")}

    exact = {(r["slug"], r["idx"], r["num"], r["text"]) for r in G.split_items_exact(df.withColumn("ch", F.lit(1)), ["slug"], "ch", make).collect()}
    assert fast == exact


def test_split_machine_events():
    def b(text, level=None, kind="text"):
        return {"text": text, "text_level": level, "type": kind, "idx": 0}

    blocks = [b("PROBLEM a"), b("PROBLEM 3. b"), b("PROBLEM c"), b("Solution", 1), b("why"), b("1.2 Next", 1), b("PROBLEM 1. d"), b("END", 1), b("PROBLEM 9. e")]
    got = G.split_items(blocks, re.compile(r"^PROBLEM(?:\s+(\d+)\.)?"), 1, section=re.compile(r"^(\d+\.\d+) "), solution=re.compile("^Solution"), end=re.compile("^END"), namespace=True)
    assert [(r["num"], r["part"], r["text"]) for r in got] == [("1.1", "body", "a"), ("1.3", "body", "b"), ("1.2", "body", "c"), ("1.2", "solution", "why"), ("1.2.1", "body", "d")]
    far = G.split_items([b("2.1 x"), b("3.1 y")], re.compile(r"^(\d+\.\d+)"), 3, must_match=True)
    assert [r["num"] for r in far] == ["3.1"]


def test_alias_dedupe_against_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.random() < 0.4) for i in range(120)]
    seen, want = {}, []
    for i, k, alias in rows:
        if k not in seen:
            seen[k] = 0
            want.append((i, k))
        elif alias:
            want.append((i, k))
        else:
            seen[k] += 1
            want.append((i, f"{k}--{seen[k]}"))
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, i int, k string, alias boolean")
    got = [(r["i"], r["unique_id"]) for r in G.dedupe_ids_with_aliases(df, ["g"], ["i"], "k", "alias").orderBy("i").collect()]
    first_alias = {k: next(a for _, kk, a in rows if kk == k) for k in "abc"}
    fixed = []
    for (i, w), (_, k, alias) in zip(want, rows, strict=True):
        if first_alias[k] and "--" in w:
            n = int(w.split("--")[1])
            w = f"{k}--{n}"
        fixed.append((i, w))
    assert got == fixed


BLOCK = "type string, text string, list_items array<string>, img_path string, image_caption array<string>, chart_caption array<string>, table_caption array<string>, table_footnote array<string>, table_body string, code_body string, code_caption array<string>, content string, sub_type string, bbox array<string>, text_level int, idx long"


def block(**k):
    names = [x.split()[0] for x in BLOCK.split(", ")]
    return tuple(k.get(n) for n in names)


def test_typed_blocks(spark):
    rows = [
        block(type="text", text="  hi  ", idx=0),
        block(type="list", list_items=["a", None, " ", "b"], idx=1),
        block(type="equation", text="$$\nx = 1 \\tag{3.2}\n$$", idx=2),
        block(type="image", img_path="images/p.jpg", image_caption=["Fig. 1-2 A"], bbox=["0", "0", "10", "4"], sub_type="natural_image", idx=3),
        block(type="image", img_path="q.jpg", bbox=["104", "46", "608", None], idx=4),
        block(type="table", table_body="<table/>", table_caption=["Table 2.1 T"], table_footnote=["n"], idx=5),
        block(type="table", table_caption=["Table 2.2"], idx=6),
        block(type="code", code_body="a<b", code_caption=["Figure 4.1"], idx=7),
        block(type="footer", text="x", idx=8),
        block(type="text", text="   ", idx=9),
    ]
    got = {r["idx"]: r for r in G.to_struct(spark.createDataFrame(rows, BLOCK)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7]
    assert (got[0]["t"], got[0]["md"], got[1]["md"]) == ("p", "hi", "a\n\nb")
    assert (got[2]["tex"], got[2]["label"]) == ("x = 1", "3.2")
    assert (got[3]["src"], got[3]["kind"], got[3]["aspect"], got[3]["id"]) == ("p.jpg", "photo", 2.5, "fig-1.2")
    assert (got[4]["aspect"], got[4]["kind"]) == (None, "line")
    assert (got[5]["id"], got[5]["footnote"], got[7]["html"], got[7]["id"]) == ("tbl-2.1", "n", "<pre><code>a&lt;b</code></pre>", "fig-4.1")
    flat = G.expand_lists(spark.createDataFrame(rows[:2], BLOCK), ["idx"]).orderBy("idx", "item").collect()
    assert [(r["idx"], r["type"], r["text"], r["text_level"]) for r in flat] == [(0, "text", "  hi  ", None), (1, "text", "a", None), (1, "text", "b", None)]


def test_headings_and_subcaptions(spark):
    df = spark.createDataFrame([("1.2.3 Deep", 1), ("1 .2 Flat", 2), ("Example 4.1", 1), ("1.2 Low", 3), ("prose", 1)], "s string, lvl int")
    h = G.heading(F.col("s"), F.col("lvl"), [1, 2], r"^(\d+\s?\.\d+)\s+(.*)", r"^(\d+\.\d+\.\d+)\s+(.*)", r"^Example (\d+\.\d+)")
    assert [tuple(r[0]) if r[0] else None for r in df.select(h).collect()] == [("subsection", "1.2.3", "Deep"), ("section", "1.2", "Flat"), ("example", "4.1", None), None, None]
    rows = [("b", 0, "fig", "(a)", None), ("b", 1, "p", None, None), ("b", 2, "fig", "Fig. 1.2 Both", "fig-1.2"), ("b", 3, "fig", "Fig. 1.3 One", "fig-1.3")]
    got = G.merge_subcaptions(spark.createDataFrame(rows, "k string, o int, t string, caption string, id string"), ["k"], "o", r"^Fig\. ").orderBy("o").collect()
    assert [(r["caption"], r["id"]) for r in got] == [("Fig. 1.2 Both", "fig-1.2"), (None, None), (None, None), ("Fig. 1.3 One", "fig-1.3")]


def test_media_ids_and_numbers(spark):
    df = spark.createDataFrame([("fig", "Fig. 1.1", None, "body"), ("fig", None, None, "problem"), ("eq", None, "2.3", "body"), ("table", "Figure 3.3", None, "body")], "t string, c string, l string, src string")
    ids = df.select(G.media_id(F.col("t"), F.col("c"), F.col("l"), F.lit("ch01"), F.col("src"), F.lit(5))).collect()
    assert [r[0] for r in ids] == ["fig-1.1", "fig-ch01-problem-5", "eq-ch01-2.3", "fig-3.3"]
    assert values(spark, N.number_tuple, "1.2.10", "1-3") == [[1, 2, 10], [1, 3]]
    assert values(spark, N.leading_int, "3.2", "12-4", "x") == [3, 12, None]
    assert [tuple(x) if x else None for x in values(spark, N.number_key, "4.10b", "4.2", "q")] == [(4, 10, 2), (4, 2, 0), None]
    assert values(spark, lambda c: N.human_bytes(c.cast("double")), "512", "2048", "3e6") == ["512.0B", "2.0KB", "2.9MB"]
    assert values(spark, lambda c: N.span_text(c.cast("double")), "30", "600", "7200") == ["30s", "10m", "2.0h"]
    assert values(spark, N.slugify, "Hello, World! " + "x" * 40)[0] == "hello-world-" + "x" * 20
    assert values(spark, lambda c: N.clamp_step(c.cast("int"), 5), "0", "7", None) == [1, 7, 5]
    assert values(spark, lambda c: N.nearest_index(F.array(F.lit(1.0), F.lit(4.0), F.lit(9.0)), c.cast("double")), "3", "8") == [1, 2]


def test_overlay_golden_and_realign(spark):
    assert values(spark, lambda c: O.anchor(md=c), "Hello  world") == ["80d3f819"]
    two = spark.createDataFrame([("Cap", "x  y")], "caption string, md string").select(O.anchor(md=F.col("md"), caption=F.col("caption")), O.anchor(caption=F.col("caption"), md=F.col("md"))).first()
    assert two[0] == two[1]
    blocks = spark.createDataFrame([("c", 0, "alpha"), ("c", 1, "beta"), ("c", 2, "twice"), ("c", 3, "twice")], "c string, idx int, text string")
    h = blocks.where("idx = 1").select(O.anchor(md=F.col("text"))).first()[0]
    patches = spark.createDataFrame([("c", 1, h, ""), ("c", 2, "00000000", "alpha"), ("c", 3, None, "alpha"), ("c", 4, None, "twice"), ("c", 5, None, " ")], "c string, pid int, a string, english string")
    got = {r["pid"]: (r["outcome"], r["new_idx"]) for r in O.realign(patches, blocks, ["c"]).collect()}
    assert got == {1: ("resolved", 1), 2: ("resolved", 0), 3: ("dup", None), 4: ("unmatched", None), 5: ("no_english", None)}


def test_guards_fail_whole_jobs(spark):
    base = spark.createDataFrame([(1, "now")], "k int, v string")
    rows = spark.createDataFrame([(1, "other", "new")], "k int, expect string, new string")
    with pytest.raises(Exception, match="guard mismatch"):
        O.strict(O.apply_overrides(base, rows, ["k"], "v")).collect()
    props = spark.createDataFrame([("a", "proposed"), ("b", "resolved")], "id string, status string")
    with pytest.raises(Exception, match="cannot change"):
        P.change_status(props, spark.createDataFrame([("a",), ("b",)], "id string"), "parked", ["proposed"]).collect()
    done = P.change_status(props, spark.createDataFrame([("a",)], "id string"), "parked", ["proposed"]).collect()
    assert {r["id"]: r["status"] for r in done} == {"a": "parked", "b": "resolved"}


def test_invalid_gate_rule_holds_everything(spark):
    rows = spark.createDataFrame([("x", "audit")], "slug string, stage string")
    rules = spark.createDataFrame([(0, "*", "*", "allow"), (1, "x", "audit", "maybe")], "rule_idx int, slug string, stage string, action string")
    assert not P.gates(rows, rules, "slug", "stage").first()["allowed"]
    assert P.gates(rows, rules.where("rule_idx = 0"), "slug", "stage").first()["allowed"]


def test_replace_and_progress(spark):
    df = spark.createDataFrame([("a b a", "a", "c", False), ("a b a", "a", "c", True), ("x", "q", "c", True)], "t string, o string, n string, every boolean")
    assert [r[0] for r in df.select(O.replace_text(F.col("t"), F.col("o"), F.col("n"), F.col("every"))).collect()] == ["c b a", "c b c", "x"]
    assert spark.range(1).select(O.monotone_progress(F.lit(0.7), F.lit(0.2))).first()[0] == 0.7
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "a boolean").select(O.merge_gate(F.col("a"))).collect()] == [False, True, False]


def test_catalogue_repair_sources(spark):
    wanted = spark.createDataFrame([("s", "3.2", 10, "h1")], "slug string, target string, cite_pos int, heading string")
    rows = spark.createDataFrame([("s", 13, None, None, "h1"), ("s", 8, None, None, "h1"), ("s", 12, None, None, "h2"), ("s", 30, "3.2a", "3.2a", "h1")], "slug string, pos int, num string, ref string, heading string")
    near = C.near_candidates(rows, wanted, ["slug"])
    sib = C.sibling_candidates(rows.drop("heading"), wanted, ["slug"])
    assert near.first()["pos"] == 13 and sib.first()["pos"] == 30
    best = C.first_of(wanted, ["slug"], near=near, sibling=sib).first()
    assert (best["pos"], best["source"]) == (13, "near")
    entries = spark.createDataFrame([("figure", "fig-1.1", None, "ch01", None, None), ("equation", None, None, "ch01", None, None), ("equation", None, "2.1", "x ch02", None, "a")], "type string, id string, label string, source string, chunk_key string, anchor string")
    assert sorted((r["anchor"], r["chunk_key"]) for r in C.normalized(entries).collect()) == [("a", "ch02"), ("fig-1.1", "ch01")]


def test_catalogue_build(spark):
    rows = [("s", "ch01", 0, "section", "1.1", None, None, None, None), ("s", "ch01", 1, "fig", None, "Fig. 1.1 A", "f.png", None, None), ("s", "ch01", 2, "fig", "fig-1.2", "Fig. 1.2 B Table 1.3 C", "g.png", None, None), ("s", "ch01", 3, "eq", None, None, None, "1.4", "x"), ("s", "ch01", 4, "fig", "fig-ch01-4", None, "h.png", None, None)]
    blocks = spark.createDataFrame(rows, "slug string, chunk string, ord int, t string, id string, caption string, src string, label string, tex string")
    got = [(r["ord"], r["section"], r["type"], r["id"]) for r in C.build(blocks).orderBy("ord", "type").collect()]
    assert got == [(1, "1.1", "figure", "fig-1.1"), (2, "1.1", "figure", "fig-1.2"), (2, "1.1", "table", "tbl-1.3"), (3, "1.1", "equation", "eq-1.4"), (4, "1.1", "figure", None)]


def test_metadata_and_resolution(spark):
    row = spark.range(1).select(TT.metadata_faults(F.lit("magic"), ["physics"], F.lit("four"), F.lit("A, B")), U.resolution_check(F.lit("main"), F.lit("Optics"), F.lit("Botany Study Guide")), U.resolution_check(F.lit("solution"), F.lit("Optics"), F.lit("Botany"))).first()
    assert row[0] == ["subject_unknown", "edition_pattern", "author_comma"]
    assert row[1] == ["block:companion", "block:no_overlap", "advisory:title_mismatch"] and row[2] == []
    assert values(spark, TT.surname, "John David Jackson", "Goldstein, Poole & Safko", "") == ["jackson", "goldstein", ""]
    assert values(spark, TT.normal_title, "Real Analysis: Modern (2nd)", "A. B", "Plain") == ["real analysis", "a", "plain"]
    pages = [("a", 900, 0.1, None), ("b", 10, 0.9, 120), ("c", 200, 0.9, 300), ("d", 5, 0.0, None), ("d", 800, 0.7, 300), ("e", 400, 0.7, 200)]
    got = {r["path"]: (r["type"], r["quality"], r["verdict"]) for r in U.triage(spark.createDataFrame(pages, "path string, chars int, cover double, dpi int")).collect()}
    assert got == {"a": ("born_digital", "good", "proceed"), "b": ("scanned_image", "bad", "review"), "c": ("ocr_sandwich", "good", "review"), "d": ("hybrid", "bad", "review"), "e": ("hybrid", "good", "proceed")}


def test_residual_flow(spark):
    found = spark.createDataFrame([("b1", "x^{", False, 3), ("b1", "y", True, 2), ("b2", "x^{", False, 1)], "slug string, tex string, display boolean, occ int")
    verdicts = spark.createDataFrame([("x^{", False, False, "Missing } inserted"), ("y", True, True, None)], "tex string, display boolean, ok boolean, err string")
    j = R.judged(found, verdicts)
    assert {r["slug"]: (r["spans_total"], r["unique_n"], r["bad_unique"], r["bad_occ"]) for r in R.book_report(j).collect()} == {"b1": (5, 2, 1, 3), "b2": (1, 1, 1, 1)}
    assert {r["category"] for r in j.where("not ok").collect()} == {"missing_brace"}
    audit = R.math_audit(spark.createDataFrame([(1, "a $$ b"), (2, r"\left( x"), (3, r"plain \beta"), (4, "ok")], "i int, text string"), ["i"])
    assert sorted((r["i"], r["kind"]) for r in audit.collect()) == [(1, "delimiter"), (2, "left_right"), (2, "raw_tex_leak"), (3, "raw_tex_leak")]
    det = spark.createDataFrame([("p", ["\\foo"]), ("q", [])], "id string, tokens array<string>")
    live = R.live_occurrences(spark.createDataFrame([("\\foo x", 4), ("\\foo\\bar", 2)], "tex string, total_occ int"), det)
    assert {r["id"]: r["live_occ"] for r in live.collect()} == {"p": 6, "q": -1}


def test_search_corners(spark):
    rows = [("b", i, t) for i, t in enumerate(["the cat", "the dog", "the cattle", "the", "the end", "the big end", "cater the"])]
    df = spark.createDataFrame(rows, "book string, i int, text string")

    def hits(*terms):
        return {r["i"]: r["score"] for r in S.candidates(df, "book", "i", list(terms)).collect()}

    assert hits("the") == {i: 1 for i in range(7)}  # common: every chunk
    assert hits("cat") == {0: 1}  # exact beats prefix
    assert hits("catt", "th") == {i: 1 + (i == 2) for i in range(7)}  # prefix, and prefix of a common token
    assert hits("cat", "zebra") == {}
    b = spark.createDataFrame([("b", 0, "section", "2.1", "T", "intro"), ("b", 1, "p", None, None, "big cat"), ("b", 2, "section", "", "U", "u"), ("b", 3, "p", None, None, "CAT big")], "k string, o int, t string, id string, title string, text string")
    assert [(r["o"], r["anchor"]) for r in S.block_hits(b, ["cat", "big"], ["k"], "o").orderBy("o").collect()] == [(1, "sec-2.1"), (3, "sec--2")]
