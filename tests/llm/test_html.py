from __future__ import annotations

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from inkstrata.llm.html_render import extract, op4_html, render

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<h1>T</h1><p>x  <b>y</b>\n z</p>", "T\n\nx y z"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name  | N\nalpha | 1\nb     | 22"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  | x\na | b | c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<head><title>no</title></head><script>var a='<p>'</script><style>p{}</style>yes", "yes"),
    ("<p hidden>no</p><p style='color:red; display : none'>no</p><p>yes", "yes"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("x &amp; y &lt;z&gt; &copy;", "x & y <z> ©"),
    ("a<!-- no -->b<!-- open", "ab"),
    ("</div></p>x</b>", "x"),
    ("<p>1 < 2 and <b", "1 < 2 and <b"),
    ("<blockquote>q</blockquote>", "  q"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<li>lone", "- lone"),
    ("", ""),
    (None, ""),
    ("<td>no table</td>", "no table"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>o</table>", "in | ner | o"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_rendering(page, text):
    assert render(page) == text


def test_depth_and_length():
    assert render("<div>" * 50_000 + "deep") == "deep"
    assert len(render("<p>x" * 50_000).split()) == 50_000
    assert render("<" * 20_000).startswith("<")


@pytest.mark.parametrize(
    "page",
    [
        "<ul><li>x" * 40_000,
        "<ol><li>x<blockquote>" * 20_000,
        "<b><table><tr><td>" + "<span>" * 40_000 + "</b>" * 40_000 + "x",
        "<table><tr><td>" + "<i>" * 20_000 + "</p></td><td>x" * 20_000,
        "<table>" + "<tr><td colspan=1000 rowspan=1000>x" * 2_000,
        "<table><tr><td>" + "w" * 50_000 + "<td>x" + "<tr><td>a<td>x" * 20_000,
    ],
)
def test_broken_pages_cost_in_proportion(page):
    began = time.time()
    text = render(page)
    assert time.time() - began < 4 and len(text) < 12 * len(page)
    assert text.count("x") == re.sub("<[^>]*>", "", page).count("x")


def test_deep_lists_and_wide_cells_keep_their_text():
    deep = "".join(f"<ul><li>w{k}" for k in range(60))
    lines = render(deep).split("\n")
    assert [x.strip() for x in lines] == [f"- w{k}" for k in range(60)] and lines[5] == "  " * 5 + "- w5"
    assert render(f"<table><tr><td>{'a' * 200}<td>b<tr><td>c<td>d</table>") == f"{'a' * 200} | b\n{'c'.ljust(120)} | d"


def test_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = op4_html(spark, sf).collect()
    assert {r["page_id"] for r in got} == set(pages)
    assert all(r["text"] == render(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)
    assert not any("track(" in r["text"] or "margin" in r["text"] for r in got)
    odd = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in extract(odd).collect()) == [(1, ""), (1, ""), (2, "")]


class Visible(HTMLParser):
    """Words that show, by the standard library's parser and a plain stack: no layout, no shared code."""

    VOID = set("area base br col embed hr img input link meta param source track wbr".split())
    UNSHOWN = set("head script style template title noscript iframe object audio video canvas svg math datalist select noembed noframes".split())
    ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
    BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr div section article aside header footer nav main li dt dd form fieldset address details".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.words = [], []

    def shut(self, tags, most=1):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return
            if self.stack[k][0] in ("table", "ul", "ol", "dl"):
                return

    def handle_starttag(self, tag, attrs):
        self.words.append(None)
        if tag in self.BLOCKS and self.stack and any(t == "p" for t, _ in self.stack):
            self.shut({"p"})
        while tag in self.ENDS and self.stack and self.stack[-1][0] in self.ENDS[tag]:
            self.stack.pop()
        if tag in self.ENDS and tag != "p":
            self.shut({tag})
        a = dict(attrs)
        hidden = tag in self.UNSHOWN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "").lower() or re.search("visibility:(hidden|collapse)", (a.get("style") or "").replace(" ", "").lower()) is not None
        if tag not in self.VOID:
            self.stack.append((tag, hidden or bool(self.stack and self.stack[-1][1])))

    def handle_endtag(self, tag):
        self.words.append(None)
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.words.append(data)


def shown(page):
    v = Visible()
    v.feed(page)
    v.close()
    return Counter(re.findall(r"\w+", "".join(" " if w is None else w for w in v.words)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_visible_words_of_all_pages_against_the_standard_parser(sf):
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist()
    wrong = []
    for r in pages:
        text = re.sub(r"(?m)^[ |]*(?:-|\d+\.) ", "", render(r["html"]))
        have, want = Counter(re.findall(r"\w+", text)), shown(r["html"])
        # an inline element inside a word parts it there only
        if "".join(sorted("".join(have.elements()))) != "".join(sorted("".join(want.elements()))):
            wrong.append((r["page_id"], list((want - have).items())[:5], list((have - want).items())[:5]))
    assert not wrong, (len(wrong), len(pages), wrong[:3])
