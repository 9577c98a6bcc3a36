"""Layout-aware rendering of HTML to text.

A tokenizer feeds a tree builder that knows void elements, implied end tags
and unmatched end tags; a renderer walks the tree without recursion, skips what
is not shown, and keeps block spacing, list markers and table columns.
Pages are independent, so one map pass does it all.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._spark import table

TOKEN = re.compile(r"<!--(?:.*?-->|>|->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template title meta link noscript iframe object audio video canvas svg math datalist noembed noframes select".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = PARAGRAPH | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav section summary thead tbody tfoot tr td th optgroup option".split())
ENDS_P = (PARAGRAPH | BLOCK) - frozenset("html body caption td th tr thead tbody tfoot option optgroup".split())
#: An opening tag ends the open elements of the second field, looked for up to one of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th", "caption"), ("table",)),
    "th": (("td", "th", "caption"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
    "body": (("head",), ("html",)),
}
SCOPE = frozenset("td th caption table html body".split())

#: Layout is bounded, text is not: levels that still indent, characters that a table column is padded to,
#: columns up to which spans count.  Without them a short page of deep lists or wide cells becomes mostly blanks.
LEVELS = 40
PADDED = 120
SPANNED = 1000


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def tree(page: str) -> Node:
    """The element tree of a page; text is str among the kids."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(page)
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag stands in the stack

    def close(tags: tuple[str, ...], stops: tuple[str, ...] | frozenset[str]) -> bool:
        """End the innermost of the tags unless one of the stops lies inside it: two lookups, not a walk down the stack."""
        first = max((places[t][-1] for t in tags if places[t]), default=0)
        if not first or first < max((places[t][-1] for t in stops if places[t]), default=0):
            return False
        while first > 1 and stack[first - 1].tag in tags and len(tags) > 1:
            first -= 1
        for node in stack[first:]:
            places[node.tag].pop()
        del stack[first:]
        return True

    def say(text: str) -> None:
        if text:
            stack[-1].kids.append(text)

    while at < n:
        m = TOKEN.search(page, at) if page.find(">", at) >= 0 or page.find("<!", at) >= 0 else None
        if m is None:
            say(html.unescape(page[at:]))
            break
        say(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not close(("p",), SCOPE):
                stack[-1].kids.append(Node("p", {}))
            elif tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif tag != "p":
                close((tag,), () if tag in ("table", "html", "body") else SCOPE - {tag})
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(m[3])} if m[3] else {}
        if tag in ENDS_P:
            close(("p",), SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            node.kids.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else n
            continue
        if not m[3].endswith("/") or tag not in ("svg", "math"):
            places[tag].append(len(stack))
            stack.append(node)
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in NEVER or "hidden" in a or (node.tag == "dialog" and "open" not in a) or bool("style" in a and UNSEEN.search(a["style"]))


class Flow:
    """Lines under construction: inline text, pending gaps, indents and a marker for the next line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            self.inline.append(first)
            for line in rest:
                self.flush(True)
                self.inline.append(line)
            return
        words = " ".join(s.split(None))
        if s[:1].isspace() and self.inline and not self.inline[-1].endswith(" "):
            self.inline.append(" ")
        if words:
            self.inline.append(words)
            if s[-1:].isspace():
                self.inline.append(" ")

    def flush(self, keep: bool = False, force: bool = False) -> None:
        line = "".join(self.inline)
        line = line.rstrip() if keep else line.strip()
        self.inline = []
        if not (line or self.marker or (force and self.lines) or (keep and self.lines)):
            return
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.gap = 1
        lead = "".join(self.indent[:LEVELS])
        if self.marker:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((lead + line).rstrip())

    def block(self, gap: int) -> None:
        if self.inline:
            self.flush()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _int(s: str | None, default: int, most: int = 1000) -> int:
    return min(int(s), most) if s and s.isascii() and s.isdigit() and len(s) < 9 else default


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (cell lines, colspan, rowspan) as lines with aligned columns."""
    held: dict[int, int] = {}
    placed: list[list[tuple[int, int, list[str]]]] = []
    for row in rows:
        at, out, later = 0, [], {}
        for lines, cols, down in row:
            while held.get(at, 0):
                at += 1
            out.append((at, cols, lines))
            if down > 1 and at < SPANNED:
                later |= {k: down for k in range(at, at + cols)}
            at += cols
        held = {k: v - 1 for k, v in (held | later).items() if v > 1}
        placed.append(out)
    wide = {c: 0 for row in placed for c, cols, lines in row if lines and cols == 1}
    for c, cols, lines in sorted((cell for row in placed for cell in row if cell[2]), key=lambda cell: cell[1]):
        covered = [k for k in range(c, c + cols) if k in wide] or [c]
        have = sum(wide.get(k, 0) for k in covered) + 3 * (len(covered) - 1)
        wide[covered[-1]] = wide.get(covered[-1], 0) + max(0, max(map(len, lines)) - have)
    wide = {c: min(w, PADDED) for c, w in wide.items()}
    shown = sorted(wide)
    if len(shown) < 2:
        return [line for row in placed for *_, lines in row for line in lines]
    text = []
    for row in placed:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            parts, at = [], 0
            for c, cols, lines in row:
                mine = shown[bisect_left(shown, c) : bisect_left(shown, c + cols)]
                if not mine:
                    continue
                parts += [" " * wide[x] for x in shown[bisect_left(shown, at) : bisect_left(shown, c)]]
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(wide[x] for x in mine) + 3 * (len(mine) - 1)))
                at = c + cols
            text.append(" | ".join(parts).rstrip())
    return text


def render(page: str | None) -> str:
    """Visible text of a page."""
    flow, flows = Flow(), []
    tables: list[list[list]] = []
    lists: list[list] = []
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(tree(page or ""), False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            flow.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node):
                continue
            if tag == "br":
                flow.flush(pre > 0, force=True)
                continue
            if tag in BLOCK and tag not in ("td", "th"):
                nested = tag in ("ul", "ol", "menu") and lists
                flow.block(2 if tag in PARAGRAPH and not nested else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, _int(node.attrs.get("start"), 1)])
            elif tag == "li":
                now = lists[-1] if lists else ["ul", 1]
                mark = "- "
                if now[0] == "ol":
                    number = _int(node.attrs.get("value"), now[1], 10**8)
                    now[1] = number + 1
                    mark = f"{number}. "
                flow.indent.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(flow)
                flow = Flow()
            todo.append((node, True))
            todo.extend((kid, False) for kid in reversed(node.kids))
            continue
        if tag in ("pre", "textarea") and flow.inline:
            flow.flush(True)
        if tag in BLOCK and tag not in ("td", "th"):
            flow.block(1)
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            if flow.marker:
                flow.flush()
            flow.indent.pop()
        elif tag in ("blockquote", "dd"):
            flow.indent.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag in ("td", "th") and tables:
            lines, flow = flow.done(), flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, _int(node.attrs.get("colspan"), 1) or 1, _int(node.attrs.get("rowspan"), 1) or 1))
        elif tag == "table":
            for line in grid(tables.pop()):
                flow.inline.append(line)
                flow.flush(True)
        if tag in PARAGRAPH and not (tag in ("ul", "ol") and lists):
            flow.gap = 2
    return "\n".join(flow.done())


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([render(x.as_py()) for x in batch.column(2)], pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the visible text of every page; null and empty pages give an empty text.

    Time and output stay in proportion to the page: lists indent up to `LEVELS`
    deep, table columns are padded up to `PADDED` characters; no text is cut.
    Broken markup never fails: unmatched end tags are dropped, open elements
    end with the page, a comment or raw element without an end takes the rest.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return own.mapInArrow(_render, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
