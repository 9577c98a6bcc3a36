"""Table HTML, routes and reader settings."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# The elements and attributes that published tables may keep.
TAGS = frozenset("table thead tbody tfoot tr td th caption colgroup col br span sup sub b i em strong u p pre code img".split())
ATTRS = {"td": {"colspan", "rowspan", "align"}, "th": {"colspan", "rowspan", "align", "scope"}, "img": {"src", "alt"}, "col": {"span"}, "colgroup": {"span"}}
VOID = frozenset(("br", "col", "img"))


class _Cleaner(HTMLParser):
    """Keeps allowed elements; the content of scripts and styles goes with them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.muted += 1
        elif tag in TAGS and not self.muted:
            kept = [(k, v or "") for k, v in attrs if k in ATTRS.get(tag, ()) and not (k == "src" and ":" in (v or "").split("/")[0])]
            self.out.append("<" + tag + "".join(f' {k}="{html.escape(v)}"' for k, v in kept) + ">")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        elif tag in self.open and not self.muted:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.muted:
            self.out.append(html.escape(data, quote=False))


def clean_table(text: str | None) -> str | None:
    if not text:
        return text
    c = _Cleaner()
    c.feed(text)
    c.close()
    return "".join([*c.out, *(f"</{t}>" for t in reversed(c.open))])


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.loose: list[str] = []
        self.cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = False

    def handle_data(self, data):
        self.loose.append(data)
        if self.cell and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def table_lines(text: str | None) -> str:
    """Cells by tabs, rows by lines; without rows the plain text."""
    c = _Cells()
    c.feed(text or "")
    c.close()
    return "\n".join("\t".join(x.strip() for x in r) for r in c.rows) if c.rows else "".join(c.loose).strip()


@F.pandas_udf(Ty.StringType())
def sanitized(s: pd.Series) -> pd.Series:
    return s.map(clean_table)


@F.pandas_udf(Ty.StringType())
def table_text(s: pd.Series) -> pd.Series:
    return s.map(table_lines)


def image_name(c: Column) -> Column:
    """The published image format."""
    return F.regexp_replace(c, r"(?i)\.jpg$", ".webp")


def parse_route(c: Column) -> Column:
    """#slug/kind/key/anchor?params as a struct; an empty route has nulls."""
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), "^#", "")
    parts = F.split(F.element_at(F.split(raw, r"\?", 2), 1), "/")
    deep = F.size(parts) >= 3

    def part(k: int) -> Column:
        v = F.get(parts, F.lit(k))
        return F.when(v != "", F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))))

    query = F.get(F.split(raw, r"\?", 2), F.lit(1))
    return F.struct(part(0).alias("slug"), F.when(deep, part(1)).alias("kind"), F.when(deep, part(2)).alias("key"), part(3).alias("anchor"), F.when(F.coalesce(query, F.lit("")) != "", query).alias("params"))


def build_route(slug: Column, kind: Column, key: Column, anchor: Column) -> Column:
    """The inverse of parse_route."""

    def e(c: Column) -> Column:
        return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))

    deep = F.when(kind.isNotNull() & key.isNotNull(), F.concat(F.lit("/"), e(kind), F.lit("/"), e(key), F.when(anchor.isNotNull(), F.concat(F.lit("/"), e(anchor))).otherwise("")))
    return F.when(slug.isNull(), F.lit("#")).otherwise(F.concat(F.lit("#"), e(slug), F.coalesce(deep, F.lit(""))))


def setting(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def shelf(status: Column) -> Column:
    return F.when(status == "owned", "owned").when(status.isin("available", "pending"), "pending").otherwise("absent")


def progress_ratio(furthest: Column, scroll: Column) -> Column:
    return F.coalesce(furthest, scroll, F.lit(0.0))
