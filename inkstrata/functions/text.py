"""Folding, tokens, previews and matching of text, as native columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"


def _latin() -> tuple[str, str]:
    """Lower-case letters whose decomposition is a base letter and marks, and those bases."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00)]:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _latin()
#: translate() drops characters that have no counterpart: all marks of the basic plane.
MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) == "Mn")
RUN = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{2,30}(?![\p{L}\p{N}])"


def fold(c: Column) -> Column:
    """Lower case without diacritics: Latin and Greek letters natively, loose marks dropped."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED + MARKS, PLAIN))


@F.pandas_udf(Ty.StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """The same for every script, by canonical decomposition."""
    return s.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn"))


def tokens(folded: Column) -> Column:
    """Distinct tokens of folded text: runs of letters and digits of length 2 to 30; CJK runs as pairs of characters."""
    usual = F.array_distinct(F.regexp_extract_all(folded, F.lit(RUN), F.lit(0)))
    runs = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    plain = F.filter(runs, lambda w: ~w.rlike(f"[{CJK}]") & F.length(w).between(2, 30))
    wide = F.filter(runs, lambda w: w.rlike(f"[{CJK}]"))
    pairs = F.flatten(F.transform(wide, lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda k: F.substr(w, k, F.lit(2))))))
    return F.when(folded.rlike(f"[{CJK}]"), F.array_distinct(F.concat(plain, pairs))).otherwise(usual)


def query_terms(folded: Column) -> Column:
    """Terms of a folded query; single characters stay."""
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def matches_all(folded: Column, terms: list[str]) -> Column:
    """Every term is a substring."""
    out = F.lit(True)
    for t in terms:
        out = out & folded.contains(t)
    return out


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def plain_text(c: Column) -> Column:
    """Without tags, squeezed."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def preview(c: Column, limit: int = 200) -> Column:
    """One line of at most `limit` characters, cut at a late space, without half a formula, with an ellipsis if cut."""
    line = squeeze(c)
    cut = F.left(line, F.lit(limit))
    space = F.lit(limit) - F.instr(F.reverse(cut), " ")  # 0-based place of the last space
    cut = F.when((F.instr(cut, " ") > 0) & (space > limit * 0.6), F.left(cut, space)).otherwise(cut)
    body = F.when(F.length(line) > limit, cut).otherwise(line)
    dollars = F.length(body) - F.length(F.replace(body, F.lit("$"), F.lit("")))
    body = F.when(dollars % 2 == 1, F.rtrim(F.left(body, F.length(body) - F.instr(F.reverse(body), "$")))).otherwise(body)
    return F.concat(body, F.when(F.length(line) > limit, F.lit("…")).otherwise(F.lit("")))


def snippet_cut(c: Column, limit: int = 180) -> Column:
    return F.left(squeeze(c), F.lit(limit))


def mark_ranges(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Merged places of all terms in the original text, found in its folded form."""
    folded, place = [], []
    for i, ch in enumerate(text):
        piece = "".join(x for x in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(x) != "Mn")
        folded.append(piece)
        place += [i] * len(piece)
    hay, place = "".join(folded), [*place, len(text)]
    found = []
    for t in filter(None, terms):
        at = hay.find(t)
        while at >= 0:
            found.append((place[at], place[at + len(t)]))
            at = hay.find(t, at + len(t))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def snippet(terms: list[str], radius: int = 62):
    """A window around the first hit with hits marked, as an Arrow function of the text."""
    from html import escape

    def one(text: str | None) -> str:
        flat = " ".join((text or "").split())
        marks = mark_ranges(flat, terms)
        at = marks[0][0] if marks else 0
        lo, hi = max(0, at - radius), min(len(flat), at + 2 * radius)
        out, here = [], lo
        for a, b in marks:
            if b > lo and a < hi and a >= here:
                out += [escape(flat[here:a]), "<mark>", escape(flat[a : min(b, hi)]), "</mark>"]
                here = min(b, hi)
        out.append(escape(flat[here:hi]))
        return ("…" if lo else "") + "".join(out) + ("…" if hi < len(flat) else "")

    @F.pandas_udf(Ty.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


def block_text(t: Column, title: Column, md: Column, tex: Column, caption: Column, footnote: Column, ident: Column) -> Column:
    """The text a typed block contributes."""

    def e(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return (
        F.when(t.isin("section", "subsection"), e(title))
        .when(t == "example", F.trim(F.concat(F.lit("Example "), e(ident))))
        .when(t == "p", e(md))
        .when(t == "eq", F.when(e(tex) != "", F.concat(F.lit("$"), tex, F.lit("$"))).otherwise(""))
        .when(t == "fig", e(caption))
        .when(t == "table", F.trim(F.concat(e(caption), F.lit(" "), e(footnote))))
        .otherwise("")
    )
