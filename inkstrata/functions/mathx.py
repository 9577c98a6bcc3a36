"""Formula text: regions, repair rules, skeletons, error classes.

What a regular expression says is a native column.  Region scanning and brace
matching need a stack, so they are Arrow functions; apply them to distinct texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Control words, primitives and wrappers that carry no content.
CONTROL = r"\\[a-zA-Z@]+"
WRAPPERS = (
    r"\\(?:math(?:rm|bf|it|sf|tt|cal|frak|bb|scr|normal)|boldsymbol|pmb|mathversion|text(?:rm|bf|it|sf|tt|normal|up|sc|md|color)?|mbox|hbox|operatorname|mathop"
    r"|left|right|middle|bigl|bigr|Bigl|Bigr|biggl|biggr|Biggl|Biggr|big|Big|bigg|Bigg|displaystyle|textstyle|scriptstyle|scriptscriptstyle|limits|nolimits"
    r"|begin|end|phantom|hphantom|vphantom|smash|strut|mathstrut|null|substack|hspace|vspace|kern|mkern|mskip|raisebox|quad|qquad|space|nobreakspace|thinspace|negthinspace|medspace|thickspace)\b"
)
PRIMITIVES = r"\\(?:let|def|edef|gdef|xdef|catcode|relax|csname|expandafter|futurelet|newcommand|renewcommand|providecommand)\b"
DELIMITERS = [("$$", "$$"), ("\\(", "\\)"), ("\\[", "\\]")]


def regions(text: str, slashes: bool = True, close_open: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, inner) of $, $$ and, with slashes, \\( \\[ regions.

    Inline dollars may not span a line.  An unclosed display region runs to the
    end with close_open, and else ends the scan.
    """
    token = re.compile(r"\$\$|\$|\\\(|\\\[" if slashes else r"\$\$|\$")
    out, at = [], 0
    while m := token.search(text, at):
        opener = m.group()
        if opener == "$":
            stop = text.find("$", m.end())
            if stop < 0 or "\n" in text[m.end() : stop]:
                at = m.end()
                continue
            out.append((m.start(), stop + 1, text[m.end() : stop]))
            at = stop + 1
            continue
        closer = {"$$": "$$", "\\(": "\\)", "\\[": "\\]"}[opener]
        stop = text.find(closer, m.end())
        if stop < 0:
            if close_open:
                out.append((m.start(), len(text), text[m.start() :]))
            break
        out.append((m.start(), stop + 2, text[m.end() : stop]))
        at = stop + 2
    return out


def spans(text: str | None) -> list[str]:
    return [s for _, _, inner in regions(text or "") if (s := inner.strip())]


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def math_spans(s: pd.Series) -> pd.Series:
    return s.map(spans)


REGIONS = Ty.ArrayType(Ty.StructType([Ty.StructField("start", Ty.IntegerType()), Ty.StructField("stop", Ty.IntegerType()), Ty.StructField("inner", Ty.StringType()), Ty.StructField("display", Ty.BooleanType())]))


@F.pandas_udf(REGIONS)
def math_regions(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"start": a, "stop": b, "inner": x.strip(), "display": t.startswith(("$$", "\\["), a)} for a, b, x in regions(t or "") if x.strip()])


@F.pandas_udf(Ty.StringType())
def outside_math(s: pd.Series) -> pd.Series:
    """The text with its formula regions cut out."""

    def one(t: str | None) -> str:
        out, at = [], 0
        for a, b, inner in regions(t or ""):
            if inner.strip():
                out.append(t[at:a])
                at = b
        return "".join([*out, (t or "")[at:]])

    return s.map(one)


def leaks_tex(text: Column) -> Column:
    return outside_math(text).rlike(r"\\[A-Za-z]+")


def delimiter_fault(text: Column) -> Column:
    """Which delimiters of a text do not pair up; null if all do."""
    n = {d: F.regexp_count(text, F.lit(re.escape(d))) for d in ("$$", "\\(", "\\)", "\\[", "\\]")}
    return (
        F.when(n["$$"] % 2 == 1, "unbalanced display dollar")
        .when(F.regexp_count(text, F.lit(r"(?<!\$)\$(?!\$)")) % 2 == 1, "unbalanced inline dollar")
        .when(n["\\("] != n["\\)"], "unbalanced parenthesis delimiter")
        .when(n["\\["] != n["\\]"], "unbalanced bracket delimiter")
    )


def left_right_fault(expr: Column) -> Column:
    a, b = F.regexp_count(expr, F.lit(r"\\left\b")), F.regexp_count(expr, F.lit(r"\\right\b"))
    return F.when(a != b, F.concat(F.lit("left="), a.cast("string"), F.lit(" right="), b.cast("string")))


def canonical_span(c: Column) -> Column:
    """Without white space and outer punctuation."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"^[.,;:，。；：、()\[\]{}（）]+|[.,;:，。；：、()\[\]{}（）]+$", "")


def skeleton(tex: Column) -> Column:
    """Control sequences and structure characters; every run of anything else that is not blank is one dot."""
    parts = F.regexp_extract_all(F.coalesce(tex, F.lit("")), F.lit(r"(?s)\\[a-zA-Z@]+|\\.|\\$|[\^_{}&]|[^\\\^_{}&]+"), F.lit(0))
    kept = F.filter(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    return F.array_join(F.transform(kept, lambda p: F.when(p.rlike(r"^[\\\^_{}&]"), p).otherwise("·")), " ")


def control_words(tex: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(tex, F.lit("")), F.lit(CONTROL), F.lit(0)))


def macro(err: Column) -> Column:
    m = F.regexp_extract(err, r"[Uu]ndefined control sequence\s*(\\[A-Za-z@]+|\\.)", 1)
    return F.when(m != "", m)


def category(err: Column) -> Column:
    """Class of a renderer's message; the first that fits."""
    e = F.lower(F.coalesce(err, F.lit("")))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | e.contains(w)
        return out

    # Words of the renderer's messages, in order of precedence.
    return (
        F.when(macro(err).isNotNull(), "undefined_macro")
        .when(has("double superscript", "double subscript", "double exponent"), "double_script")
        .when(has("missing $", "math mode", "math-mode", "not properly terminated", "only be used in math", "in restricted"), "math_mode")
        .when(has("extra alignment", "misplaced alignment", "no more columns"), "alignment")
        .when(has("missing {", "missing }", "extra }", "extra close brace", "argument"), "missing_brace")
        .when(has("\\left", "\\right"), "left_right")
        .otherwise("other")
    )


def semantic_fault(new: Column) -> Column:
    """tex_primitive or empty_shell for a replacement that must not be taken; null if it may."""
    s = F.trim(F.coalesce(new, F.lit("")))
    s = F.regexp_replace(s, r"(?s)^(?:\$\$(.*)\$\$|\\\[(.*)\\\]|\\\((.*)\\\)|\$(.*)\$)$", "$1$2$3$4")
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, WRAPPERS, ""), CONTROL, "§"), r"[\^_{}&~\\,;:!\s]", "")
    return F.when(s.rlike(PRIMITIVES), "tex_primitive").when(core == "", "empty_shell")


def _group(tex: str, at: int) -> int:
    """End (exclusive) of the balanced group that opens at `at`, or -1."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(tex, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            return m.end()
    return -1


def _rewrite_groups(tex: str, opener: str, change) -> str:
    """Apply change(head, body) to each command with a braced group; a None leaves it as it stands."""
    out, at = [], 0
    for m in re.compile(opener).finditer(tex):
        if m.start() < at:
            continue
        stop = _group(tex, m.end() - 1)
        if stop < 0:
            continue
        new = change(m.group(), tex[m.end() : stop - 1])
        if new is not None:
            out += [tex[at : m.start()], new]
            at = stop
    return "".join([*out, tex[at:]])


def _tag(head: str, body: str) -> str | None:
    if "$" not in body:
        return None
    bare = re.sub(r"(?<!\\)\$", "", body)
    return head + (f"${bare}$" if re.search(r"[\^_]|\\[A-Za-z]", bare) else bare) + "}"


def _slash(head: str, body: str) -> str | None:
    s = body.strip()
    return "/" if s.startswith(("\\left/", "/")) and "\\vphantom" in s and re.search(r"\\kern\s*-\s*\\?delimiterspace", s) else None


def _angle(head: str, body: str) -> str | None:
    s = body.strip()
    while s.startswith("{") and _group(s, 0) == len(s):
        s = s[1:-1].strip()
    if not s.startswith("\\left/") or "\\left." not in s or "\\right." not in s or "\\vphantom" in s or "delimiterspace" in s:
        return None
    angle = s[6:].replace("\\left.", "").replace("\\right.", "").strip()
    return "\\underline{\\angle " + angle + "}" if angle else None


def _fixpoint(tex: str, *rules: tuple[str, str]) -> str:
    before = None
    while before != tex:
        before = tex
        for pattern, new in rules:
            tex = re.sub(pattern, new, tex)
    return tex


def normalize(tex: str | None) -> str | None:
    """Idempotent repair of a bare formula: tags, doubled scripts, conditional times, group noise, slash and angle residues, delimiters."""
    if not tex:
        return tex
    tex = _rewrite_groups(tex, r"\\tag\*?\s*\{", _tag)
    tex = _fixpoint(tex, (r"\^\{([^{}]*)\}\^\{([^{}]*)\}", r"^{\1 \2}"), (r"_\{([^{}]*)\}_\{([^{}]*)\}", r"_{\1 \2}"))
    tex = re.sub(r"\\ifmmode\s*\\times\s*\\else\s*\\texttimes\s*\\fi", r"\\times", tex)
    if re.search(r"\\(?:bgroup|egroup|aftergroup)", tex):
        tex = _fixpoint(tex, (r"\\mathopen\s*\{\s*\}\s*\\mathclose\s*\\bgroup", ""), (r"\\mathclose\s*\\bgroup", ""), (r"\\(?:aftergroup|bgroup|egroup)", ""))
    tex = _rewrite_groups(tex, r"\\math(?:ord|bin)\s*\{", _slash)
    tex = _rewrite_groups(tex, r"\\underline\s*\{", _angle)
    return tex.replace("\\[", "").replace("\\]", "").replace("\\(", "(").replace("\\)", ")")


def normalize_inline(md: str | None) -> str | None:
    """The same inside dollar regions only."""
    if not md or "$" not in md:
        return md
    out, at = [], 0
    for a, b, inner in regions(md, slashes=False, close_open=False):
        mark = "$$" if md.startswith("$$", a) else "$"
        out += [md[at:a], mark, normalize(inner), mark]
        at = b
    return "".join([*out, md[at:]])


@F.pandas_udf(Ty.StringType())
def normalize_tex(s: pd.Series) -> pd.Series:
    return s.map(normalize)


@F.pandas_udf(Ty.StringType())
def normalize_md(s: pd.Series) -> pd.Series:
    return s.map(normalize_inline)


def needs_repair(tex: Column) -> Column:
    """A cheap test that spares most texts the Arrow function."""
    return tex.rlike(r"\\tag|\}[\^_]\{|\\ifmmode|group|\\math(?:ord|bin)|\\underline|\\[\[\]()]")


def normalized(tex: Column) -> Column:
    return F.when(needs_repair(tex), normalize_tex(tex)).otherwise(tex)
