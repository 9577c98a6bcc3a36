"""Catalogue numbers, captions, formula labels and small scalar conversions, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstrata.functions.text import plain_text

# Fixed value: a catalogue number such as 1.4, A2.10-3b.
NUMBER = r"[A-Z]?\d+[A-Z]?(?:[.\-–—]\d+)+(?:[A-Za-z](?![A-Za-z]))?"
FALLBACK = r"^(?:fig|tbl)-(?:ch\d{2,}|app[^-]+)(?:-|$)"


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def canonical(c: Column) -> Column:
    """Dash variants become dots."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\-–—]", ".")


def canonical_id(c: Column) -> Column:
    """fig-/tbl- ids with a canonical number; positional ids stay."""
    return F.when(c.rlike("^(fig|tbl)-") & ~c.rlike(FALLBACK), F.concat(F.left(c, F.lit(4)), F.regexp_replace(F.substr(c, F.lit(5)), r"[\-–—]", "."))).otherwise(c)


def parent(c: Column) -> Column:
    """The number without one trailing letter after a digit; null if there is none."""
    return nullif_empty(F.regexp_extract(canonical(c), r"^(.+\d)[a-zA-Z]$", 1))


def figure_id(caption: Column) -> Column:
    n = F.regexp_extract(F.trim(caption), rf"(?i)\bFig(?:ure|\.)?\s*({NUMBER})", 1)
    return F.when(n != "", F.concat(F.lit("fig-"), canonical(n)))


def table_id(caption: Column) -> Column:
    n = F.regexp_extract(F.trim(caption), rf"(?i)\b(?:Table|Tab\.?)\s*({NUMBER})", 1)
    return F.when(n != "", F.concat(F.lit("tbl-"), canonical(n)))


def references(kind: str, text: Column) -> Column:
    """All canonical figure or table numbers that a text refers to, in order."""
    word = r"(?:Fig\.?|Figure)" if kind == "figure" else r"(?:Tab\.?|Table)"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b{word}\s+({NUMBER})"), F.lit(1)), canonical)


def caption_labels(caption: Column) -> Column:
    """Labels of a caption that begins with one: struct(type, prefix, num, display) each with the text up to the next."""
    label = rf"\b(?:Fig(?:ure|\.)?|Table|Tab\.?)\s*{NUMBER}"
    parts = F.split(F.ltrim(F.coalesce(caption, F.lit(""))), rf"(?i)(?={label})")
    own = F.filter(parts, lambda p: p.rlike(rf"(?i)^{label}"))

    def one(p: Column) -> Column:
        fig = p.rlike("(?i)^fig")
        num = canonical(F.regexp_extract(p, rf"(?i)^\w+\.?\s*({NUMBER})", 1))
        tail = plain_text(F.regexp_replace(F.regexp_replace(p, rf"(?i)^{label}", ""), r"^[ .:：\-–—\n\t]+|[ .:：\-–—\n\t]+$", ""))
        name = F.concat(F.when(fig, F.lit("Figure ")).otherwise(F.lit("Table ")), num)
        return F.struct(
            F.when(fig, F.lit("figure")).otherwise(F.lit("table")).alias("type"),
            F.when(fig, F.lit("fig")).otherwise(F.lit("tbl")).alias("prefix"),
            num.alias("num"),
            F.when(tail != "", F.concat(name, F.lit(": "), tail)).otherwise(name).alias("display"),
        )

    return F.when(F.ltrim(F.coalesce(caption, F.lit(""))).rlike(rf"(?i)^{label}"), F.transform(own, one)).otherwise(F.array().cast("array<struct<type:string,prefix:string,num:string,display:string>>"))


def strip_display(raw: Column) -> Column:
    """Without one $$…$$ wrapper."""
    t = F.trim(raw)
    return F.when(t.rlike(r"(?s)^\$\$\s*\n?(.*?)\n?\s*\$\$\s*$"), F.trim(F.regexp_extract(t, r"(?s)^\$\$\s*\n?(.*?)\n?\s*\$\$\s*$", 1))).otherwise(t)


def equation_label(tex: Column) -> Column:
    return nullif_empty(F.trim(F.regexp_extract(tex, r"\\tag\*?\s*\{([^{}]+)\}", 1)))


def without_label(tex: Column) -> Column:
    return F.trim(F.regexp_replace(tex, r"\\tag\*?\s*\{([^{}]+)\}", ""))


def roman(c: Column) -> Column:
    """Value of a Roman numeral; null for anything else."""
    s = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

    def v(x: Column) -> Column:
        return F.coalesce(*[F.when(x == k, F.lit(n)) for k, n in value.items()], F.lit(0))

    acc = F.aggregate(
        F.split(F.reverse(s), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")),
        lambda a, x: F.struct((a["sum"] + F.when(v(x) < a["top"], -v(x)).otherwise(v(x))).alias("sum"), F.greatest(a["top"], v(x)).alias("top")),
    )
    return F.when(s.rlike("^[IVXLCDM]+$") & (acc["sum"] != 0), acc["sum"])


def leading_int(c: Column) -> Column:
    """Integer before the first dot or dash."""
    return F.element_at(F.split(c, r"[.\-]"), 1).try_cast("int")


def dashed(c: Column) -> Column:
    return F.regexp_replace(c, r"[.\-]", "-")


def number_key(c: Column) -> Column:
    """N.M[a] as (N, M, letter ordinal)."""
    m = r"^(\d+)\.(\d+)([A-Za-z]?)$"
    return F.when(c.rlike(m), F.struct(F.regexp_extract(c, m, 1).cast("int").alias("a"), F.regexp_extract(c, m, 2).cast("int").alias("b"), F.when(F.regexp_extract(c, m, 3) == "", 0).otherwise(F.ascii(F.lower(F.regexp_extract(c, m, 3))) - 96).alias("c")))


def number_tuple(c: Column) -> Column:
    """1.2.10 as [1, 2, 10], which compares piece by piece."""
    return F.transform(F.split(c, r"[.\-]"), lambda x: x.try_cast("int"))


def slugify(c: Column, most: int = 32) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def elapsed(c: Column) -> Column:
    """[[dd-]hh:]mm:ss as seconds."""
    m = r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$"
    part = [F.coalesce(nullif_empty(F.regexp_extract(F.trim(c), m, k)).cast("long"), F.lit(0)) for k in (1, 2, 3, 4)]
    return F.when(F.trim(c).rlike(m), part[0] * 86400 + part[1] * 3600 + part[2] * 60 + part[3])


def span_text(seconds: Column) -> Column:
    """Seconds as s, m or h."""
    return F.when(seconds < 90, F.concat(F.round(seconds, 0).cast("long").cast("string"), F.lit("s"))).when(seconds < 5400, F.concat(F.round(seconds / 60, 0).cast("long").cast("string"), F.lit("m"))).otherwise(
        F.concat(F.round(seconds / 3600, 1).cast("string"), F.lit("h"))
    )


def human_bytes(n: Column) -> Column:
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.concat(F.round(n / 1024.0**k, 1).cast("string"), F.lit(unit))
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), text) if out is None else out.when((F.abs(n) < 1024.0 ** (k + 1)) | F.lit(unit == "TB"), text)
    return out


def clamp_step(v: Column, fallback: int, low: int = 1, high: int = 10) -> Column:
    return F.when(v.isNull(), F.lit(fallback)).otherwise(F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def nearest_index(values: Column, v: Column) -> Column:
    """0-based index of the value nearest to v, the first of equals."""
    gap = F.transform(values, lambda x: F.abs(x - v))
    return (F.array_position(gap, F.array_min(gap)) - 1).cast("long")
