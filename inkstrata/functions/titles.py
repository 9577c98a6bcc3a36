"""Titles, authors, editions and their comparison, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, companion and volume patterns, ordinal words.
TITLE_STOP = ["the", "a", "an", "of", "and", "for", "to", "in", "on", "with", "vol", "volume", "edition", "ed"]
COMPANION = r"(?i)\b(?:study\s+guide|solutions?\s+manual|instructor|workbook|lab(?:oratory)?\s+manual|test\s+bank|in\s+focus)\b"
ROMAN_2_TO_30 = "xxx|xxix|xxviii|xxvii|xxvi|xxv|xxiv|xxiii|xxii|xxi|xx|xix|xviii|xvii|xvi|xv|xiv|xiii|xii|xi|x|ix|viii|vii|vi|v|iv|iii|ii"
LATER_VOLUME = rf"(?i)\b(?:vol(?:ume)?|part)\.?\s*(?:[2-9]|[1-9][0-9]|{ROMAN_2_TO_30})\b"
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
VARIANTS = ["international", "global", "asian", "si", "student", "instructor"]
MATCH_STOP = ["a", "an", "the", "of", "to", "and", "in", "for", "on", "with", "its", "introduction", "intro", "principles", "fundamentals", "course", "first", "edition", "vol", "volume", "modern", "elementary", "applied", "theory"]
NAME_DROP = ["and", "jr", "iii", "von", "van", "der", "den", "del"]
SOLUTION = r"(?i)\b(?:solutions?\s+manual|instructor'?s?\s+(?:solutions?|manual)|answer\s+key|\[solutions?\]|solution\s+manual|solutions?\s+to)\b"
OVERLAP_MIN = 0.34


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*TITLE_STOP)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; null if either is empty."""
    x, y = title_tokens(a), title_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def mismatch(a: Column, b: Column) -> Column:
    o = overlap(a, b)
    return F.when(o < OVERLAP_MIN, F.concat(F.lit("title_mismatch("), F.round(o * 100, 0).cast("long").cast("string"), F.lit("%)")))


def companion(c: Column) -> Column:
    return F.when(text(c).rlike(COMPANION), F.lit("companion"))


def is_solution(c: Column) -> Column:
    return text(c).rlike(SOLUTION)


def partial_source(numbers: Column, title: Column) -> Column:
    """First chapter above 1 unless the title names a later volume."""
    first = F.array_min(F.filter(numbers, lambda n: n.isNotNull()))
    return F.when((first > 1) & ~text(title).rlike(LATER_VOLUME), F.concat(F.lit("partial_source(starts@"), first.cast("string"), F.lit(")")))


def chapter_gaps(numbers: Column, most: int = 3) -> Column:
    """Neighbouring chapter numbers that differ by more than `most`."""
    n = F.array_sort(F.filter(numbers, lambda x: x.isNotNull()))
    pairs = F.zip_with(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: F.when(b - a > most, F.concat(a.cast("string"), F.lit("->"), b.cast("string"))))
    wide = F.array_compact(pairs)
    return F.when(F.size(wide) > 0, F.concat(F.lit("chapter_gap("), F.array_join(wide, ","), F.lit(")")))


def normal_title(c: Column) -> Column:
    """Up to the first subtitle separator, letters and digits only, squeezed."""
    cut = F.regexp_extract(text(c), r"(?s)^(.*?)(?::| — | \(|\(|,|\. |\z)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9 ]", " "), r"\s+", " "))


def name_tokens(c: Column, drop: list[str] = NAME_DROP) -> Column:
    words = F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower))
    return F.filter(words, lambda w: ~w.isin(*drop)) if drop else words


def surname(c: Column, drop: list[str] = NAME_DROP) -> Column:
    """Last name token of the first author."""
    first = F.element_at(F.split(text(c), "[,&]", 2), 1)
    words = F.filter(F.transform(F.regexp_extract_all(first, F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower), lambda w: ~w.isin(*drop))
    return F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(F.lit(""))


def confidence(title: Column, author: Column, found_title: Column, found_author: Column, stop: list[str] = MATCH_STOP) -> Column:
    """0.6 of the share of title tokens found, 0.4 if any author name is found as a word."""

    def long_tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*stop)))

    want = long_tokens(title)
    share = F.size(F.array_intersect(want, long_tokens(found_title))) / F.greatest(F.size(want), F.lit(1))
    hay = F.regexp_extract_all(F.lower(F.concat_ws(" ", text(found_author), text(found_title))), F.lit("[a-z0-9_]+"), F.lit(0))
    hit = F.arrays_overlap(name_tokens(author), hay).cast("double")
    return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.round(0.6 * share + 0.4 * F.coalesce(hit, F.lit(0.0)), 3))


def suitability(size: Column, extension: Column, publisher: Column, year: Column, interest: Column, pages: Column) -> Column:
    """Additive score of a candidate file."""
    # The weights and bounds of the score.
    mb = F.coalesce(size, F.lit(0)) / 1e6
    y, i = F.coalesce(year.try_cast("int"), F.lit(0)), F.coalesce(interest.try_cast("double"), F.lit(0.0))
    return (
        F.when(F.lower(text(extension)) == "pdf", 10.0).otherwise(0.0)
        + F.when(mb.between(3, 80), 5.0).when((mb >= 1.5) & (mb <= 150), 1.0).when(mb < 1.5, -3.0).otherwise(0.0)
        + F.when(text(publisher) != "", 2.0).otherwise(0.0)
        + F.when(y >= 2000, F.least((y - 2000) / 10, F.lit(2.0))).otherwise(0.0)
        + F.least(i / 2, F.lit(2.5))
        + F.when(F.coalesce(pages, F.lit(0)) > 50, 1.0).otherwise(0.0)
    )


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def edition(c: Column) -> Column:
    """4 -> 4th, Seventh International Edition -> 7th International; what cannot be read stays; empty is null."""
    s = F.trim(c)
    words = F.filter(F.transform(F.split(F.lower(s), r"\s+"), lambda t: F.regexp_replace(t, "[,.]+$", "")), lambda t: t != "edition")
    numbers = F.array_compact(
        F.transform(words, lambda t: F.when(F.array_contains(F.array(*map(F.lit, ORDINALS)), t), F.array_position(F.array(*map(F.lit, ORDINALS)), t).cast("int")).when(t.rlike(r"^\d+(st|nd|rd|th)?$"), F.regexp_extract(t, r"^(\d+)", 1).cast("int")))
    )
    kinds = F.filter(words, lambda t: t.isin(*VARIANTS))
    kind = F.when(F.size(kinds) > 0, F.concat(F.lit(" "), F.when(F.element_at(kinds, -1) == "si", "SI").otherwise(F.initcap(F.element_at(kinds, -1))))).otherwise("")
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(s.rlike(r"^\d+$"), ordinal(s.try_cast("int")))
        .when(s.rlike(r"^\d+(st|nd|rd|th)( (International|Global|Asian|SI|Student|Instructor))?$"), s)
        .when(F.size(numbers) > 0, F.concat(ordinal(F.element_at(numbers, -1)), kind))
        .otherwise(c)
    )


def author(c: Column) -> Column:
    """Names joined by semicolons."""
    s = F.regexp_replace(F.trim(c), r"\s+and\s+", "; ")
    return F.when(s.contains(", ") & ~s.contains("; "), F.replace(s, F.lit(", "), F.lit("; "))).otherwise(s)


def metadata_faults(subject: Column, subjects: list[str], ed: Column, who: Column) -> Column:
    """Names of the vocabulary and pattern rules that a record breaks."""
    return F.array_compact(
        F.array(
            F.when(subject.isNull(), "subject_missing").when(~subject.isin(*subjects), "subject_unknown"),
            F.when(ed.isNotNull() & ~ed.rlike(r"^\d+(st|nd|rd|th)( \w+)?$"), "edition_pattern"),
            F.when(who.contains(", "), "author_comma"),
            F.when(who.contains(" and "), "author_and"),
        )
    )
