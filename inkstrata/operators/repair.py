"""Repair of catalogue metadata: references near a visual, precedence of sources, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import numbers as N
from inkstrata.functions import text as T
from inkstrata.sources import merged

WINDOW = 3
GOOD = 16
WORD = {"fig": r"(?:Figure|Fig\.?)", "table": r"(?:Table|Tbl\.?|Tab\.?)"}


def reference(kind: str, text: Column) -> Column:
    """struct(num, caption) of the first reference of the kind in a text, and what follows it."""
    p = rf"(?is)\b{WORD[kind]}\s+({N.NUMBER})[ .:\-–—\n\t]*(.*)$"
    return F.when(F.coalesce(text, F.lit("")).rlike(p), F.struct(N.canonical(F.regexp_extract(text, p, 1)).alias("num"), N.nullif_empty(T.squeeze(F.regexp_extract(text, p, 2))).alias("caption")))


def leading_reference(text: Column) -> Column:
    """struct(kind, num, caption) of a text that begins with a figure or table reference."""
    fig, tab = (F.ltrim(F.coalesce(text, F.lit(""))).rlike(rf"(?i)^{w}\s+{N.NUMBER}") for w in WORD.values())
    one = {k: reference(k, text) for k in WORD}
    return F.when(fig, F.struct(F.lit("fig").alias("kind"), one["fig"]["num"].alias("num"), one["fig"]["caption"].alias("caption"))).when(tab, F.struct(F.lit("table").alias("kind"), one["table"]["num"].alias("num"), one["table"]["caption"].alias("caption")))


def score(kind: str, text: Column, distance: Column) -> Column:
    """Nearer texts and texts that begin with the word of the kind score higher."""
    word = "figure" if kind == "fig" else "table"
    low = F.lower(F.trim(text))
    return F.when(low.startswith(word), 12).otherwise(0) + F.when(low.rlike(rf"^\(?{word}"), 6).otherwise(0) + F.greatest(F.lit(0), 8 - 2 * distance)


def context(visuals: DataFrame, texts: DataFrame, keys: list[str], kind: str, window: int = WINDOW) -> DataFrame:
    """The reference a visual takes from the texts around it.

    Texts are met by distance, the one before a visual first; the first that
    scores GOOD is taken, else the best.  visuals: keys, idx; texts: keys, idx, text.
    """
    near = visuals.select(*keys, "idx", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d")).select(*keys, "idx", "d", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumn("at", F.col("idx") + F.col("d") * F.col("side"))
    # at distance 4 a score holds no nearness: what the text alone says is judged once a text
    said = texts.withColumn("r", reference(kind, F.col("text"))).where("r is not null").select(*keys, F.col("idx").alias("at"), "r", score(kind, F.col("text"), F.lit(4)).alias("_own"))
    j = merged(near).join(said, [*keys, "at"]).withColumn("score", F.col("_own") + F.greatest(F.lit(0), 8 - 2 * F.col("d"))).drop("_own")
    place = F.col("d") * 2 + (F.col("side") > 0).cast("int")
    first = F.when(F.col("score") >= GOOD, F.struct(F.lit(0), place))
    rank = F.coalesce(first, F.struct(1000 - F.col("score"), place))
    w = Window.partitionBy(*keys, "idx").orderBy(rank)
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "idx", "r.num", "r.caption", "score")


def needs_repair(caption: Column, ident: Column, excluded: Column, text: Column) -> Column:
    """No caption, no id, a positional id; an excluded block only if it names its own number."""
    own = leading_reference(text).isNotNull()
    blank = (F.trim(F.coalesce(caption, F.lit(""))) == "") | (F.trim(F.coalesce(ident, F.lit(""))) == "") | F.coalesce(ident.rlike(N.FALLBACK), F.lit(False))
    return F.when(excluded.isNotNull(), own).otherwise(blank)


def repaired(kind: str, own: Column, near: Column, ident: Column, caption: Column, made: Column) -> tuple[Column, Column, Column]:
    """(id, caption, source): own reference, then context, then a semantic id, else a generated caption."""
    prefix = "fig-" if kind == "fig" else "tbl-"
    keep = F.when(~F.coalesce(ident.rlike(N.FALLBACK), F.lit(True)), ident)
    new = F.coalesce(F.concat(F.lit(prefix), own["num"]), F.concat(F.lit(prefix), near["num"]), keep)
    source = F.when(own["num"].isNotNull(), "self").when(near["num"].isNotNull(), "context").when(keep.isNotNull(), "id").otherwise("generated")
    return new, F.coalesce(own["caption"], near["caption"], N.nullif_empty(caption), made), source


def made_caption(kind: str, source: Column, num: Column, ordinal: Column) -> Column:
    """A caption for a visual of a problem or solution that has none."""
    word = F.lit("Figure" if kind == "fig" else "Table")
    return F.when(source.isin("problem", "solution"), F.concat(word, F.lit(" "), ordinal.cast("string"), F.lit(" of "), source, F.lit(" "), num))


def local_candidates(wanted: DataFrame, visuals: DataFrame, keys: list[str]) -> DataFrame:
    """A chapter-local number (3.12 as 12), else its number without a letter."""
    local = wanted.withColumn("_l", N.nullif_empty(F.regexp_extract("target", r"^[^.\-]+[.\-](.+)$", 1))).withColumn("_p", F.regexp_replace("_l", "[A-Za-z]$", ""))
    own = visuals.where("num is not null").groupBy(*keys, "num").agg(F.min("pos").alias("pos"))
    a = local.join(merged(own.withColumnRenamed("num", "_l").withColumnRenamed("pos", "_a")), [*keys, "_l"], "left")
    b = a.join(merged(own.withColumnRenamed("num", "_p").withColumnRenamed("pos", "_b")), [*keys, "_p"], "left")
    return b.select(*keys, "target", F.coalesce("_a", "_b").alias("pos")).where("pos is not null")


def with_alias(aliases: Column, kind: Column, ref: Column, source: Column) -> Column:
    """The alias array with one more entry, unless it is there."""
    one = F.struct(kind.alias("type"), ref.alias("id"), source.alias("source"))
    have = F.coalesce(aliases, F.array().cast("array<struct<type:string,id:string,source:string>>"))
    return F.when(F.exists(have, lambda a: (a["type"] == kind) & (a["id"] == ref)), have).otherwise(F.concat(have, F.array(one)))


def distinct_refs(rows: DataFrame, keys: list[str], ref: str, pos: str) -> DataFrame:
    """Distinct references in the order of their first place."""
    first = rows.groupBy(*keys, ref).agg(F.min(pos).alias(pos))
    return first.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
