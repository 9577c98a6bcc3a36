"""Patches guarded by content hashes, overrides, realignment, coverage; and answers aligned to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import numbers as N
from inkstrata.functions import text as T
from inkstrata.sources import merged


def anchor(**fields: Column) -> Column:
    """Eight hex digits of the SHA-1 of field names and squeezed texts in order of name; null fields are left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(name + chr(31)), T.squeeze(c))) for name, c in sorted(fields.items())]
    return F.left(F.sha1(F.concat_ws(chr(30), *parts)), F.lit(8))


def apply_patches(blocks: DataFrame, patches: DataFrame, keys: list[str], field: str, bilingual: bool = False) -> DataFrame:
    """Left join of sparse patches (keys, a, value); outcome says applied, legacy, blank, drift or none.

    A patch with a hash applies where the hash of the block is the same; one
    without applies where the block has text.  Bilingual output keeps the
    field and adds <field>_zh.
    """
    own = anchor(**{field: F.col(field)})
    j = blocks.join(patches.select(*keys, F.col("a").alias("_a"), F.col("value").alias("_v")), keys, "left")
    legacy = F.col("_a").isNull() & F.col("_v").isNotNull()
    has = T.squeeze(F.col(field)) != ""
    outcome = F.when(F.col("_v").isNull(), "none").when(legacy & has, "legacy").when(legacy, "blank").when(F.col("_a") == own, "applied").otherwise("drift")
    out = j.withColumn("outcome", outcome)
    use = F.col("outcome").isin("applied", "legacy")
    if bilingual:
        return out.withColumn(f"{field}_zh", F.when(use, F.col("_v"))).drop("_a", "_v")
    return out.withColumn(field, F.when(use, F.col("_v")).otherwise(F.col(field))).drop("_a", "_v")


def overlay_titles(base: DataFrame, overlay: DataFrame, keys: list[str], field: str) -> DataFrame:
    return base.join(overlay.select(*keys, F.col(field).alias("_o")), keys, "left").withColumn(field, F.coalesce("_o", field)).drop("_o")


def apply_overrides(base: DataFrame, overrides: DataFrame, keys: list[str], field: str, allow: list[str] | None = None) -> DataFrame:
    """Guarded replacement (keys, expect, new): applied, noop where it is already new, skip-drift where the guard differs."""
    rows = overrides.where(F.lit(field in allow)) if allow is not None else overrides
    j = base.join(rows.select(*keys, F.col("expect").alias("_e"), F.col("new").alias("_n")), keys, "left")
    now = F.trim(F.col(field))
    outcome = F.when(F.col("_n").isNull(), "none").when(now == F.trim("_n"), "noop").when(now == F.trim("_e"), "applied").otherwise("skip-drift")
    return j.withColumn("outcome", outcome).withColumn(field, F.when(F.col("outcome") == "applied", F.col("_n")).otherwise(F.col(field))).drop("_e", "_n")


def strict(applied: DataFrame) -> DataFrame:
    """Fail the job where a guard did not hold."""
    return applied.withColumn("outcome", F.when(F.col("outcome") == "skip-drift", F.raise_error(F.lit("override guard mismatch"))).otherwise(F.col("outcome")))


def replace_text(text: Column, old: Column, new: Column, every: Column) -> Column:
    """The first or every occurrence of old; unchanged if it does not occur."""
    at = F.locate(old, text) if isinstance(old, str) else F.instr(text, old)
    once = F.concat(F.left(text, at - 1), new, F.substr(text, at + F.length(old)))
    return F.when(at == 0, text).when(every, F.replace(text, old, new)).otherwise(once)


def merge_overrides(base: DataFrame, fresh: DataFrame, ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(merged by id, fresh wins; counts of added and replaced)."""
    kept = base.join(fresh.select(ident), ident, "left_anti")
    tally = fresh.join(base.select(ident, F.lit(1).alias("_old")).distinct(), ident, "left").agg(F.sum(F.when(F.col("_old").isNull(), 1).otherwise(0)).alias("added"), F.sum(F.coalesce("_old", F.lit(0))).alias("replaced"))
    return kept.unionByName(fresh), tally


def unique_match(blocks: DataFrame, wanted: DataFrame, keys: list[str], on: str, idx: str = "idx") -> DataFrame:
    """Rows of wanted whose value is that of exactly one block of the key; ambiguous ones get null."""
    once = blocks.groupBy(*keys, on).agg(F.min(idx).alias("match_idx"), F.max(idx).alias("_last"))
    return wanted.join(merged(once), [*keys, on], "left").withColumn("match_idx", F.when(F.col("_last") == F.col("match_idx"), F.col("match_idx"))).drop("_last")


def realign(patches: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """New places of stale patches: by hash, else by text; the first patch that claims a place has it.

    patches: keys, pid, a, english; blocks: keys, idx, text.  outcome: resolved,
    no_english, unmatched or dup.
    """
    here = blocks.withColumn("a", anchor(md=F.col("text"))).withColumn("_e", T.squeeze(F.col("text")))
    by_hash = unique_match(here, patches.withColumn("_e", T.squeeze(F.col("english"))), keys, "a").withColumnRenamed("match_idx", "_h")
    j = unique_match(here, by_hash, keys, "_e").withColumn("new_idx", F.coalesce("_h", F.when(F.col("_e") != "", F.col("match_idx"))))
    turn = F.row_number().over(Window.partitionBy(*keys, "new_idx").orderBy("pid"))
    outcome = F.when(F.col("new_idx").isNull(), F.when(F.col("_e") == "", "no_english").otherwise("unmatched")).when(turn > 1, "dup").otherwise("resolved")
    out = j.withColumn("outcome", outcome)
    return out.select(*patches.columns, F.when(F.col("outcome") == "resolved", F.col("new_idx")).alias("new_idx"), "outcome")


def coverage(units: DataFrame, done: DataFrame, keys: list[str], stem: str, content: Column) -> DataFrame:
    """Per stem and in total (null stem): translatable, translated, real_miss, empty_miss, ratio (one for nothing)."""
    j = units.withColumn("_c", content).join(done.select(*keys, F.lit(True).alias("_d")).distinct(), keys, "left")
    ok = F.coalesce("_d", F.lit(False))
    agg = j.rollup(stem).agg(
        F.count(F.lit(1)).alias("translatable"), F.count_if(ok).alias("translated"), F.count_if(~ok & F.col("_c")).alias("real_miss"), F.count_if(~ok & ~F.col("_c")).alias("empty_miss"), F.grouping(stem).alias("_g")
    )
    return agg.withColumn("ratio", F.when(F.col("translatable") == 0, 1.0).otherwise(F.round(F.col("translated") / F.col("translatable"), 6))).withColumn("is_total", F.col("_g") == 1).drop("_g")


def batches(units: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Consecutive units in batches of a size."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return units.withColumn("batch", F.floor(n / size).cast("long"))


def marked(text: Column) -> Column:
    """<<<n>>> blocks of a reply as a map, the last of a number wins."""
    parts = F.slice(F.split(text, "<<<(?=[0-9]+>>>)"), 2, 1 << 20)
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([0-9]+)>>>", 1).alias("key"), F.trim(F.regexp_replace(p, "^[0-9]+>>>", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def marker_faults(expected: Column, got: Column) -> Column:
    """Names of what is wrong with the markers of a reply: missing, surplus, empty."""
    keys = F.map_keys(got)
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_except(expected, keys)) > 0, "missing"), F.when(F.size(F.array_except(keys, expected)) > 0, "surplus"), F.when(F.exists(F.map_values(got), lambda v: v == ""), "empty")
        )
    )


def fill_only(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base, and those of fresh whose key base does not have."""
    return base.unionByName(fresh.join(base.select(*keys), keys, "left_anti"))


def align(problems: DataFrame, solutions: DataFrame, keys: list[str], num: str, dash: bool = False) -> DataFrame:
    """Problems with their solutions: left join on chapter and canonical number; no match clears an old solution."""
    key = N.dashed if dash else (lambda c: c)
    right = solutions.select(*keys, key(F.col(num)).alias("_k"), F.col("solution").alias("_s"))
    return problems.withColumn("_k", key(F.col(num))).join(right, [*keys, "_k"], "left").withColumn("solution", F.col("_s")).drop("_k", "_s")


def align_stats(aligned: DataFrame, keys: list[str]) -> DataFrame:
    return aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("problems"), F.count("solution").alias("matched")).withColumn("rate", F.round(F.col("matched") / F.col("problems"), 6))


def unmatched(solutions: DataFrame, problems: DataFrame, keys: list[str], num: str, dash: bool = False) -> DataFrame:
    key = N.dashed if dash else (lambda c: c)
    return solutions.withColumn("_k", key(F.col(num))).join(problems.select(*keys, key(F.col(num)).alias("_k")).distinct(), [*keys, "_k"], "left_anti").drop("_k")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extract_solutions(blocks: DataFrame, keys: list[str], order: str, chapter: str, problem: str, roman: bool = False) -> DataFrame:
    """Answer texts of a solutions book: chapters carried from anchors, blocks cut at every problem mark.

    chapter and problem are patterns whose first group is the number.  Text
    before a block's first mark belongs to the item before; later blocks join
    the item they follow; a repeated key keeps its last item.
    """
    raw = F.regexp_extract("text", chapter, 1)
    number = F.coalesce(raw.try_cast("int"), N.roman(raw)) if roman else raw.try_cast("int")
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_anchor = F.col("text").rlike(chapter) & number.isNotNull()
    chapters = blocks.withColumn("_a", is_anchor).withColumn("ch", F.last(F.when(is_anchor, number), True).over(run)).where("ch is not null and not _a").drop("_a")
    parts = F.split("text", f"(?={problem})")
    flat = chapters.select(*keys, "ch", order, F.posexplode(parts).alias("part", "seg")).where("trim(seg) <> ''")
    num = N.nullif_empty(F.regexp_extract("seg", f"^(?:{problem})", 1))
    line = Window.partitionBy(*keys, "ch").orderBy(order, "part").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("_new", num).withColumn("item", F.count("_new").over(line)).withColumn("num", F.last("_new", True).over(line)).where("num is not null")
    body = F.trim(F.regexp_replace("seg", f"^(?:{problem})", ""))
    items = flat.withColumn("seg", body).groupBy(*keys, "ch", "num", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seg") != "", F.struct(order, "part", "seg")))), lambda s: s["seg"]), "\n").alias("solution"))
    return last_wins(items, [*keys, "ch", "num"], ["item"]).drop("item")


def merge_gate(aligned: Column) -> Column:
    """Merging is blocked only where alignment was denied; unknown passes."""
    return aligned.eqNullSafe(F.lit(False))


def monotone_progress(old: Column, new: Column) -> Column:
    return F.greatest(F.coalesce(old, F.lit(0.0)), F.coalesce(new, F.lit(0.0)))


def locate_quote(text: Column, before: Column, quote: Column, after: Column) -> Column:
    """1-based place of a quote with its context, else of its first occurrence; 0 where it is orphaned."""
    whole = F.concat(F.coalesce(before, F.lit("")), quote, F.coalesce(after, F.lit("")))
    at = F.instr(text, whole)
    return F.when(at > 0, at + F.length(F.coalesce(before, F.lit("")))).otherwise(F.instr(text, quote))
