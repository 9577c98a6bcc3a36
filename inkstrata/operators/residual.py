"""Formulas corpus-wide: collection, findings, clusters, signals, diffs and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import mathx as M


def units(blocks: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per non-blank text field of each block."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return blocks.select(*keys, F.inline(F.filter(pairs, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")))


def formulas(rows: DataFrame, locator: str, most: int = 1000) -> DataFrame:
    """tex, display, occ and the first locators of each distinct formula."""
    return rows.groupBy("tex", "display").agg(F.count(F.lit(1)).alias("occ"), F.slice(F.array_sort(F.collect_set(locator)), 1, most).alias("locators"))


def judged(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Formulas with the renderer's verdict (tex, display, ok, err); formulas without one stay unknown."""
    return found.join(verdicts, ["tex", "display"], "left").withColumn("category", F.when(F.col("ok").eqNullSafe(F.lit(False)), M.category(F.col("err")))).withColumn("macro", M.macro(F.col("err")))


def book_report(rows: DataFrame, slug: str = "slug") -> DataFrame:
    bad = F.col("ok").eqNullSafe(F.lit(False))
    return rows.groupBy(slug).agg(F.sum("occ").alias("spans_total"), F.count(F.lit(1)).alias("unique_n"), F.count_if(bad).alias("bad_unique"), F.sum(F.when(bad, F.col("occ")).otherwise(0)).alias("bad_occ"))


def groups(findings: DataFrame) -> DataFrame:
    """Findings of all books by formula: total occurrences and books."""
    return findings.groupBy("tex", "display").agg(F.sum("occ").alias("total_occ"), F.count_distinct("slug").alias("books"))


def clusters(findings: DataFrame, examples: int = 3) -> DataFrame:
    """By category and by macro or skeleton: occurrences, distinct formulas, books, first examples."""
    keys = ["category", "signature"]
    found = findings.withColumn("signature", F.coalesce("macro", M.skeleton(F.col("tex"))))
    sums = found.groupBy(*keys).agg(F.sum("occ").alias("total_occ"), F.count_distinct("tex").alias("uniques"), F.count_distinct("slug").alias("books"))
    # only the first of each cluster leave their tasks, so no cluster is gathered whole
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("tex"))
    first = found.select(*keys, "tex").distinct().withColumn("_n", place).where(F.col("_n") <= examples)
    return sums.join(first.groupBy(*keys).agg(F.array_sort(F.collect_list("tex")).alias("examples")), keys, "left")


def token_signals(findings: DataFrame) -> DataFrame:
    """Per control word: distinct formulas, occurrences, books; a word counts once in a formula."""
    flat = findings.select("slug", "tex", "occ", F.explode(M.control_words(F.col("tex"))).alias("token"))
    return flat.groupBy("token").agg(F.count_distinct("tex").alias("uniques"), F.sum("occ").alias("occ"), F.count_distinct("slug").alias("books"))


def span_counts(rows: DataFrame, keys: list[str], span: Column) -> DataFrame:
    """Multiset of canonical spans of each unit."""
    return rows.withColumn("span", M.canonical_span(span)).where("span <> ''").groupBy(*keys, "span").agg(F.count(F.lit(1)).alias("n"))


def containment(source: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """contains: the overlay has every source span as often; extra: it has some span more often."""
    j = source.withColumnRenamed("n", "_s").join(overlay.withColumnRenamed("n", "_o"), [*keys, "span"], "full").na.fill(0, ["_s", "_o"])
    return j.groupBy(*keys).agg(F.bool_and(F.col("_o") >= F.col("_s")).alias("contains"), F.bool_or(F.col("_o") > F.col("_s")).alias("extra"))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """fixed, collateral or still_bad for every bad place of either report."""
    j = before.select(*keys, F.lit(True).alias("_b")).distinct().join(after.select(*keys, F.lit(True).alias("_a")).distinct(), keys, "full")
    return j.select(*keys, F.when(F.col("_a").isNull(), "fixed").when(F.col("_b").isNull(), "collateral").otherwise("still_bad").alias("change"))


def gate(before: DataFrame, after: DataFrame, slug: str = "slug") -> DataFrame:
    """One row: ok only if the total falls and no book rises."""
    j = before.select(slug, F.col("occ").alias("b")).join(after.select(slug, F.col("occ").alias("a")), slug, "full").na.fill(0, ["a", "b"])
    tot = j.agg(F.sum("b").alias("before_occ"), F.sum("a").alias("after_occ"), F.count_if(F.col("a") > F.col("b")).alias("regressed"))
    return tot.withColumn("delta", F.col("after_occ") - F.col("before_occ")).withColumn("ok", (F.col("delta") < 0) & (F.col("regressed") == 0))


def gid(slug: Column, tex: Column, display: Column) -> Column:
    """Stable id of a finding: slug and eight hex digits of its formula."""
    return F.concat(slug, F.lit(":"), F.left(F.sha1(F.concat(F.when(display, F.lit("1")).otherwise(F.lit("0")), F.lit("\x00"), tex)), F.lit(8)))


def math_audit(unit_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hard findings of texts: delimiter, left_right and raw_tex_leak, one row each."""
    text = F.col("text")
    checks = F.array_compact(F.array(F.when(M.delimiter_fault(text).isNotNull(), "delimiter"), F.when(M.left_right_fault(text).isNotNull(), "left_right"), F.when(text.contains("\\") & M.leaks_tex(text), "raw_tex_leak")))
    return unit_rows.select(*keys, F.explode(checks).alias("kind"))


def batch_outcome(answered: Column, unrecoverable: Column, rendered: Column, semantic: Column, located: Column) -> Column:
    """What became of one proposed repair; the first that holds."""
    return F.when(answered.isNull(), "missing").when(unrecoverable, "unrecoverable").when(rendered.isNull(), "render_err").when(~rendered, "render_fail").when(semantic.isNotNull(), "semantic_fail").when(~located, "locate_fail").otherwise("accepted")


def sweep_decision(node: Column, total: Column, accepted: Column, same_macros: Column, last_after: Column, progressed: Column) -> Column:
    stuck = F.coalesce(same_macros & (last_after == total) & ~F.coalesce(progressed, F.lit(False)), F.lit(False))
    return F.when(~node, "no-node").when(total - accepted <= 0, "converged").when(stuck, "fixpoint").otherwise("due")


def live_occurrences(groups_: DataFrame, detectors: DataFrame) -> DataFrame:
    """id and the occurrences of formulas with any of its detector tokens; -1 where it has no detector."""
    words = groups_.select(F.col("total_occ").alias("occ"), "tex", F.explode(M.control_words(F.col("tex"))).alias("token")).join(detectors.select("id", F.explode("tokens").alias("token")), "token")
    hit = words.select("id", "tex", "occ").distinct().groupBy("id").agg(F.sum("occ").alias("occ"))
    return detectors.join(hit, "id", "left").select("id", F.when(F.size("tokens") <= 0, F.lit(-1)).otherwise(F.coalesce("occ", F.lit(0))).alias("live_occ"))
