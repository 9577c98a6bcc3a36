"""The universe of works: states, qualification, roll-ups, selection, title matching, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import titles as T
from inkstrata.operators.ranks import global_rank

STATES = ["candidate", "pending", "qualified", "owned", "rejected"]


def _true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def dimensions(slug: Column, eligible: Column, link: Column, owned: Column, matches: Column, aligned: Column) -> dict[str, Column]:
    """Four strict booleans: unknown is not true.  Alignment counts for solution books only."""
    return {
        "eligible": _true(eligible),
        "link": F.coalesce(owned, F.lit(False)) | link.eqNullSafe(F.lit("found")),
        "version": _true(matches),
        "sol_alignment": F.when(slug.endswith("_sol"), _true(aligned)).otherwise(True),
    }


def qualifies(dims: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in dims.values():
        out = out & c
    return out


def state(owned: Column, link: Column, absent: Column, eligible: Column, qualified: Column) -> Column:
    """owned, then rejected (no link, or denied), then qualified or pending by the link, else candidate."""
    return (
        F.when(F.coalesce(owned, F.lit(False)), "owned")
        .when(link.eqNullSafe(F.lit("not_found")) | (_true(absent) & link.isNull()), "rejected")
        .when(eligible.eqNullSafe(F.lit(False)), "rejected")
        .when(link.eqNullSafe(F.lit("found")), F.when(qualified, "qualified").otherwise("pending"))
        .otherwise("candidate")
    )


def classify(works: DataFrame, inventory: DataFrame, links: DataFrame) -> DataFrame:
    """Works (slug, eligible, matches_pref, aligned, ...) with their state from inventory (slug) and links (slug, link, absent)."""
    j = works.join(inventory.select("slug", F.lit(True).alias("owned")).distinct(), "slug", "left").join(links.select("slug", "link", "absent"), "slug", "left")
    dims = dimensions(F.col("slug"), F.col("eligible"), F.col("link"), F.col("owned"), F.col("matches_pref"), F.col("aligned"))
    return j.withColumn("state", state(F.col("owned"), F.col("link"), F.col("absent"), F.col("eligible"), qualifies(dims)))


def public_state(c: Column) -> Column:
    return F.when(c == "owned", "owned").when(c == "qualified", "available").when(c == "rejected", "absent").otherwise("pending")


def resting(checked: Column, now: Column, days: int) -> Column:
    """Checked within the cool-down; never checked is not resting."""
    return F.coalesce(checked > now - F.make_interval(days=F.lit(days)), F.lit(False))


def progress(works: DataFrame, field: str = "field") -> DataFrame:
    """Counts of the five states per field and overall (is_total)."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return works.rollup(field).agg(F.count(F.lit(1)).alias("total"), *counts, (F.grouping(field) == 1).alias("is_total"))


def work_remaining(works: DataFrame, now: Column, days: int) -> DataFrame:
    open_ = (F.col("state") == "candidate") | ((F.col("state") == "pending") & ~resting(F.col("checked_at"), now, days))
    return works.agg(F.count_if(open_).alias("remaining"))


def ordered(works: DataFrame, fields: DataFrame) -> DataFrame:
    """Rank by live field order, subject rank, book rank, main before solution."""
    j = works.join(fields, "field_id", "left")
    return global_rank(j, [F.coalesce("field_order", F.lit(9999)), F.col("field_id")], [F.col("subject_rank"), F.col("book_rank"), (F.col("kind") != "main").cast("int"), F.col("slug")])


def with_solutions(works: DataFrame) -> DataFrame:
    """Each work and, where it has one, the derived row of its solution book directly after it."""
    rows = F.when(F.coalesce("has_solution", F.lit(False)), F.array(F.lit("main"), F.lit("solution"))).otherwise(F.array(F.lit("main")))
    out = works.withColumn("kind", F.explode(rows))
    return out.withColumn("of", F.when(F.col("kind") == "solution", F.col("slug"))).withColumn("slug", F.when(F.col("kind") == "solution", F.concat("slug", F.lit("_sol"))).otherwise(F.col("slug")))


def select_next(works: DataFrame, n: int, order: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """The first n qualified works with a link id and hash, none excluded."""
    rows = works.where((F.col("state") == "qualified") & F.col("link_id").isNotNull() & F.col("link_hash").isNotNull())
    if excluded is not None:
        rows = rows.join(excluded.select("slug"), "slug", "left_anti")
    return rows.orderBy(*order).limit(n)


def reconcile(universe: DataFrame, inventory: DataFrame) -> DataFrame:
    """side and slug: owned without a record, main records without a book, solution records without a book."""
    owned = inventory.select("slug").distinct()
    known = universe.select("slug").distinct()
    stray = owned.join(known, "slug", "left_anti").select(F.lit("owned_not_listed").alias("side"), "slug")
    gone = known.join(owned, "slug", "left_anti")
    return stray.unionByName(gone.select(F.when(F.col("slug").endswith("_sol"), "solution_not_owned").otherwise("listed_not_owned").alias("side"), "slug"))


def orphans(universe: DataFrame) -> DataFrame:
    """Solution records whose parent has no record."""
    kids = universe.where(F.col("slug").endswith("_sol")).withColumn("parent", F.regexp_replace("slug", "_sol$", ""))
    return kids.join(universe.select(F.col("slug").alias("parent")).distinct(), "parent", "left_anti")


def nested(works: DataFrame) -> DataFrame:
    """field, then subjects, then books, each in order."""
    books = works.groupBy("field_id", "subject").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "slug", "title", "state"))).alias("books"))
    return books.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("first", "subject", "books"))).alias("sublists"))


def matched(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Each work with the candidates that its own search found (slug, cid), of the same kind, and their confidence."""
    right = found.where(F.lower("extension") == "pdf").select("slug", F.col("title").alias("c_title"), F.col("author").alias("c_author"), "cid", "score", T.is_solution(F.col("title")).alias("c_solution"))
    pairs = targets.join(right, "slug")
    same = pairs.where((F.col("kind") == "solution") == F.col("c_solution"))
    return same.withColumn("confidence", T.confidence(F.col("title"), F.col("author"), F.col("c_title"), F.col("c_author")))


def pick(pairs: DataFrame) -> DataFrame:
    """The candidate of highest confidence above zero, ties by suitability."""
    w = Window.partitionBy("slug").orderBy(F.desc("confidence"), F.desc("score"), "cid")
    return pairs.where("confidence > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exact_unique(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Main works of two title words or more with exactly one candidate of the same normal title and surname."""
    left = targets.where("kind = 'main'").withColumn("_t", T.normal_title(F.col("title"))).where(F.size(F.split("_t", " ")) >= 2).withColumn("_s", T.surname(F.col("author")))
    right = found.where((F.lower("extension") == "pdf") & ~T.is_solution(F.col("title"))).withColumn("_t", T.normal_title(F.col("title")))
    right = right.withColumn("_hay", F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce("author", F.lit("")), F.coalesce("title", F.lit("")))), F.lit("[a-z0-9_]+"), F.lit(0))).select("cid", "_t", "_hay")
    hits = left.join(right, "_t").where((F.col("_s") == "") | F.array_contains("_hay", F.col("_s")))
    return hits.groupBy("slug").agg(F.count(F.lit(1)).alias("_n"), F.min("cid").alias("cid")).where("_n = 1").drop("_n")


def resolution_check(kind: Column, title: Column, found: Column) -> Column:
    """block or advisory reasons for main works only."""
    o = T.overlap(title, found)
    reasons = F.array_compact(F.array(F.when(T.companion(found).isNotNull(), "block:companion"), F.when(o == 0, "block:no_overlap"), F.when(o < T.OVERLAP_MIN, "advisory:title_mismatch")))
    return F.when((kind == "solution") | (F.coalesce(found, F.lit("")) == ""), F.array().cast("array<string>")).otherwise(reasons)


def quality_flags(numbers: Column, landed: Column, wanted: Column, empty: Column, declared: Column, problems: Column) -> Column:
    """All flags of a parsed book: source, gaps, companion, title, empty chapters, lost problems."""
    return F.array_compact(
        F.array(
            T.partial_source(numbers, wanted), T.chapter_gaps(numbers), T.companion(landed), T.mismatch(wanted, landed), F.when(empty > 0, F.concat(F.lit("empty_chapter("), empty.cast("string"), F.lit(")"))), F.when((problems == 0) & _true(declared), "no_problems_extracted")
        )
    )


def blocking(flags: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("partial_source", "chapter_gap", "companion", "title_mismatch", "no_problems_extracted")])
    return F.filter(flags, lambda f: F.array_contains(names, F.element_at(F.split(f, r"\("), 1)))


def triage(pages: DataFrame, key: str = "path") -> DataFrame:
    """Type, quality and verdict per file from sampled pages (chars, cover, dpi: null where there is no image)."""
    m = pages.groupBy(key).agg(
        F.avg("chars").alias("chars"), F.avg("cover").alias("cover"), F.round(F.median("dpi"), 0).alias("dpi"), F.avg(((F.col("chars") < 10) & (F.col("cover") < 0.05)).cast("int")).alias("blank")
    )
    # The bounds of the page metrics.
    kind = F.when((F.col("chars") < 30) & (F.col("cover") > 0.85), "scanned_image").when((F.col("chars") >= 100) & (F.col("cover") > 0.85), "ocr_sandwich").when((F.col("chars") >= 600) & (F.col("cover") < 0.6), "born_digital").otherwise("hybrid")
    scan = F.when(F.col("dpi").isNull(), "marginal").when(F.col("dpi") < 150, "bad").when(F.col("dpi") < 250, "marginal").otherwise("good")
    out = m.withColumn("type", kind).withColumn("quality", F.when(F.col("type").isin("scanned_image", "ocr_sandwich"), scan).otherwise("good"))
    out = out.withColumn("quality", F.when((F.col("blank") > 0.25) & (F.col("quality") == "good"), "bad").otherwise(F.col("quality")))
    fine = (F.col("quality") == "good") & ((F.col("type") == "born_digital") | ((F.col("type") == "hybrid") & (F.col("chars") > 300)))
    return out.select(key, "type", "quality", F.when(fine, "proceed").otherwise("review").alias("verdict"))


def longest_prefix(keys: DataFrame, slugs: DataFrame) -> DataFrame:
    """The longest slug that a key begins with; null where two bases tie.  Joined by prefix values, not by all pairs."""
    cut = keys.withColumn("slug", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda n: F.left("key", n))))
    best = cut.join(slugs.select("slug").distinct(), "slug").groupBy("key").agg(F.max_by("slug", F.length("slug")).alias("slug"))
    return keys.join(best, "key", "left")
