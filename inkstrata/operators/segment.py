"""Ordered blocks to chapters, sections and numbered items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from inkstrata.functions import numbers as N


def running(keys: list[str], order: str | list[str]):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0)


def without_noise(blocks: DataFrame, noise: list[str]) -> DataFrame:
    return blocks.where(~F.coalesce(F.col("type").isin(*noise), F.lit(False))) if noise else blocks


def expand_lists(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """List blocks without text become one text block per non-empty item, without a level; `item` orders them."""
    items = F.filter(F.transform(F.filter("list_items", lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != "")
    is_list = (F.col("type") == "list") & (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.size(items) > 0)
    one = F.when(is_list, items).otherwise(F.array(F.col("text")))
    flat = blocks.withColumn("_list", F.coalesce(is_list, F.lit(False))).select("*", F.posexplode(one).alias("item", "_text"))
    return flat.withColumn("type", F.when(F.col("_list"), "text").otherwise(F.col("type"))).withColumn("text", F.col("_text")).withColumn("text_level", F.when(~F.col("_list"), F.col("text_level"))).drop("_list", "_text", "list_items")


def slice_ranges(blocks: DataFrame, ranges: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Blocks within half-open [start, stop) ranges of the same keys."""
    return blocks.join(ranges, keys).where((F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("stop")))


def first_after_page(blocks: DataFrame, keys: list[str], page: Column) -> DataFrame:
    """Smallest idx whose page is at least `page`, else the number of blocks."""
    return blocks.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("page_idx") >= page, F.col("idx"))), F.count(F.lit(1))).alias("first_idx"))


def capped_end(low: Column, high: Column, cap: Column, appendices: Column) -> Column:
    """The last chapter ends at the back matter if there are no appendices and the cap lies inside."""
    return F.when((appendices == 0) & (low < cap) & (cap < high), cap).otherwise(high)


def chapter_ranges(starts: DataFrame, keys: list[str], total: str = "n_blocks") -> DataFrame:
    """Each start's range up to the next start, the last up to the number of blocks."""
    return starts.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy(*keys).orderBy("start")), F.col(total)))


def to_struct(blocks: DataFrame) -> DataFrame:
    """Typed blocks p / eq / fig / table of raw blocks; rows that give nothing are dropped."""

    def said(c: str) -> Column:
        return F.trim(F.array_join(F.transform(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.trim(x)), " "))

    text = F.trim(F.coalesce("text", F.lit("")))
    items = F.array_join(F.filter(F.transform(F.filter("list_items", lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != ""), "\n\n")
    kind = F.col("type")
    file = F.element_at(F.split(F.coalesce("img_path", F.lit("")), "/"), -1)
    caption = F.when(kind == "chart", said("chart_caption")).when(kind == "image", said("image_caption")).when(kind == "table", said("table_caption")).when(kind == "code", said("code_caption"))
    caption = N.nullif_empty(caption)
    tex = N.strip_display(text)
    box = F.transform("bbox", lambda x: x.try_cast("double"))
    wide, high = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    code = F.trim(F.coalesce(N.nullif_empty(F.col("code_body")), F.col("content"), F.lit("")))
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(code, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    out = (
        blocks.withColumn("t", F.when(kind.isin("text", "list"), "p").when(kind == "equation", "eq").when(kind.isin("image", "chart"), "fig").when(kind.isin("table", "code"), "table"))
        .withColumn("md", F.when(F.col("t") == "p", F.when((kind == "list") & (text == ""), N.nullif_empty(items)).otherwise(N.nullif_empty(text))))
        .withColumn("label", F.when(F.col("t") == "eq", N.equation_label(tex)))
        .withColumn("tex", F.when(F.col("t") == "eq", N.nullif_empty(N.without_label(tex))))
        .withColumn("src", F.when(F.col("t") == "fig", N.nullif_empty(file)))
        .withColumn("kind", F.when(F.col("t") == "fig", F.when(F.col("sub_type") == "natural_image", "photo").otherwise("line")))
        .withColumn("aspect", F.when((F.col("t") == "fig") & (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()) & (wide > 0) & (high > 0), F.round(wide / high, 3)))
        .withColumn("html", F.when(kind == "table", N.nullif_empty(F.col("table_body"))).when((kind == "code") & (code != ""), F.concat(F.lit("<pre><code>"), escaped, F.lit("</code></pre>"))))
        .withColumn("footnote", F.when(kind == "table", N.nullif_empty(said("table_footnote"))))
        .withColumn("caption", caption)
    )
    ident = F.when(F.col("t") == "fig", N.figure_id(F.col("caption"))).when(F.col("t") == "table", F.coalesce(N.table_id(F.col("caption")), N.figure_id(F.col("caption"))))
    return out.withColumn("id", ident).where(F.coalesce("md", "tex", "src", "html").isNotNull())


def heading(text: Column, level: Column, levels: list[int], section: str, subsection: str, example: str | None = None) -> Column:
    """struct(t, id, title) of a heading at one of the levels: subsection before section before example; else null."""
    s = F.trim(text)

    def one(t: str, p: str, title: bool) -> Column:
        ident = F.regexp_replace(F.regexp_extract(s, p, 1), r"\s+", "")
        return F.struct(F.lit(t).alias("t"), ident.alias("id"), (F.trim(F.regexp_extract(s, p, 2)) if title else F.lit(None).cast("string")).alias("title"))

    out = F.when(~F.coalesce(level.isin(*levels), F.lit(False)), F.lit(None)).when(s.rlike(subsection), one("subsection", subsection, True)).when(s.rlike(section), one("section", section, True))
    return out.when(s.rlike(example), one("example", example, False)) if example else out


def carry_section(blocks: DataFrame, keys: list[str], order: str | list[str], value: Column, name: str = "section") -> DataFrame:
    """The last non-null value at or before each block."""
    return blocks.withColumn(name, F.last(value, True).over(running(keys, order)))


def section_anchors(headings: DataFrame, keys: list[str], order: str | list[str], ident: str, label: str) -> DataFrame:
    """sec-<id>, or sec-<label>-<n> with a running number of headings where there is no id."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)))
    i = F.trim(F.coalesce(ident, F.lit("")))
    return headings.withColumn("anchor", F.when(i != "", F.concat(F.lit("sec-"), i)).otherwise(F.concat(F.lit("sec-"), F.col(label).cast("string"), F.lit("-"), n.cast("string"))))


def increasing(rows: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """Rows whose value exceeds every valid earlier one.  A rejected value never raises the maximum, so a window says it."""
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(value).over(w)
    return rows.withColumn("accepted", F.col(value).isNotNull() & (before.isNull() | (before <= 0) | (F.col(value) > before))) if dict(rows.dtypes)[value] in ("int", "bigint") else rows.withColumn("accepted", F.col(value).isNotNull() & (before.isNull() | (F.col(value) > before)))


def missing_numbers(rows: DataFrame, keys: list[str], value: str, expected: DataFrame | None = None) -> DataFrame:
    """Integers in 1..max that do not occur, per key; `expected` (keys, value) marks the known ones."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("top")).where("top >= 1")
    every = top.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias(value))
    gone = every.join(rows.select(*keys, F.col(value).cast("long").alias(value)).distinct(), [*keys, value], "left_anti")
    if expected is None:
        return gone
    return gone.join(expected.select(*keys, value, F.lit(True).alias("expected")).distinct(), [*keys, value], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))


def smoke(chapters: DataFrame, keys: list[str], order: str) -> DataFrame:
    """code, keys, detail: structural anomalies of chapters (body_count, problem_count, duplicate_numbers, empty_bodies)."""
    w = Window.partitionBy(*keys).orderBy(order)
    prior = F.lag("body_count").over(w)
    ratio = F.greatest("body_count", prior) / F.least("body_count", prior)
    # The thresholds of the anomaly codes.
    wide = (prior >= 50) & (F.col("body_count") >= 50) & (ratio > 5)
    checks = F.array_compact(
        F.array(
            F.when((F.col("body_count") < 20) & (F.col("problem_count") > 30), "H1"),
            F.when(F.col("duplicate_numbers") > 0, "H2"),
            F.when((F.col("problem_count") > 0) & (F.col("empty_bodies") == F.col("problem_count")), "H3"),
            F.when(F.coalesce("is_appendix", F.lit(False)) & (F.col("body_count") > 1500), "H4") if "is_appendix" in chapters.columns else F.lit(None),
            F.when(wide, "H5"),
        )
    )
    return chapters.withColumn("codes", checks).select(*keys, order, F.explode("codes").alias("code"))


def duplicate_numbers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def chapter_run(headings: DataFrame, keys: list[str], num: str, order: str, toc: Column) -> DataFrame:
    """The run of consecutive chapter numbers from the smallest, each at its first place outside a table of contents."""
    best = headings.groupBy(*keys, num).agg(F.min(F.struct(toc.cast("int").alias("toc"), F.col(order).alias("at"))).alias("pick"))
    w = Window.partitionBy(*keys).orderBy(num)
    island = F.col(num) - F.row_number().over(w)
    first = F.min(num).over(Window.partitionBy(*keys)) - 1
    return best.withColumn("_i", island).withColumn("_f", first).where(F.col("_i") == F.col("_f")).select(*keys, num, F.col("pick.at").alias(order))


def assemble(chunks: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """Global pages of overlapping OCR chunks: local page + start - 1, first `overlap` pages of later chunks dropped."""
    return chunks.where((F.col("chunk_idx") == 0) | (F.col("page") >= overlap)).withColumn("page_idx", F.col("page") + F.col("start") - 1)


def plan_chunks(pages: Column, size: int, overlap: int) -> Column:
    """Overlapping ranges of at most `size` pages, as an array of structs."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), pages - overlap), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, pages).alias("stop")))


def rebuild_ranges(counts: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """Page ranges from page counts: each starts overlap - 1 pages before the last one's end."""
    w = Window.partitionBy(*keys).orderBy("chunk_idx")
    start = F.coalesce(F.sum(F.col("pages") - overlap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return counts.withColumn("start", start).withColumn("stop", F.col("start") + F.col("pages") - 1)


class ItemMachine:
    """The owner of each block, block by block in order; see `split_items`."""

    def __init__(self, start: re.Pattern, chapter: int, *, level: int = 1, must_match: bool = False, section: re.Pattern | None = None, end: re.Pattern | None = None, solution: re.Pattern | None = None, namespace: bool = False) -> None:
        self.start, self.chapter, self.level, self.must_match = start, chapter, level, must_match
        self.section, self.end, self.solution, self.namespace = section, end, solution, namespace
        self.open_num: str | None = None
        self.part, self.top, self.space, self.over = "body", 0, str(chapter), False
        self.used: dict[str, set[str]] = {}

    def _number(self, raw: str | None) -> str | None:
        """The number of an item start, or null where it is not accepted."""
        num = re.sub(r"\s+", "", raw) if raw is not None else None
        pieces = re.findall(r"\d+", num or "")
        last = int(pieces[-1]) if num and num.split(".")[-1].isdigit() else None
        if raw is not None and self.must_match and not (num.split(".")[0].isdigit() and int(num.split(".")[0]) == self.chapter):
            return None
        if last is not None and 0 < self.top >= last:
            return None
        mine = self.used.setdefault(self.space, set())
        if num is None:
            num = str(next(k for k in range(1, len(mine) + 2) if str(k) not in mine))
        elif last is not None:
            self.top = max(self.top, last)
        mine.add(num)
        return num

    def feed(self, b: dict) -> dict | None:
        """The row of one block, null where it belongs to no item."""
        text = (b.get("text") or "").strip()
        at_level = b.get("type") == "text" and b.get("text_level") == self.level
        self.over = self.over or (self.end is not None and at_level and bool(self.end.match(text)))
        if self.over:
            return None
        if self.solution is not None and self.open_num is not None and at_level and self.solution.match(text):
            self.part = "solution"
            return None
        found = self.section.match(text) if self.section is not None and at_level else None
        if found and (self.namespace or self.open_num is not None):
            self.open_num, self.part = None, "body"
            if self.namespace:
                self.space, self.top = re.sub(r"\s+", "", found.group(1)) or self.space, 0
            return None
        hit = self.start.match(text) if text and b.get("type") in ("text", "list") else None
        num = self._number(hit.group(1)) if hit else None
        if num is not None:
            self.open_num, self.part = f"{self.space}.{num}" if self.namespace else num, "body"
            return {"num": self.open_num, "part": self.part, "idx": b["idx"], "text": text[hit.end() :].strip()}
        if self.open_num is not None and text:
            return {"num": self.open_num, "part": self.part, "idx": b["idx"], "text": text}
        return None


def split_items(blocks: list[dict], start: re.Pattern, chapter: int, **rules) -> list[dict]:
    """Owner of each block by an explicit event machine; blocks: text, type, text_level, idx in order.

    Gives rows (num, part, idx, text): part is body or solution.  Events in
    order of precedence: end of the region, solution heading, section heading
    (closes the item; with a namespace also names it and restarts the numbers),
    then an item start, accepted if its number exceeds the largest so far.
    """
    machine = ItemMachine(start, chapter, **rules)
    return [row for b in blocks if (row := machine.feed(b)) is not None]


def split_items_exact(blocks: DataFrame, keys: list[str], chapter: str, make: Callable[[], dict]) -> DataFrame:
    """The event machine per chapter, for books whose events depend on each other.

    A table function: Spark brings the blocks of a chapter together in order of
    idx and each is answered as it comes, so no chapter is ever held.
    """
    kinds = dict(blocks.dtypes)
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)

    class Items:
        def __init__(self) -> None:
            self.machine = None

        def eval(self, row: Row) -> Iterator[tuple]:
            if self.machine is None:
                self.machine = ItemMachine(chapter=int(row[chapter]), **make())
            out = self.machine.feed({k: row[k] for k in ("idx", "type", "text", "text_level")})
            if out is not None:
                yield (*[row[k] for k in keys], out["num"], out["part"], out["idx"], out["text"])

    split = F.udtf(Items, returnType=f"{fields}, num string, part string, idx long, text string")
    return split(blocks.select(*dict.fromkeys([*keys, chapter, "idx", "type", "text", "text_level"])).asTable().partitionBy(*keys).orderBy("idx"))


def split_items_fast(blocks: DataFrame, keys: list[str], order: str, start: str, stop: str) -> DataFrame:
    """Owner item of each block by windows alone, where no block is both a start and a stop.

    start: pattern whose first group is the number; stop: pattern that closes
    an item.  Rows before the first item, after a stop, or stops themselves are dropped.
    """
    num = F.regexp_extract("text", start, 1)
    value = N.number_tuple(num)
    event = blocks.withColumn("_v", F.when(F.col("text").rlike(start), F.element_at(value, -1)))
    event = increasing(event, keys, order, "_v")
    halt = F.col("text").rlike(stop)
    mark = F.when(halt, F.struct(F.lit(None).cast("string").alias("num"))).when(F.col("accepted"), F.struct(num.alias("num")))
    owned = event.withColumn("num", F.last(mark, True).over(running(keys, order))["num"])
    body = F.when(F.col("accepted"), F.trim(F.regexp_replace("text", start, ""))).otherwise(F.col("text"))
    return owned.where(F.col("num").isNotNull() & ~halt).withColumn("text", body).drop("_v", "accepted")


def dedupe_ids(rows: DataFrame, keys: list[str], order: list[str], ident: str, name: str = "unique_id") -> DataFrame:
    """The n-th repeat of an id gets --n, the first stays."""
    n = F.row_number().over(Window.partitionBy(*keys, ident).orderBy(*order)) - 1
    return rows.withColumn(name, F.when(n == 0, F.col(ident)).otherwise(F.concat_ws("--", F.col(ident), n.cast("string"))))


def dedupe_ids_with_aliases(rows: DataFrame, keys: list[str], order: list[str], ident: str, alias: str, name: str = "unique_id") -> DataFrame:
    """Alias rows are neither counted nor renamed; the first row of an id is never renamed."""
    part = Window.partitionBy(*keys, ident).orderBy(*order)
    so_far = F.sum((~F.col(alias)).cast("int")).over(part.rowsBetween(Window.unboundedPreceding, 0))
    first_real = F.first(~F.col(alias)).over(part.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    n = so_far - first_real
    first = F.row_number().over(part) == 1
    return rows.withColumn(name, F.when(first | F.col(alias) | (n == 0), F.col(ident)).otherwise(F.concat_ws("--", F.col(ident), n.cast("string"))))


def media_id(t: Column, caption: Column, label: Column, stem: Column, source: Column, idx: Column) -> Column:
    """Reader id of a block without one: by caption, by label, else by place."""
    place = F.concat(stem, F.when(source == "body", F.lit("")).otherwise(F.concat(F.lit("-"), source)), F.lit("-"), idx.cast("string"))
    return (
        F.when(t == "eq", F.when(label.isNotNull(), F.concat(F.lit("eq-"), stem, F.lit("-"), label)).otherwise(F.concat(F.lit("eq-"), place)))
        .when(t == "fig", F.coalesce(N.figure_id(caption), N.table_id(caption), F.concat(F.lit("fig-"), place)))
        .when(t == "table", F.coalesce(N.table_id(caption), N.figure_id(caption), F.concat(F.lit("tbl-"), place)))
    )


def merge_subcaptions(rows: DataFrame, keys: list[str], order: str, main: str) -> DataFrame:
    """A figure with a main caption gives it to the figure before it if that has only a sub-label such as (a)."""
    figs = Window.partitionBy(*keys, F.col("t") == "fig").orderBy(order)
    is_main = (F.col("t") == "fig") & F.coalesce(F.col("caption").rlike(main), F.lit(False))
    takes = (F.col("t") == "fig") & F.coalesce(F.col("caption").rlike(r"^\([a-z]\)"), F.lit(False)) & F.coalesce(F.lead(is_main).over(figs), F.lit(False))
    gave = F.coalesce(F.lag(takes).over(figs), F.lit(False)) & is_main
    out = rows.withColumn("_takes", takes).withColumn("_next", F.lead("caption").over(figs)).withColumn("_gave", gave)
    out = out.withColumn("caption", F.when(F.col("_takes"), F.col("_next")).when(~F.col("_gave"), F.col("caption")))
    return out.withColumn("id", F.when(F.col("_gave"), F.lit(None)).otherwise(F.coalesce(F.when(F.col("_takes"), N.figure_id(F.col("caption"))), F.col("id")))).drop("_takes", "_next", "_gave")


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """Nested chunks (slug, stem, body, problems with num, body, solution) as one row per block with its locator."""
    body = chunks.select("slug", "stem", F.lit("body").alias("section"), F.lit(None).cast("string").alias("num"), F.lit(0).alias("occ"), F.posexplode("body").alias("idx", "b"))
    probs = chunks.select("slug", "stem", F.posexplode("problems").alias("_p", "p"))
    occ = F.row_number().over(Window.partitionBy("slug", "stem", "p.num").orderBy("_p")) - 1
    probs = probs.withColumn("occ", occ)
    parts = [probs.select("slug", "stem", F.lit(f"problem.{s}").alias("section"), F.col("p.num").alias("num"), "occ", F.posexplode(f"p.{s}").alias("idx", "b")) for s in ("body", "solution")]
    out = body.unionByName(parts[0]).unionByName(parts[1])
    place = F.concat(F.when(F.col("num").isNull(), F.lit("body")).otherwise(F.concat(F.lit("problem["), F.col("num"), F.lit("]."), F.regexp_replace("section", r"^problem\.", ""))), F.lit("["), F.col("idx").cast("string"), F.lit("]"))
    return out.select("slug", "stem", "section", "num", "occ", "idx", "b.*", F.concat(F.col("stem"), F.lit(":"), place).alias("locator"))


def running_headers(blocks: DataFrame, keys: list[str], order: str, is_heading: Column, start: str) -> DataFrame:
    """Flags headings that only repeat at a page top: the next text is an item whose number is above one."""
    said = F.when(~is_heading & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    after = F.last(said, True).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    num = F.element_at(F.split(F.regexp_replace(F.regexp_extract(after, start, 1), r"\s+", ""), r"\."), 1).try_cast("int")
    return blocks.withColumn("running", is_heading & F.coalesce(num > 1, F.lit(False)))


def parse(blocks: DataFrame, ranges: DataFrame, noise: list[str], section: str, subsection: str, levels: list[int], main_caption: str | None = None) -> DataFrame:
    """Typed body blocks of the chapters in `ranges` (slug, chapter, start, stop): noise dropped, headings found, captions merged."""
    inside = without_noise(slice_ranges(blocks, ranges, ["slug"]), noise)
    heads = inside.withColumn("h", heading(F.coalesce("text", F.lit("")), F.col("text_level"), levels, section, subsection)).withColumn("_head", (F.col("type") == "text") & F.col("h").isNotNull())
    titles = heads.where("_head").select("slug", "chapter", "idx", F.col("h.t").alias("t"), F.col("h.id").alias("id"), F.col("h.title").alias("title"))
    body = to_struct(heads.where(~F.coalesce("_head", F.lit(False))))
    out = titles.unionByName(body.select("slug", "chapter", "idx", "t", "id", "md", "tex", "label", "src", "kind", "aspect", "html", "caption", "footnote"), allowMissingColumns=True)
    return merge_subcaptions(out, ["slug", "chapter"], "idx", main_caption) if main_caption else out


def level_mode(blocks: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """The most frequent level of section-like headings, the lowest of equals."""
    n = blocks.where(F.col("text").rlike(pattern) & F.col("text_level").isNotNull()).groupBy(*keys, "text_level").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by("text_level", F.struct("n", -F.col("text_level"))).alias("level"))


def type_shares(blocks: DataFrame, keys: list[str], least: int) -> DataFrame:
    """How often each block type occurs, and whether it is a candidate for the noise filter."""
    n = blocks.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("noise", F.col("type").isin("header", "footer", "page_number", "aside_text", "page_footnote") & (F.col("n") >= least))


def samples(blocks: DataFrame, keys: list[str], order: str, pattern: str, most: int) -> DataFrame:
    """The first matches of a pattern per key."""
    hit = blocks.withColumn("sample", F.regexp_extract("text", pattern, 0)).where("sample <> ''")
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= most).select(*keys, order, "sample")


def boundaries(headings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First index and bibliography heading, and every appendix heading."""
    kind = F.when(F.lower(F.trim("text")).rlike("^(subject |author )?index$"), "index").when(F.lower(F.trim("text")).rlike("^(bibliography|references)$"), "bibliography").when(F.lower("text").rlike("^appendix"), "appendix")
    rows = headings.withColumn("kind", kind).where("kind is not null")
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(order))
    return rows.withColumn("_n", rank).where("kind = 'appendix' or _n = 1").select(*keys, "kind", order)
