"""Catalogues of figures, tables and equations: build, audit, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import numbers as N
from inkstrata.functions import text as T
from inkstrata.sources import merged


def normalized(entries: DataFrame) -> DataFrame:
    """Anchors and chunk keys filled in; figures and tables need an id, equations a label."""
    anchor = F.coalesce("anchor", "id")
    chunk = F.coalesce("chunk_key", F.regexp_extract("source", r"(ch\d+|app[A-Za-z0-9]+)", 1))
    return entries.withColumn("anchor", anchor).withColumn("chunk_key", chunk).where(visible(F.col("type"), F.col("id"), F.col("label")))


def visible(kind: Column, ident: Column, label: Column) -> Column:
    return F.when(kind.isin("figure", "table"), F.coalesce(ident, F.lit("")) != "").when(kind == "equation", F.coalesce(label, F.lit("")) != "").otherwise(False)


def semantic_type(t: Column, caption: Column, ident: Column) -> Column:
    """figure or table by caption, else by id, else by block."""
    first = F.get(N.caption_labels(caption), F.lit(0))["type"]
    by_id = F.when(ident.rlike(N.FALLBACK), F.lit(None)).when(ident.startswith("fig-"), "figure").when(ident.startswith("tbl-"), "table")
    return F.when(t == "eq", "equation").otherwise(F.coalesce(first, by_id, F.when(t == "fig", "figure").otherwise("table")))


def semantic_id(t: Column, caption: Column, ident: Column, label: Column, tex: Column) -> Column:
    """The id a reader sees: from the caption, a non-positional id, or an equation label; else null."""
    first = F.get(N.caption_labels(caption), F.lit(0))
    by_caption = F.concat_ws("-", first["prefix"], first["num"])
    own = N.nullif_empty(F.trim(F.coalesce(ident, F.lit(""))))
    eq = F.coalesce(N.nullif_empty(F.trim(F.coalesce(label, F.lit("")))), N.equation_label(F.coalesce(tex, F.lit(""))))
    return F.when(t == "eq", F.when(own.startswith("eq-"), own).otherwise(F.concat(F.lit("eq-"), eq))).otherwise(F.coalesce(F.when(first.isNotNull(), by_caption), F.when(~own.rlike(N.FALLBACK), N.canonical_id(own))))


def build(blocks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Catalogue entries with the section they stand in; captions with several labels give several entries."""
    run = Window.partitionBy("slug", chunk).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("t").isin("section", "subsection"), N.nullif_empty(F.col("id"))), True).over(run)
    media = blocks.withColumn("section", section).where(F.col("t").isin("fig", "table", "eq"))
    labels = F.when(F.size(N.caption_labels(F.col("caption"))) > 0, N.caption_labels(F.col("caption"))).otherwise(F.array(F.lit(None).cast("struct<type:string,prefix:string,num:string,display:string>")))
    flat = media.withColumn("one", F.explode(labels))
    kind = F.coalesce("one.type", semantic_type(F.col("t"), F.col("caption"), F.col("id")))
    ident = F.when(F.col("one").isNotNull(), F.concat_ws("-", "one.prefix", "one.num")).otherwise(semantic_id(F.col("t"), F.col("caption"), F.col("id"), F.col("label"), F.col("tex")))
    return flat.select("slug", chunk, "ord", "section", kind.alias("type"), ident.alias("id"), F.coalesce("one.display", "caption").alias("caption"), F.coalesce("id", ident).alias("anchor"), "src", "label")


def counts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Figures, tables and equations per key, side by side."""
    return entries.groupBy(*keys).pivot("type", ["figure", "table", "equation"]).agg(F.count(F.lit(1))).na.fill(0)


def aliases(blocks: DataFrame) -> DataFrame:
    """Valid rows of an alias array: every one has a type and an id."""
    flat = blocks.select("slug", "anchor", F.explode_outer("aliases").alias("a"))
    return flat.where(F.col("a.id").isNotNull()).select("slug", "anchor", F.coalesce("a.type", F.lit("figure")).alias("type"), F.trim("a.id").alias("id"), F.lit(True).alias("catalog_alias")).where("id <> ''")


def text_references(units: DataFrame, keys: list[str], order: str, most: int = 5) -> DataFrame:
    """Each figure and table number mentioned in texts, how often, and its first contexts."""
    flat = units.select(*keys, order, "text", F.explode(F.concat(_tagged("figure"), _tagged("table"))).alias("r"))
    w = Window.partitionBy(*keys, "r.kind", "r.ref").orderBy(order)
    ranked = flat.withColumn("n", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys, "r.kind", "r.ref")))
    return ranked.where(F.col("n") <= most).select(*keys, order, "r.kind", "r.ref", "n", "total", T.snippet_cut(F.col("text")).alias("context"))


def _tagged(kind: str) -> Column:
    return F.transform(N.references(kind, F.col("text")), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("ref")))


def uncovered(refs: DataFrame, entries: DataFrame, keys: list[str], waivers: DataFrame | None = None) -> DataFrame:
    """References whose number, and whose number without a trailing letter, no entry has; waived ones are left out."""
    have = entries.select(*keys, "kind", N.canonical(F.col("num")).alias("have")).distinct()
    rows = refs.withColumn("_num", N.canonical(F.col("ref"))).withColumn("_parent", N.parent(F.col("ref")))
    rest = rows.join(have.withColumnRenamed("have", "_num"), [*keys, "kind", "_num"], "left_anti")
    rest = rest.join(have.withColumnRenamed("have", "_parent"), [*keys, "kind", "_parent"], "left_anti")
    if waivers is not None:
        rest = rest.join(waivers.select(*keys, "kind", N.canonical(F.col("ref")).alias("_num")).distinct(), [*keys, "kind", "_num"], "left_anti")
    return rest.drop("_num", "_parent")


def audit(checks: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Union of named checks: code and the given columns as strings."""
    out = None
    for code, frame in checks.items():
        one = frame.select(F.lit(code).alias("code"), *[F.col(c).cast("string").alias(c) for c in columns])
        out = one if out is None else out.unionByName(one)
    return out


def audit_counts(findings: DataFrame, codes: list[str]) -> DataFrame:
    """Findings per code, zero for codes without any, and the critical total."""
    spark = findings.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))
    return every.join(findings.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code", "left").na.fill({"n": 0})


def missing_anchors(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("slug", "chunk_key", F.col("id").alias("anchor")).distinct(), ["slug", "chunk_key", "anchor"], "left_anti")


def nearest_text(blocks: DataFrame, keys: list[str], order: str | list[str], visual: Column, text: Column) -> DataFrame:
    """For each visual the nearest non-empty text before and after it, and its ordinal."""
    by = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*by)
    said = F.when(~visual & (F.trim(F.coalesce(text, F.lit(""))) != ""), text)
    out = blocks.withColumn("_v", visual).withColumn("before", F.last(said, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.last(said, True).over(Window.partitionBy(*keys).orderBy(*map(F.desc, by)).rowsBetween(Window.unboundedPreceding, -1)))
    n = F.row_number().over(Window.partitionBy(*keys, "_v").orderBy(*by))
    return out.withColumn("ordinal", n).where("_v").drop("_v")


def zip_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The k-th left row with the k-th right row, only where a key has as many of each."""
    a = left.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    b = right.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return a.join(b, [*keys, "_k", "_n"]).drop("_k", "_n")


def gap_candidates(rows: DataFrame, wanted: DataFrame, keys: list[str], num: str = "num", pos: str = "pos") -> DataFrame:
    """The one unnumbered visual between the neighbours of a missing number.

    rows: keys, pos, num (null: unnumbered); wanted: keys, target.  The nearest
    lower and higher numbered rows bound the place; exactly one unnumbered row
    must lie between.
    """
    j = wanted.join(rows, keys)
    low = F.max_by(pos, F.when(F.col(num) < F.col("target"), F.col(num)))
    high = F.min_by(pos, F.when(F.col(num) > F.col("target"), F.col(num)))
    bounds = j.groupBy(*keys, "target").agg(low.alias("low_pos"), high.alias("high_pos"), F.max(F.when(F.col(num) < F.col("target"), 1)).alias("has_low"), F.min(F.when(F.col(num) > F.col("target"), 1)).alias("has_high"))
    bounds = bounds.where("has_low = 1 and has_high = 1").drop("has_low", "has_high")
    inside = bounds.join(rows.where(F.col(num).isNull()), keys).where((F.col(pos) > F.col("low_pos")) & (F.col(pos) < F.col("high_pos")))
    return inside.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias(pos)).where("n = 1").drop("n")


def near_candidates(rows: DataFrame, wanted: DataFrame, keys: list[str], reach: int = 8) -> DataFrame:
    """The nearest unnumbered visual within `reach` blocks after the citing block, else before, under the same heading."""
    j = wanted.join(merged(rows.where("num is null")), [*keys, "heading"]).withColumn("d", F.col("pos") - F.col("cite_pos")).where(F.abs("d") <= reach)
    rank = F.row_number().over(Window.partitionBy(*keys, "target").orderBy((F.col("d") < 0).cast("int"), F.abs("d")))
    return j.withColumn("_r", rank).where("_r = 1").select(*keys, "target", "pos")


def sibling_candidates(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """A visual that shares the target's parent number, or whose number begins with the target."""
    j = wanted.withColumn("_p", N.parent(F.col("target"))).join(merged(rows.where("ref is not null")), keys)
    hit = j.where((F.col("_p") == N.parent(F.col("ref"))) | (F.col("_p") == F.col("ref")) | F.col("ref").startswith(F.col("target")))
    return hit.groupBy(*keys, "target").agg(F.min_by("pos", F.col("pos")).alias("pos"))


def first_of(wanted: DataFrame, keys: list[str], **sources: DataFrame) -> DataFrame:
    """The position of the first source that has one, with the source's name."""
    out = wanted
    for name, frame in sources.items():
        out = out.join(merged(frame.select(*keys, "target", F.col("pos").alias(f"_{name}"))), [*keys, "target"], "left")
    names = list(sources)
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in names])
    return out.select(*wanted.columns, F.coalesce(*[F.col(f"_{n}") for n in names]).alias("pos"), source.alias("source"))


def caption_candidates(captions: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """OCR captions for missing references: by number, else by parent number; the first caption of a number counts."""
    w = Window.partitionBy(*keys, "kind", "num").orderBy("pos")
    first = captions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    exact = wanted.join(first.select(*keys, "kind", F.col("num").alias("ref"), F.col("pos").alias("exact_pos"), F.col("src").alias("exact_src")), [*keys, "kind", "ref"], "left")
    up = exact.withColumn("up", N.parent(F.col("ref"))).join(first.select(*keys, "kind", F.col("num").alias("up"), F.col("pos").alias("up_pos"), F.col("src").alias("up_src")), [*keys, "kind", "up"], "left")
    return up.select(*wanted.columns, F.coalesce("exact_pos", "up_pos").alias("pos"), F.coalesce("exact_src", "up_src").alias("src"))


def insert_after(base: DataFrame, extra: DataFrame, order: str = "ord") -> DataFrame:
    """Rows put between others by a fractional order key; extra holds the order of the row before."""
    return base.withColumn(order, F.col(order).cast("double")).unionByName(extra.withColumn(order, F.col(order) + 0.5), allowMissingColumns=True)


def selector(path: Column) -> Column:
    """body[N] or problem:NUM[#OCC]:field[N] as struct(section, num, occ, idx)."""
    p = r"^problem:(.+?)(?:#(\d+))?:(body|solution)\[(\d+)\]$"
    b = r"^(body)\[(\d+)\]$"
    return F.when(path.rlike(b), F.struct(F.lit("body").alias("section"), F.lit(None).cast("string").alias("num"), F.lit(0).alias("occ"), F.regexp_extract(path, b, 2).cast("int").alias("idx"))).when(
        path.rlike(p),
        F.struct(
            F.concat(F.lit("problem."), F.regexp_extract(path, p, 3)).alias("section"), F.regexp_extract(path, p, 1).alias("num"), F.coalesce(F.regexp_extract(path, p, 2).try_cast("int"), F.lit(0)).alias("occ"), F.regexp_extract(path, p, 4).cast("int").alias("idx")
        ),
    )


def target_of(locator: Column) -> Column:
    """ch03:problem[5].solution[1] as struct(chunk ch03, selector problem:5:solution[1])."""
    rest = F.regexp_extract(locator, "^[^:]+:(.*)$", 1)
    return F.struct(F.regexp_extract(locator, "^([^:]+):", 1).alias("chunk"), F.regexp_replace(rest, r"^problem\[([^\]]*)\]\.(\w+)\[(\d+)\]$", r"problem:$1:$2[$3]").alias("selector"))
