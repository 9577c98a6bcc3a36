"""Readers: driver tables and block corpora; writers with all-or-nothing commits."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_SCHEMA = (
    "type string, text string, text_level int, list_items array<string>, img_path string, image_caption array<string>, chart_caption array<string>, "
    "table_caption array<string>, table_footnote array<string>, table_body string, code_body string, code_caption array<string>, content string, sub_type string, bbox array<string>, page_idx int, chunk_idx int"
)
SLUG = "^[a-z0-9_]{1,64}$"


SMALL = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where it is unset on a local master (tests) a temporary one is made;
    on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="inkstrata-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """A small input, which may be one row group and so one task, dealt over all cores; larger ones are split by their files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= small else df


def merged(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the data: both sides are sorted and merged, none is broadcast.

    The optimizer takes an exploded or grouped side for as small as the file it
    comes from, and would send millions of rows through the driver.
    """
    return df.hint("merge")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without zone become instants (UTC) here and nowhere else."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages"):
        df = spread(df)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def valid_slug(c: Column) -> Column:
    return c.rlike(SLUG)


def slug_of(path: Column, depth: int = 2) -> Column:
    """The folder `depth` levels up that a file lies in; a partition folder counts by its value."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -depth), "^[a-z_]+=", "")


def blocks(spark: SparkSession, glob: str) -> DataFrame:
    """One row per block of per-book JSON arrays: slug, idx, then the block's fields."""
    raw = spark.read.text(glob, wholetext=True).select(slug_of(F.col("_metadata.file_path")).alias("slug"), F.from_json("value", f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _fields())}>>", {"mode": "PERMISSIVE"}).alias("blocks"))
    return raw.where(valid_slug(F.col("slug"))).select("slug", F.posexplode("blocks").alias("idx", "b")).select("slug", "idx", "b.*")


def variant_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of per-book JSON arrays (slug, value) whose fields may have any type: slug, idx, type, text, list_items, bbox, table_body.

    A field counts where it has the type it should: texts are strings, list items
    the strings among them, a box the numbers among its entries, also
    those written as strings.  A table body that is no string stays as JSON.
    Texts that are no JSON array give no row.
    """
    parsed = raw.select("slug", F.try_parse_json("value").alias("book"))
    parsed = parsed.where(F.schema_of_variant("book").startswith("ARRAY"))
    rows = parsed.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("book").outer())).select("slug", F.col("pos").alias("idx"), F.col("value").alias("b"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("b", f"$.{path}", "variant"))

    def string(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get("b", f"$.{path}", "string"))

    def entries(path: str) -> Column:
        return F.coalesce(F.try_variant_get("b", f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))

    items = F.transform(F.filter(entries("list_items"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    box = F.filter(F.transform(entries("bbox"), lambda v: F.try_variant_get(v, "$", "string").try_cast("double")), lambda x: x.isNotNull())
    body = F.coalesce(string("table_body"), F.when(kind("table_body").isNotNull() & (kind("table_body") != "VOID"), F.to_json(F.try_variant_get("b", "$.table_body", "variant"))))
    return rows.select("slug", "idx", string("type").alias("type"), string("text").alias("text"), items.alias("list_items"), box.alias("bbox"), body.alias("table_body"))


def rule_files(spark: SparkSession, glob: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rule sets, quarantined files) of per-book YAML files, one task reads many, none is held by the driver.

    Rule sets: slug (the file's folder), the fields of schema, and faults, what
    `rules.faults` says of each.  A file whose folder is no slug, that does not parse or
    is no mapping is quarantined with its text and the reason.
    """
    seen = judged_rules(spark.read.text(glob, wholetext=True).select(slug_of(F.col("_metadata.file_path")).alias("folder"), "value"), schema)
    return seen.where("reason is null").select(F.col("folder").alias("slug"), "r.*", "faults"), seen.where("reason is not null").select("folder", "reason", "value")


def packed_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`judged_rules` of many books' YAML texts in files of JSON Lines (folder, value), as `pack_rules` writes them."""
    return judged_rules(spread(spark.read.schema("folder string, value string").json(path)), schema)


def pack_rules(texts: DataFrame, path: str) -> None:
    """YAML texts (folder, value), a line each: their number makes the files longer, not more."""
    texts.select("folder", "value").write.json(path)


def judged_rules(texts: DataFrame, schema: str) -> DataFrame:
    """folder, value, reason (why a text is no rule set, else null), r (a struct of the fields of schema) and faults; each text is parsed once."""
    from inkstrata.operators.rules import checked

    seen = texts.withColumn("c", checked("value"))
    bad = F.when(~F.coalesce(valid_slug(F.col("folder")), F.lit(False)), "invalid slug").otherwise(F.col("c.error"))
    return seen.select("folder", "value", bad.alias("reason"), F.from_json("c.rule", schema).alias("r"), F.col("c.faults").alias("faults"))


def _fields() -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in BLOCK_SCHEMA:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def json_records(spark: SparkSession, glob: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with their file's stem as slug, quarantined rows with the raw text) of one-record files."""
    raw = spark.read.text(glob, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json[l]?$", 1).alias("slug"), "value")
    both = raw.withColumn("r", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    return both.where(~bad).select("slug", "r.*").drop("_corrupt"), both.where(bad).select("slug", "value")


def json_lines(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON Lines with the session (file stem) they belong to; lines that do not parse are dropped."""
    raw = spark.read.text(glob).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1).alias("session"), "value")
    return raw.select("session", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r._corrupt is null").select("session", "r.*").drop("_corrupt")


def books(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Book records whose own slug equals their folder."""
    raw = spark.read.schema(schema).json(glob, multiLine=True).withColumn("_folder", slug_of(F.col("_metadata.file_path"), 3))
    return raw.where("slug = _folder").drop("_folder")


def rules(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """Per-book rule sets as a frame; scalar heading levels become arrays."""
    rows = [{**r, "heading_text_level": r.get("heading_text_level", 1) if isinstance(r.get("heading_text_level", 1), list) else [r.get("heading_text_level", 1)]} for r in records]
    return spark.createDataFrame(rows, schema)


def with_rules(frame: DataFrame, rule_frame: DataFrame) -> DataFrame:
    """Books without a valid rule set keep null rules."""
    return frame.join(rule_frame, "slug", "left")


def tail(lines: DataFrame, position: str, n: int) -> DataFrame:
    """The last n rows by position, in ascending order."""
    return lines.orderBy(F.desc(position)).limit(n).orderBy(position)


def changed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, modified, size) fingerprint is not in the manifest."""
    return found.join(manifest, ["path", "modified", "size"], "left_anti")


def publish(df: DataFrame, path: str, *by: str) -> None:
    """Write with Spark's commit protocol; with `by`, only the partitions present in df are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write wins by `at`; both frames have the same columns."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at))
    return base.unionByName(fresh).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def replace_field(base: DataFrame, edits: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Point updates of one field by key, copy-on-write: edits hold the keys and `new`."""
    return base.join(edits.select(*keys, F.col("new").alias("_new")), keys, "left").withColumn(field, F.coalesce("_new", field)).drop("_new").select(*base.columns)
