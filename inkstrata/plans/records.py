"""Readers and writers round-tripped through the shared folder, typed blocks, ids, repair, proposals and listings over the driver tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from inkstrata import sources as src
from inkstrata.functions import external, mathx as M
from inkstrata.functions import numbers as N
from inkstrata.functions import text as T
from inkstrata.functions import web
from inkstrata.operators import catalogs as C
from inkstrata.operators import listings as L
from inkstrata.operators import repair as Q
from inkstrata.operators import reports as R
from inkstrata.operators import rules as V
from inkstrata.operators import segment as G
from inkstrata.operators import state as P
from inkstrata.operators import universe as U
from inkstrata.plans.derived import NUMBER_RAW, _items, _parts, _s, _turn, no_text, number_raw, p_brand, p_key, p_name, p_size, p_type
from inkstrata.plans.registry import query
from inkstrata.sources import read
from inkstrata.streaming import changes


def _folder(spark, name: str) -> str:
    return f"{src.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Readers: files are written from a whole table first, broken and foreign ones among them.


@query("SELECT 'b' || (p_partkey // 500) AS slug, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS idx, CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'list' END AS type, CASE WHEN p_size % 2 = 0 THEN p_name END AS text, CASE WHEN p_size % 2 = 1 THEN p_brand || '|' || p_name END AS items FROM part")
def unified_blocks(spark, d):
    """One JSON array per book (a book is a range of 500 keys); folders with bad names and texts that are no JSON give nothing."""
    path, p = _folder(spark, "unified"), _parts(spark, d)
    block = F.struct(p_key().alias("k"), F.when(p_size() % 2 == 0, "text").otherwise("list").alias("type"), F.when(p_size() % 2 == 0, p_name()).alias("text"), F.when(p_size() % 2 == 1, F.array(p_brand(), p_name())).alias("list_items"))
    books = p.groupBy(F.floor(p_key() / 500).alias("book")).agg(F.to_json(F.array_sort(F.collect_list(block))).alias("value"))
    copies = F.explode(F.array(*[F.struct(F.concat(F.lit(name), F.col("book").cast("string")).alias("slug"), value.alias("value")) for name, value in (("b", F.col("value")), ("Bad ", F.col("value")), ("broken", F.lit('[{"type": ')))]))
    books.select(copies.alias("c")).select("c.*").write.partitionBy("slug").text(path)
    return src.blocks(spark, f"{path}/*/part-*").select("slug", F.col("idx").cast("long").alias("idx"), "type", "text", F.array_join("list_items", "|").alias("items")).where("idx is not null")


@query("SELECT 'good' AS kind, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'bad', NULL, NULL FROM region")
def quarantined_records(spark, d):
    """One record per file; records that do not parse are set aside."""
    path = _folder(spark, "records")
    read(spark, d, "nation").write.option("maxRecordsPerFile", 1).json(f"{path}/good")
    read(spark, d, "region").select(F.concat(F.lit('{"n_name": "'), "r_name").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/bad")
    good, bad = src.json_records(spark, f"{path}/*/part-*", "n_name string, n_regionkey int")
    return good.select(F.lit("good").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).union(bad.select(F.lit("bad"), no_text(), F.lit(None).cast("int")))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def session_lines(spark, d):
    """JSON Lines of events; the lines of errors are cut short and so dropped."""
    path, e = _folder(spark, "lines"), read(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    e.select(F.when(F.col("event_type") == "error", F.left(line, F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    return src.json_lines(spark, f"{path}/part-*", "event_id long, user_id long, event_type string").select("event_id", "user_id", "event_type")


@query("SELECT lower(p_type) AS slug, count(*) AS books FROM part WHERE p_type <> 'PROMO' GROUP BY 1")
def listed_books(spark, d):
    """Book records whose own slug is that of their folder; the promo folder holds records of another."""
    path, p = _folder(spark, "books"), _parts(spark, d)
    own = F.when(p_type() == "PROMO", "other").otherwise(F.lower(p_type()))
    p.groupBy(F.lower(p_type()).alias("folder"), own.alias("slug")).agg(F.count(F.lit(1)).alias("books")).withColumn("part", F.lit("bake")).write.partitionBy("folder", "part").json(path)
    return src.books(spark, f"{path}/*/*/part-*", "slug string, books long")


@query("SELECT n_name AS slug, CASE n_regionkey WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '3' END AS levels FROM nation")
def books_with_rules(spark, d):
    """Rule sets by book; scalar levels become lists, books without a valid set keep none."""
    rules = [{"slug": s, "heading_text_level": x} for s, x in (("0", 1), ("1", [1, 2]), ("2", 3))]
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("slug"))
    out = src.with_rules(n, src.rules(spark, rules, "slug string, heading_text_level array<int>"))
    return out.select(F.col("name").alias("slug"), F.array_join("heading_text_level", ",").alias("levels"))


@query("""
    WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'equation' ELSE 'note' END AS type, CASE WHEN p_size % 3 > 0 THEN 'x-' || p_partkey END AS id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS label, CASE WHEN p_size % 5 = 0 THEN 'ch07' ELSE 'ch' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS chunk_key FROM part)
    SELECT p_partkey, type, id AS anchor, chunk_key FROM e WHERE (type IN ('figure', 'table') AND id IS NOT NULL) OR (type = 'equation' AND label IS NOT NULL)
""")
def normalized_catalogues(spark, d):
    """Catalogue entries with anchors and chunk keys filled in; only visible ones."""
    kind = F.when(p_key() % 4 == 0, "figure").when(p_key() % 4 == 1, "table").when(p_key() % 4 == 2, "equation").otherwise("note")
    e = _parts(spark, d).select("p_partkey", kind.alias("type"), F.when(p_size() % 3 > 0, _s("x-", p_key())).alias("id"), F.when(p_size() % 2 == 0, p_size().cast("string")).alias("label"), no_text().alias("anchor"), F.when(p_size() % 5 == 0, "ch07").alias("chunk_key"), _s("body/ch", F.lpad(p_size().cast("string"), 2, "0"), ".json").alias("source"))
    return C.normalized(e).select("p_partkey", "type", "anchor", "chunk_key")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, row_number() OVER (ORDER BY c_nationkey, CAST(c_custkey AS VARCHAR)) + 10000 AS place FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def discovered_targets(spark, d):
    """Customers without any order, after all listed ones."""
    t = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_nationkey").alias("field_id"))
    return R.known_gaps(t, read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("slug"))).select("slug", F.col("order").cast("long").alias("place"))


# Writers: written, written over and read again.


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#3', 'Brand#5') THEN p_size + 100 ELSE p_size END AS p_size, p_brand FROM part")
def published_partitions(spark, d):
    """Only the partitions that come again are replaced."""
    path, p = _folder(spark, "published"), _parts(spark, d).select("p_partkey", "p_size", "p_brand")
    src.publish(p, path, "p_brand")
    src.publish(p.where(p_brand().isin("Brand#3", "Brand#5")).withColumn("p_size", p_size() + 100), path, "p_brand")
    return spark.read.schema("p_partkey long, p_size int, p_brand string").parquet(path)


@query("SELECT c_custkey, c_name || ' v2' AS c_name FROM customer")
def published_whole(spark, d):
    """A second write replaces the first as a whole."""
    path, c = _folder(spark, "replaced"), read(spark, d, "customer").select("c_custkey", "c_name")
    src.publish(c.union(c), path)
    src.publish(c.withColumn("c_name", _s(F.col("c_name"), " v2")), path)
    return spark.read.schema(c.schema).parquet(path)


# Typed blocks and ids.


def _raw_blocks(spark, d):
    none = F.array().cast("array<string>")
    kind = _turn(p_key(), *[F.lit(x) for x in ("text", "list", "equation", "image", "chart", "table", "code", "header")])
    return _parts(spark, d).select(
        "p_partkey",
        "p_size",
        kind.alias("type"),
        F.when(kind == "text", _s(" ", p_name(), " ")).when(kind == "equation", _s("$$\nx = ", p_size(), " \\tag{", p_size(), ".1}\n$$")).alias("text"),
        F.when(kind == "list", F.array(_s(" ", p_name()), F.lit(" "), p_brand())).otherwise(none).alias("list_items"),
        F.when(kind.isin("image", "chart"), _s("images/", p_key(), ".jpg")).alias("img_path"),
        F.when(kind == "image", F.array(_s("Fig. ", p_size(), ".", p_key()), p_name())).otherwise(none).alias("image_caption"),
        F.when(kind == "chart", F.array(F.lit("no label"))).otherwise(none).alias("chart_caption"),
        F.when(kind == "table", F.array(_s("Table ", p_size(), "-2 "), p_name())).otherwise(none).alias("table_caption"),
        F.when(kind == "table", F.array(F.lit("a"), F.lit(""), F.lit(" b "))).otherwise(none).alias("table_footnote"),
        F.when(kind == "table", _s("<table>", p_key(), "</table>")).alias("table_body"),
        F.when(kind == "code", _s("a < ", p_size(), " & b")).alias("code_body"),
        none.alias("code_caption"),
        no_text().alias("content"),
        F.when(kind == "image", F.lit("natural_image")).alias("sub_type"),
        F.when(kind == "image", F.array(F.lit("0"), F.lit("0"), (2 * p_size()).cast("string"), p_size().cast("string"))).otherwise(none).alias("bbox"),
    )


@query(r"""
    SELECT p_partkey, ['p', 'p', 'eq', 'fig', 'fig', 'table', 'table'][p_partkey % 8 + 1] AS t, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || chr(10) || p_brand END AS md, CASE p_partkey % 8 WHEN 2 THEN 'x = ' || p_size END AS tex, CASE p_partkey % 8 WHEN 2 THEN p_size || '.1' END AS label,
      CASE WHEN p_partkey % 8 IN (3, 4) THEN p_partkey || '.jpg' END AS src, CASE p_partkey % 8 WHEN 3 THEN 'photo' WHEN 4 THEN 'line' END AS kind, CAST(CASE p_partkey % 8 WHEN 3 THEN 2.0 END AS DOUBLE) AS aspect, CASE p_partkey % 8 WHEN 5 THEN '<table>' || p_partkey || '</table>' WHEN 6 THEN '<pre><code>a &lt; ' || p_size || ' &amp; b</code></pre>' END AS html,
      CASE p_partkey % 8 WHEN 3 THEN 'Fig. ' || p_size || '.' || p_partkey || ' ' || p_name WHEN 4 THEN 'no label' WHEN 5 THEN 'Table ' || p_size || '-2 ' || p_name END AS caption, CASE p_partkey % 8 WHEN 5 THEN 'a b' END AS footnote, CASE p_partkey % 8 WHEN 3 THEN 'fig-' || p_size || '.' || p_partkey WHEN 5 THEN 'tbl-' || p_size || '.2' END AS id
    FROM part WHERE p_partkey % 8 < 7
""")
def typed_blocks(spark, d):
    """Raw blocks of every type as typed ones; a header gives none."""
    return G.to_struct(_raw_blocks(spark, d)).select("p_partkey", "t", "md", "tex", "label", "src", "kind", "aspect", "html", "caption", "footnote", "id")


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || chr(10) || p_brand WHEN 2 THEN '$x = ' || p_size || '$' WHEN 3 THEN 'Fig. ' || p_size || '.' || p_partkey || ' ' || p_name WHEN 4 THEN 'no label' WHEN 5 THEN 'Table ' || p_size || '-2 ' || p_name || ' a b' ELSE '' END AS said FROM part WHERE p_partkey % 8 < 7")
def block_texts(spark, d):
    """What each typed block says."""
    b = G.to_struct(_raw_blocks(spark, d))
    return b.select("p_partkey", T.block_text(F.col("t"), no_text(), F.col("md"), F.col("tex"), F.col("caption"), F.col("footnote"), F.col("id")).alias("said"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN 'eq-ch01-' || p_size || '.1' WHEN 3 THEN 'fig-' || p_size || '.' || p_partkey WHEN 4 THEN 'fig-ch01-' || p_partkey WHEN 5 THEN 'tbl-' || p_size || '.2' WHEN 6 THEN 'tbl-ch01-' || p_partkey END AS id FROM part WHERE p_partkey % 8 BETWEEN 2 AND 6")
def media_ids(spark, d):
    """Reader ids by caption, label or place."""
    b = G.to_struct(_raw_blocks(spark, d)).where("t <> 'p'")
    return b.select("p_partkey", G.media_id(F.col("t"), F.col("caption"), F.col("label"), F.lit("ch01"), F.lit("body"), p_key()).alias("id"))


@query("""
    SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN 'equation' WHEN 3 THEN 'figure' WHEN 4 THEN 'figure' ELSE 'table' END AS type, CASE p_partkey % 8 WHEN 2 THEN 'eq-' || p_size || '.1' WHEN 3 THEN 'fig-' || p_size || '.' || p_partkey WHEN 5 THEN 'tbl-' || p_size || '.2' END AS id FROM part WHERE p_partkey % 8 BETWEEN 2 AND 6
""")
def semantic_ids(spark, d):
    """Type and id that a reader sees."""
    b = G.to_struct(_raw_blocks(spark, d)).where("t <> 'p'")
    t, c, i = F.col("t"), F.col("caption"), F.coalesce("id", _s("fig-ch01-", p_key()))
    return b.select("p_partkey", C.semantic_type(t, c, F.when(t == "fig", i).otherwise(F.col("id"))).alias("type"), C.semantic_id(t, c, F.when(t != "eq", i), F.col("label"), F.col("tex")).alias("id"))


@query(f"""
    WITH {NUMBER_RAW}, i AS (SELECT event_id, ['fig-', 'tbl-', 'eq-', 'fig-ch', 'tbl-app'][event_id % 5 + 1] || raw AS id FROM n)
    SELECT event_id, CASE WHEN regexp_matches(id, '^(fig|tbl)-') AND NOT regexp_matches(id, '{N.FALLBACK}') THEN left(id, 4) || regexp_replace(substr(id, 5), '[-–—]', '.', 'g') ELSE id END AS id FROM i
""")
def canonical_ids(spark, d):
    """Ids put together from an event's numbers: positional ones stay, the others get a canonical number."""
    kind = F.get(F.array(*map(F.lit, ("fig-", "tbl-", "eq-", "fig-ch", "tbl-app"))), (F.col("event_id") % 5).cast("int"))
    return read(spark, d, "events").select("event_id", N.canonical_id(F.concat(kind, number_raw())).alias("id"))


@query("SELECT p_brand AS slug, 'a' || p_partkey AS anchor, 'figure' AS type, 'f' || p_size AS id FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_brand, 'a' || p_partkey, 'table', 't' || p_size FROM part WHERE p_partkey % 3 = 1")
def catalogue_aliases(spark, d):
    """Rows of alias lists with an id; a missing type is figure."""
    kind = "array<struct<type:string,id:string>>"
    one, two = F.struct(no_text().alias("type"), _s(" f", p_size(), " ").alias("id")), F.struct(F.lit("table").alias("type"), _s("t", p_size()).alias("id"))
    rows = _turn(p_key(), F.array(one, F.struct(F.lit("figure").alias("type"), F.lit(" ").alias("id"))), F.array(one, two), F.array().cast(kind))
    return C.aliases(_parts(spark, d).select(p_brand().alias("slug"), _s("a", p_key()).alias("anchor"), rows.alias("aliases"))).select("slug", "anchor", "type", "id")


@query("""
    SELECT p_brand AS slug, p_partkey AS stem, 'ch:body[0]' AS place, 0 AS occ, p_name AS text FROM part UNION ALL SELECT p_brand, p_partkey, 'ch:problem[' || p_size || '].body[0]', 0, 'q' FROM part UNION ALL SELECT p_brand, p_partkey, 'ch:problem[' || p_size || '].body[0]', 1, 'again' FROM part UNION ALL SELECT p_brand, p_partkey, 'ch:problem[' || p_size || '].solution[0]', 0, p_type FROM part
""")
def flattened_chunks(spark, d):
    """Nested chunks as rows with locators; a repeated problem number has its own count."""
    def blocks(*texts):
        return F.array(*[F.struct(t.alias("text")) for t in texts]) if texts else F.array().cast("array<struct<text:string>>")

    def problem(body, solution):
        return F.struct(p_size().cast("string").alias("num"), body.alias("body"), solution.alias("solution"))

    c = _parts(spark, d).select(p_brand().alias("slug"), _s("ch", p_key()).alias("stem"), blocks(p_name()).alias("body"), F.array(problem(blocks(F.lit("q")), blocks(p_type())), problem(blocks(F.lit("again")), blocks())).alias("problems"))
    out = G.flatten_chunks(c)
    return out.select("slug", F.substr("stem", F.lit(3)).cast("long").alias("stem"), F.regexp_replace("locator", "^ch[0-9]+", "ch").alias("place"), "occ", "text")


@query("SELECT p_partkey AS slug, CAST(idx AS BIGINT) AS idx, num, part, text FROM part, (VALUES (1, '1', 'body', 'alpha'), (2, '1', 'body', 'more'), (3, '2', 'body', NULL), (4, '2', 'body', '1. back')) v(idx, num, part, t), LATERAL (SELECT coalesce(t, p_name) AS text)")
def split_items_machine(spark, d):
    """The event machine for chapters whose events depend on each other; a section end stops the region."""
    import re

    def make():
        return {"start": re.compile(r"^(?:Problem )?([0-9]+)\.? "), "end": re.compile("^Section")}

    b = _items(spark, d).withColumn("type", F.lit("text")).withColumn("text_level", F.lit(1)).withColumn("chapter", F.lit(1))
    return G.split_items_exact(b, ["slug"], "chapter", make).select("slug", "idx", "num", "part", "text")


@query("SELECT p_brand AS slug, kind, min(p_partkey) AS pos FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'bibliography' END AS kind FROM part) WHERE kind IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT p_brand, 'appendix', p_partkey FROM part WHERE p_size % 4 = 2")
def boundary_headings(spark, d):
    text = F.when(p_size() % 4 == 0, " Subject Index").when(p_size() % 4 == 1, "REFERENCES").when(p_size() % 4 == 2, _s("Appendix ", p_name())).otherwise(p_name())
    return G.boundaries(_parts(spark, d).select(p_brand().alias("slug"), p_key().alias("pos"), text.alias("text")), ["slug"], "pos")


# Formulas, snippets and settings.


@query(r"""
    SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'a^{' || p_size || ' ' || p_name || '}' WHEN 1 THEN 'x_{1 ' || p_partkey || '}' WHEN 2 THEN 'a \times ' || p_size WHEN 3 THEN 'f ' || p_size WHEN 4 THEN '(' || p_size || ')' WHEN 5 THEN '\underline{\angle ' || p_size || '}' WHEN 6 THEN 'x \tag{' || p_size || '}' ELSE p_name END AS tex FROM part
""")
def repaired_tex(spark, d):
    """Doubled scripts, conditional times, group noise, delimiters, angles and tags."""
    raw = _turn(p_key(), _s("a^{", p_size(), "}^{", p_name(), "}"), _s("x_{1}_{", p_key(), "}"), _s("a \\ifmmode\\times\\else\\texttimes\\fi ", p_size()), _s("f\\mathopen{}\\mathclose\\bgroup ", p_size(), "\\aftergroup\\egroup"), _s("\\(", p_size(), "\\)"), _s("\\underline{\\left/ ", p_size(), " \\left. \\right.}"), _s("x \\tag{$", p_size(), "$}"), p_name())
    return _parts(spark, d).select("p_partkey", M.normalized(raw).alias("tex"))


@query(r"SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' $a^{1 ' || p_size || '}$ b^{1}^{2}' WHEN 1 THEN ' $$x_{1 2}$$ end' ELSE ' a^{1}^{2}' END AS md FROM part")
def repaired_inline(spark, d):
    """Repair inside dollar regions only."""
    raw = _s(p_name(), _turn(p_key(), _s(" $a^{1}^{", p_size(), "}$ b^{1}^{2}"), F.lit(" $$x_{1}_{2}$$ end"), F.lit(" a^{1}^{2}")))
    return _parts(spark, d).select("p_partkey", M.normalize_md(raw).alias("md"))


@query(r"""
    SELECT p_partkey, length(p_name) + 1 AS start, length(p_name) + 2 + length(CAST(p_size AS VARCHAR)) + 1 AS stop, CAST(p_size AS VARCHAR) AS inner_, false AS display FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 0, 4 + length(p_name), p_name, true FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, length(p_name) + 7, length(p_name) + 12, 'y', true FROM part WHERE p_partkey % 3 = 1
""")
def located_formulas(spark, d):
    """Places of inline and display formulas; a dollar that does not close on its line opens none."""
    raw = _turn(p_key(), _s(p_name(), " $", p_size(), "$ end"), _s("$$", p_name(), "$$ - \\[y\\]"), _s(p_name(), " costs $", p_size(), "\nand $"))
    r = _parts(spark, d).select("p_partkey", F.explode(M.math_regions(raw)).alias("r"))
    return r.select("p_partkey", F.col("r.start").cast("long").alias("start"), F.col("r.stop").cast("long").alias("stop"), F.col("r.inner").alias("inner_"), "r.display")


@query(r"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'left=2 right=1' WHEN 1 THEN NULL ELSE 'left=0 right=1' END AS fault, p_partkey % 3 = 2 AS leaks FROM part")
def formula_faults(spark, d):
    """left without right, and TeX outside formulas."""
    raw = _turn(p_key(), _s("$\\left( \\left[ ", p_size(), " \\right)$"), _s("$\\left( ", p_name(), " \\right)$"), _s(p_name(), " \\right) "))
    return _parts(spark, d).select("p_partkey", M.left_right_fault(raw).alias("fault"), M.leaks_tex(raw).alias("leaks"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Thé <mark>vénin</mark> &amp; ' || p_name ELSE p_name || ' none' END AS snippet, p_size % 2 = 0 AS hit FROM part")
def marked_snippets(spark, d):
    """Hits are found in the folded text and marked in the original; the verification takes the folded text."""
    raw = F.when(p_size() % 2 == 0, _s("Thé  vénin & ", p_name())).otherwise(_s(p_name(), " none"))
    return _parts(spark, d).select("p_partkey", T.snippet(["venin"])(raw).alias("snippet"), T.matches_all(T.fold(raw), ["the", "venin"]).alias("hit"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type ELSE 'SMALL' END AS size, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) WHEN p_size > 10 THEN 0.5 ELSE 0.0 END AS ratio, CASE WHEN p_retailprice < 1024 THEN CAST(round(p_retailprice, 1) AS VARCHAR) || 'B' ELSE CAST(round(p_retailprice / 1024.0, 1) AS VARCHAR) || 'KB' END AS human FROM part")
def reader_settings(spark, d):
    """A setting that is not allowed falls back; the furthest place counts before the scroll; sizes for people."""
    return _parts(spark, d).select("p_partkey", web.setting(p_type(), ["SMALL", "LARGE"], "SMALL").alias("size"), web.progress_ratio(F.when(p_size() > 25, p_size().cast("double")), F.when(p_size() > 10, F.lit(0.5))).alias("ratio"), N.human_bytes(F.col("p_retailprice")).alias("human"))


@query("SELECT p_partkey, CASE WHEN p_size < 3 THEN 0 WHEN p_size <= 15 THEN 1 WHEN p_size <= 35 THEN 2 ELSE 3 END AS at, CASE p_partkey % 2 WHEN 0 THEN p_size * 1000000 + p_partkey * 100 + 2 END AS key FROM part")
def nearest_and_keys(spark, d):
    """The nearest step (1, 5, 25, 45; the first of equals), and the sort key of a number."""
    k = N.number_key(F.when(p_key() % 2 == 0, _s(p_size(), ".", p_key(), "b")).otherwise(p_name()))
    at = N.nearest_index(F.array(*map(F.lit, (1, 4, 26, 45))), p_size())
    return _parts(spark, d).select("p_partkey", at.alias("at"), (k["a"].cast("long") * 1_000_000 + k["b"] * 100 + k["c"]).alias("key"))


@query("SELECT DISTINCT p_name AS tex, p_size % 2 = 0 AS display, CASE WHEN p_name LIKE '%r%' THEN 'none' ELSE 'ok' END AS said FROM part")
def scored_formulas(spark, d):
    """An external process answers JSON lines; what it does not answer is unknown."""
    import sys

    code = "import sys, json\nfor l in sys.stdin:\n    v = json.loads(l)\n    if 'r' not in v['s']:\n        print(json.dumps({'i': v['i'], 'ok': True}))\n    else:\n        print('noise')"
    out = external.scored(_parts(spark, d).select(p_name().alias("tex"), (p_size() % 2 == 0).alias("display")), [sys.executable, "-c", code])
    return out.select("tex", "display", F.when(F.col("ok"), "ok").otherwise("none").alias("said"))


# Repair of captions.


@query("""
    SELECT p_partkey, ['self', 'context', 'id', 'generated'][p_partkey % 4 + 1] AS source, CASE p_partkey % 4 WHEN 0 THEN 'fig-' || p_size || '.1' WHEN 1 THEN 'fig-' || p_size || '.2' WHEN 2 THEN 'fig-' || p_size || '.3' END AS id,
      CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'near ' || p_name WHEN 2 THEN 'kept' ELSE 'Figure 2 of problem ' || p_size END AS caption, p_partkey % 4 IN (0, 1, 3) AS needs FROM part
""")
def repaired_captions(spark, d):
    """Own reference, then context, then a semantic id, else a made caption; and whether a repair is due."""
    own, near = _turn(p_key(), _s("Figure ", p_size(), ".1 ", p_name()), p_name(), p_name(), p_name()), _turn(p_key(), no_text(), _s("see Fig. ", p_size(), ".2 near ", p_name()), no_text(), no_text())
    ident, caption = F.when(p_key() % 4 == 2, _s("fig-", p_size(), ".3")).when(p_key() % 4 == 3, "fig-ch01-4"), F.when(p_key() % 4 == 2, "kept")
    made = Q.made_caption("fig", F.lit("problem"), p_size().cast("string"), F.lit(2))
    i, c, s = Q.repaired("fig", Q.reference("fig", own), Q.reference("fig", near), ident, caption, made)
    return _parts(spark, d).select("p_partkey", s.alias("source"), i.alias("id"), c.alias("caption"), Q.needs_repair(caption, ident, no_text(), own).alias("needs"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'fig' WHEN 1 THEN 'table' END AS kind, CASE p_partkey % 3 WHEN 0 THEN p_size || '.1' WHEN 1 THEN p_size || '.2' END AS num, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS caption, CASE p_partkey % 3 WHEN 0 THEN 12 + greatest(0, 8 - 2 * (p_size % 5)) + 6 ELSE greatest(0, 8 - 2 * (p_size % 5)) END AS score FROM part")
def leading_references(spark, d):
    """A text that begins with a reference, and how well it fits a figure at a distance."""
    text = _turn(p_key(), _s(" Figure ", p_size(), "-1: ", p_name()), _s("Table ", p_size(), ".2 ", p_name()), _s(p_name(), " Figure ", p_size(), ".1"))
    return _parts(spark, d).withColumn("r", Q.leading_reference(text)).select("p_partkey", "r.kind", "r.num", "r.caption", Q.score("fig", text, p_size() % 5).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS n, 'f' || p_size AS first FROM part")
def added_aliases(spark, d):
    """An alias that is there already is not added."""
    have = F.array(F.struct(F.lit("figure").alias("type"), _s("f", p_size()).alias("id"), F.lit("old").alias("source")))
    out = Q.with_alias(have, F.lit("figure"), F.when(p_key() % 2 == 0, _s("f", p_size())).otherwise(_s("g", p_size())), F.lit("new"))
    return _parts(spark, d).select("p_partkey", F.size(out).alias("n"), F.element_at(out, 1)["id"].alias("first"))


@query("SELECT p_brand, p_size, pos, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS k FROM (SELECT p_brand, p_size, min(p_partkey) AS pos FROM part GROUP BY 1, 2)")
def distinct_references(spark, d):
    return Q.distinct_refs(_parts(spark, d).select("p_brand", "p_size", p_key().alias("pos")), ["p_brand"], "p_size", "pos").select("p_brand", "p_size", "pos", F.col("k").cast("long").alias("k"))


@query("SELECT p_partkey * 1.0 AS ord, p_name AS text FROM part UNION ALL SELECT p_partkey + 0.5, 'after ' || p_name FROM part WHERE p_size > 40")
def inserted_blocks(spark, d):
    """Rows put after others by a fractional order."""
    p = _parts(spark, d)
    return C.insert_after(p.select(p_key().alias("ord"), p_name().alias("text")), p.where(p_size() > 40).select(p_key().alias("ord"), _s("after ", p_name()).alias("text")))


# Proposals, health, listings.


def _proposals(spark, d):
    k = F.col("o_orderkey")
    domain, kind = _turn(k, F.lit("math"), F.lit("catalog"), F.lit("sol"), F.lit("engine")), F.when(k % 12 == 3, "tooling-gap").otherwise("bug")
    title = F.when(k % 8 == 3, "Captions of figures").otherwise(F.col("o_orderpriority"))
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "P", "parked").otherwise("accepted")
    return read(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("slug"), domain.alias("domain"), kind.alias("type"), title.alias("title"), status.alias("status"), R.caption_gap(title, kind).alias("caption_gap"), F.col("o_orderdate").alias("created"))


VERDICTS = """
    n AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS occ FROM lineitem GROUP BY 1),
    p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'parked' ELSE 'accepted' END AS status, ['math', 'catalog', 'sol', 'engine'][o_orderkey % 4 + 1] AS domain, o_orderkey % 12 = 3 AND o_orderkey % 8 = 3 AS gap, occ, CASE WHEN c_nationkey < 20 THEN CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END END AS critical FROM orders LEFT JOIN n ON n.id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
    v AS (SELECT *, CASE WHEN domain = 'math' THEN CASE WHEN occ IS NULL THEN 'inconclusive' WHEN occ = 0 THEN 'resolved' ELSE 'live' END WHEN domain = 'catalog' OR gap THEN CASE WHEN critical IS NULL THEN 'inconclusive' WHEN critical = 0 THEN 'resolved' ELSE 'live' END ELSE 'inconclusive' END AS verdict FROM p)"""


def _verdicts(spark, d):
    live = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("live_occ"))
    critical = read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("slug"), (F.col("c_acctbal") < 0).cast("int").alias("critical"))
    return R.verify(_proposals(spark, d), live, critical)


@query(f"WITH {VERDICTS} SELECT id, verdict FROM v")
def verified_proposals(spark, d):
    """Formulas by their live occurrences, catalogues and caption gaps by critical findings, others inconclusive."""
    return _verdicts(spark, d)


@query(f"WITH {VERDICTS} SELECT id, CASE WHEN verdict = 'resolved' AND status = 'proposed' THEN 'superseded' ELSE status END AS status FROM v")
def superseded_proposals(spark, d):
    return R.superseded(_proposals(spark, d), _verdicts(spark, d)).select("id", "status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'accepted' WHEN o_orderstatus = 'O' THEN 'proposed' ELSE 'accepted' END AS status FROM orders")
def resolved_many(spark, d):
    """All parked proposals change at once; the job fails if any may not."""
    p = _proposals(spark, d)
    return P.change_status(p, p.where("status = 'parked'"), "accepted", ["parked"]).select("id", "status")


@query("WITH p AS (SELECT o_orderkey AS id, o_orderdate AS made, o_orderstatus <> 'F' AS open FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY made DESC, id) AS n FROM p WHERE NOT open) SELECT id, open FROM p WHERE open UNION ALL SELECT id, open FROM r WHERE n <= 30")
def proposals_shown(spark, d):
    """All open proposals and the latest thirty resolved ones."""
    rows = _proposals(spark, d).withColumn("updated", F.col("created"))
    return R.proposals_feed(rows, 30).select("id", F.col("status").isin("proposed", "parked").alias("open"))


@query("""
    WITH p AS (SELECT o_orderkey AS k, ['math', 'catalog', 'sol', 'engine'][o_orderkey % 4 + 1] AS domain, CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'parked' ELSE 'accepted' END AS status FROM orders)
    SELECT k, 'id' AS fault FROM p WHERE k % 7 = 0 UNION ALL SELECT k, 'domain' FROM p WHERE domain = 'engine' UNION ALL SELECT k, 'no resolution' FROM p WHERE status = 'accepted' UNION ALL SELECT k, 'unblock' FROM p WHERE status = 'parked' AND k % 2 = 1
""")
def linted_proposals(spark, d):
    """Shape of ids, domains, statuses, resolutions and unblocks."""
    p = _proposals(spark, d).withColumn("k", F.col("id")).withColumn("id", F.when(F.col("k") % 7 == 0, F.col("k").cast("string")).otherwise(_s("P-2024-01-01-n", F.col("k"))))
    p = p.withColumn("resolution", no_text()).withColumn("type", F.lit("bug")).withColumn("unblock_kind", F.when(F.col("k") % 2 == 0, "rule"))
    return R.lint(p, {"math": ["bug"], "catalog": ["bug"], "sol": ["bug"]}, ["rule"], ["R1"]).select(F.regexp_extract("id", "([0-9]+)$", 1).cast("long").alias("k"), "fault")


@query("""
    WITH l AS (SELECT c_custkey AS slug, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 1 ELSE -c_custkey END AS link_id FROM customer) SELECT c_custkey AS slug, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 3 = 2 THEN 'conflict' ELSE 'added' END AS outcome FROM customer
""")
def link_commits(spark, d):
    """A link that another work has is a conflict, one that the work has is kept."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer")
    links = c.select(k.alias("slug"), F.when(k % 3 == 0, k).when(k % 3 == 1, k + 1).otherwise(-k).alias("link_id"))
    links = links.unionByName(c.select(k.alias("slug"), (-k).alias("link_id"))).unionByName(c.select((k - 1).alias("slug"), k.alias("link_id")).where("link_id % 3 = 2"))
    return R.valid_commit(c.select(k.alias("slug"), k.alias("link_id")), links).select("slug", "outcome")


@query("SELECT max(ts) FILTER (event_type = 'click') AS last_start, max(ts) FILTER (event_type = 'view') AS last_end, max(ts) FILTER (event_type = 'click') > max(ts) FILTER (event_type = 'view') AS running FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events)".replace("max(ts) FILTER (event_type = 'click') AS last_start", "epoch_us(max(ts) FILTER (event_type = 'click')) AS last_start").replace("max(ts) FILTER (event_type = 'view') AS last_end", "epoch_us(max(ts) FILTER (event_type = 'view')) AS last_end"))
def loop_health(spark, d):
    """Last start and end marks of a log."""
    mark = F.when(F.col("event_type") == "click", "loop start").when(F.col("event_type") == "view", "loop end").otherwise(F.col("event_type"))
    lines = read(spark, d, "events").select(mark.alias("line"), F.date_trunc("second", "ts").alias("at"))
    return R.daemon_health(lines, 600, F.lit("2024-02-01 00:00:00").cast("timestamp")).select(F.unix_micros("last_start").alias("last_start"), F.unix_micros("last_end").alias("last_end"), "running")


@query("SELECT count(*) AS done, round(count(*) / (CAST(epoch(max(date_trunc('second', ts))) AS BIGINT) - CAST(epoch(min(date_trunc('second', ts))) AS BIGINT)) * 60, 3) AS per_min FROM events")
def batch_progress(spark, d):
    return R.progress_line(read(spark, d, "events").withColumn("ts", F.date_trunc("second", "ts")), 1_000_000, "ts").select("done", "per_min")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 200")
def kept_history(spark, d):
    """The newest rows of a log that is kept short."""
    return R.kept_newest(read(spark, d, "events"), ["ts", "event_id"], 200).select("event_id", "user_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '>' || p_type END AS chain FROM part")
def provider_chains(spark, d):
    """A chain with an unknown provider, or none at all, is not valid."""
    brands = [f"Brand#{k}" for k in range(100)]
    chain = _turn(p_key(), F.array(p_brand(), p_type()), F.array(p_brand(), F.lit("unknown")), F.array().cast("array<string>"))
    return _parts(spark, d).select("p_partkey", F.array_join(R.valid_chain(chain, [*brands, "ECONOMY", "PROMO", "MEDIUM", "LARGE", "STANDARD", "SMALL"]), ">").alias("chain"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) ELSE 1000000 * (event_id + 1) END AS at, CASE event_id % 3 WHEN 0 THEN 1705312800 - 43200 WHEN 1 THEN 1705312800 - 259200 ELSE 1705276800 END AS since FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)")
def entry_times(spark, d):
    """First sighting, else the earliest stamp; and relative times as instants."""
    now = datetime(2024, 1, 15, 10, 0, tzinfo=timezone.utc)
    since = [F.lit(int(R.since(x, now).timestamp())) for x in ("12h", "3d", "today")]
    e = read(spark, d, "events")
    own = F.when(F.col("event_type") != "error", F.date_trunc("second", "ts").cast("string"))
    a, b = (F.timestamp_seconds(F.col("event_id") + k).cast("string") for k in (5, 1))
    return e.select("event_id", F.unix_micros(R.entry_time(own, a, b, no_text())).alias("at"), _turn(F.col("event_id"), *since).cast("long").alias("since"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'block:companion' WHEN 2 THEN 'block:no_overlap,advisory:title_mismatch' ELSE '' END AS reasons FROM part")
def resolution_checks(spark, d):
    """A companion or a title without overlap blocks a main work only."""
    found = _turn(p_key(), p_name(), _s(p_name(), " Study Guide"), F.lit("Botany"), F.lit("Botany"))
    return _parts(spark, d).select("p_partkey", F.array_join(U.resolution_check(F.when(p_key() % 4 == 3, "solution").otherwise("main"), p_name(), found), ",").alias("reasons"))


@query("SELECT p_size AS field_id, count(DISTINCT p_brand) AS subjects, count(*) AS books, min(p_partkey) AS first FROM part GROUP BY 1")
def nested_catalogue(spark, d):
    """field, then subjects, then books, each in order."""
    w = _parts(spark, d).select(p_size().alias("field_id"), p_brand().alias("subject"), p_key().alias("rank"), p_key().cast("string").alias("slug"), p_name().alias("title"), p_type().alias("state"))
    n = U.nested(w)
    return n.select("field_id", F.size("sublists").cast("long").alias("subjects"), F.aggregate("sublists", F.lit(0).cast("long"), lambda a, s: a + F.size(s["books"])).alias("books"), F.get(F.get("sublists", F.lit(0))["books"], F.lit(0))["rank"].alias("first"))


@query("""
    SELECT 'all' AS list, CAST(k AS VARCHAR) AS key FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'known', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'failed', CAST(k AS VARCHAR) FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'in flight', CAST(k AS VARCHAR) FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
    UNION ALL SELECT 'job ' || CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'part' END, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'wanted', coalesce(c_name, '-') FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'proposed', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 = 0
""")
def listings_of_work(spark, d):
    """Every slug, known files, bad locators, work in flight, jobs of several kinds, rows by id, open proposals."""
    c, o = read(spark, d, "customer").withColumn("k", F.col("c_custkey")), read(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    ok = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    parts = {
        "all": L.every_key("k", c, o),
        "known": L.known(c, o, ["k"]),
        "failed": L.failed(o, ok, "k"),
        "in flight": L.in_flight(o, o.where("o_orderstatus = 'F'"), ["k"]),
        "wanted": L.by_id(c.select("k", "c_name"), o, "k").select(F.coalesce("c_name", F.lit("-")).alias("k")),
        "proposed": L.select_proposed(_proposals(spark, d), domain="math", type=None).select(F.col("id").alias("k")),
    }
    jobs = L.jobs("o_orderkey", open=o.where("o_orderstatus = 'O'"), part=o.where("o_orderstatus = 'P'"))
    out = jobs.select(_s("job ", F.col("kind")).alias("list"), F.col("o_orderkey").cast("string").alias("key"))
    for name, frame in parts.items():
        out = out.unionByName(frame.select(F.lit(name).alias("list"), F.col("k").cast("string").alias("key")))
    return out


@query("SELECT conv_id, turn, CAST(floor(turn / 2) AS BIGINT) AS batch, length(text) AS n FROM conversations WHERE role = 'user'")
def texts_of_batches(spark, d):
    """The source text of each unit that a batch names."""
    c = read(spark, d, "conversations")
    named = c.where("role = 'user'").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("batch"))
    return L.english_by_key(c, named, ["conv_id", "turn"], "text").select("conv_id", "turn", "batch", F.length("text").cast("long").alias("n"))


@query("SELECT event_id, event_type IN ('click', 'error') AND event_id % 2 = 0 AS limited FROM events")
def provider_limits(spark, d):
    """Whether an answer says that its provider's quota is used up."""
    said = F.when(F.col("event_id") % 2 == 0, _s("429: Too Many Requests for ", F.col("user_id"))).otherwise("fine")
    return read(spark, d, "events").select("event_id", L.hit_limit(said, {"click": "(?i)too many requests", "error": "429|quota", "view": "never"}, F.col("event_type")).alias("limited"))


@query("SELECT p_partkey AS slug, 1 AS num, fault FROM part, (VALUES (0, 'start after stop'), (1, 'stop outside'), (2, 'problems outside'), (3, 'start outside'), (3, 'start after stop')) v(turn, fault) WHERE p_partkey % 5 = turn")
def rule_ranges(spark, d):
    """Chapter ranges against the blocks of their book."""
    p = _parts(spark, d)
    start, stop, problems = _turn(p_key(), F.lit(5), F.lit(1), F.lit(1), F.lit(60), F.lit(1)), _turn(p_key(), F.lit(5), F.lit(99), F.lit(9), F.lit(50), F.lit(9)), F.when(p_key() % 5 == 2, 12)
    return V.range_faults(p.select(p_key().alias("slug"), F.lit(1).alias("num"), start.alias("start"), problems.alias("problems"), stop.alias("stop")), p.select(p_key().alias("slug"), F.lit(50).alias("n_blocks")))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 12, month(o_orderdate), o_orderdate, o_orderkey) AS place FROM orders")
def annotations_in_order(spark, d):
    """Notes of each reader by chapter and section number, so 2.10 stands after 2.9, then by date."""
    key = F.concat_ws(".", (F.col("o_orderkey") % 12).cast("string"), F.month("o_orderdate").cast("string"))
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", key.alias("key"), F.struct("o_orderdate", "o_orderkey").alias("created"))
    return L.annotations(o, "o_custkey", "key", "created").select("o_custkey", "o_orderkey", "place")


@query("SELECT p_partkey AS slug, 1 AS num FROM part WHERE p_size % 3 = 0")
def rule_anchors(spark, d):
    """Chapters without a problems index that hold both an item and a problems heading."""
    p = _parts(spark, d)
    blocks = p.select(p_key().alias("slug"), F.posexplode(F.array(F.lit("x"), _s("1. ", p_name()), F.when(p_size() % 3 == 0, "Problems").otherwise(p_brand()), F.lit("y"))).alias("idx", "text")).withColumn("type", F.lit("text"))
    chapters = p.select(p_key().alias("slug"), F.lit(1).alias("num"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("problems"), F.lit(4).alias("stop"))
    return V.unanchored(chapters, blocks, r"^[0-9]+\. ", "^Problems$")


@query("""
    WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
    SELECT user_id, count(*) AS n, '["' || string_agg(event_type, '", "' ORDER BY event_id) || '"]' AS recent FROM r WHERE k <= 20 GROUP BY user_id
""")
def stream_recent(spark, d):
    """The bounded tail of each key, as a stream: what the last batch of a key leaves."""
    batch = read(spark, d, "events")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    stream = raw.select(*[F.col(c).cast(t).alias(c) for c, t in batch.dtypes]).select("user_id", "event_id", "event_type")
    kept = changes.recent(stream, "user_id", "event_id", "event_type", 20)
    return changes.drain(kept, f"r{uuid.uuid4().hex}", "update", _folder(spark, "stream")).groupBy("user_id").agg(F.max_by("n", "upto").cast("long").alias("n"), F.max_by("recent", "upto").alias("recent"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Counts per day and type, as a stream with a watermark."""
    batch = read(spark, d, "events")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    counted = changes.windowed(raw.select(*[F.col(c).cast(t).alias(c) for c, t in batch.dtypes]), "ts", "1 day", "400 days", "event_type")
    return changes.drain(counted, f"w{uuid.uuid4().hex}", "complete", _folder(spark, "stream")).select("event_type", F.unix_micros("start").alias("day_us"), "n")
