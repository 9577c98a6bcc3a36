"""Inverted index with stop-token pruning, ranked candidates, exact verification, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T

COMMON_RATIO = 0.6
#: Chunk ids of one posting list span so many numbers at most.
SPAN = 1 << 16


def postings(chunks: DataFrame, key: list[str], text: str = "text", prefixes: list[str] | None = None) -> DataFrame:
    """(key..., token) once per chunk and token; with prefixes only the tokens that begin with one of them."""
    folded = chunks.select(*key, T.fold(F.col(text)).alias("_folded"))
    found = T.tokens(F.col("_folded"))
    if prefixes is not None:
        found = F.filter(found, lambda t: _any([t.startswith(p) for p in prefixes]))
    return folded.select(*key, F.explode(found).alias("token"))


def cutoff(n: Column, ratio: float = COMMON_RATIO) -> Column:
    """Document frequency from which a token prunes nothing; above n for small books."""
    return F.when(n > 5, F.greatest(F.lit(3), F.floor(n * ratio))).otherwise(n + 1)


def segments(found: DataFrame, book: str, chunk: str) -> DataFrame:
    """Postings (book, chunk, token) as bounded lists: book, token, segment, offsets.

    Chunk ids are whole numbers; a segment holds those of one range of `SPAN`,
    ascending, as offsets from the start of the range.
    """
    segment = F.floor(F.col(chunk) / SPAN).cast("long")
    offset = (F.col(chunk) - segment * SPAN).cast("int")
    one = found.select(book, "token", segment.alias("segment"), offset.alias("offset")).groupBy(book, "token", "segment")
    return one.agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def index(chunks: DataFrame, book: str, chunk: str, text: str = "text") -> DataFrame:
    """book, token, df, common, segment, offsets; a common token has one row, without a segment.

    The texts are cut into tokens once: the document frequency is the sum over
    a token's segments.
    """
    sizes = chunks.groupBy(book).agg(F.countDistinct(chunk).alias("n"))
    token = Window.partitionBy(book, "token")
    lists = segments(postings(chunks, [book, chunk], text), book, chunk)
    counted = lists.withColumn("df", F.sum(F.size("offsets")).over(token)).withColumn("_first", F.min("segment").over(token)).join(sizes, book)
    rows = counted.withColumn("common", F.col("df") >= cutoff(F.col("n"))).where(~F.col("common") | (F.col("segment") == F.col("_first")))
    return rows.select(book, "token", "df", "common", F.when(~F.col("common"), F.col("segment")).alias("segment"), F.when(~F.col("common"), F.col("offsets")).alias("offsets"))


def document_frequency(chunks: DataFrame, book: str, text: str = "text") -> DataFrame:
    """book, token, df, common without the lists, for chunks whose rows are the documents."""
    sizes = chunks.groupBy(book).agg(F.count(F.lit(1)).alias("n"))
    df = postings(chunks, [book], text).groupBy(book, "token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(sizes, book).select(book, "token", "df", (F.col("df") >= cutoff(F.col("n"))).alias("common"))


def candidates(chunks: DataFrame, book: str, chunk: str, terms: list[str], text: str = "text") -> DataFrame:
    """book, chunk, score: how many terms a chunk answers, for books that know every term.

    A term is looked up exactly, else as a common token (all chunks), else by
    prefix among the rare tokens, else by prefix among the common ones (all).
    Only tokens that begin with a term leave the scan, so the lists stay short.
    """
    return scored(postings(chunks, [book, chunk], text, terms), chunks.select(book, chunk).distinct(), book, chunk, terms)


def scored(parts: DataFrame, base: DataFrame, book: str, chunk: str, terms: list[str]) -> DataFrame:
    """The same from postings (book, chunk, token) of tokens that begin with a term and the list of chunks (book, chunk)."""
    n = len(terms)
    sizes = base.groupBy(book).agg(F.count(F.lit(1)).alias("n"))
    df = parts.groupBy(book, "token").agg(F.count(F.lit(1)).alias("df")).join(sizes, book).select(book, "token", (F.col("df") >= cutoff(F.col("n"))).alias("common"))
    term = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("term")) for k, t in enumerate(terms)]))
    asked = df.withColumn("q", term).where(F.col("token").startswith(F.col("q.term"))).select(book, "token", "common", "q.k", (F.col("token") == F.col("q.term")).alias("exact"))
    known = asked.groupBy(book, "k").agg(
        F.max(F.col("exact") & ~F.col("common")).alias("exact_rare"), F.max(F.col("exact") & F.col("common")).alias("exact_common"), F.max(~F.col("common")).alias("rare"), F.max("common").alias("any_common")
    )
    mode = F.when(F.col("exact_rare"), "exact").when(F.col("exact_common"), "all").when(F.col("rare"), "prefix").otherwise("all")
    known = known.select(book, "k", mode.alias("mode"))
    full = known.groupBy(book).agg(F.count(F.lit(1)).alias("terms"), F.sum((F.col("mode") == "all").cast("int")).alias("everywhere")).where(F.col("terms") == n)
    used = asked.join(known, [book, "k"]).where((F.col("mode") == "exact") & F.col("exact") | (F.col("mode") == "prefix") & ~F.col("common")).select(book, "k", "token")
    hits = parts.join(used, [book, "token"]).groupBy(book, chunk).agg(F.countDistinct("k").alias("own"))
    found = base.join(full, book).join(hits, [book, chunk], "left")
    return found.select(book, chunk, (F.coalesce("own", F.lit(0)) + F.col("everywhere")).cast("long").alias("score")).where("score > 0")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def ranked(found: DataFrame, book: str, chunk: str, most: int) -> DataFrame:
    """The first `most` candidates of each book: higher score first, then lower chunk."""
    order = Window.partitionBy(book).orderBy(F.desc("score"), chunk)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def verified(chunks: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Chunks whose folded text holds every term as a substring."""
    return chunks.where(T.matches_all(T.fold(F.col(text)), terms))


def block_hits(blocks: DataFrame, terms: list[str], keys: list[str], order: str) -> DataFrame:
    """Matching blocks with the anchor of the section they are in: blocks hold t, id, title, text."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("t").isin("section", "subsection")
    counter = F.sum(head.cast("int")).over(run)
    ident = F.trim(F.coalesce("id", F.lit("")))
    anchor = F.last(F.when(head, F.when(ident != "", F.concat(F.lit("sec-"), ident)).otherwise(F.concat(F.lit("sec--"), counter.cast("string")))), True).over(run)
    where = F.last(F.when(head, F.trim(F.concat_ws(" ", F.when(ident != "", ident), F.col("title")))), True).over(run)
    marked = blocks.withColumn("counter", counter).withColumn("anchor", anchor).withColumn("where", where)
    return marked.where((F.coalesce("text", F.lit("")) != "") & T.matches_all(T.fold(F.col("text")), terms)).drop("counter")


def facet_filter(items: DataFrame, query: str, haystack: list[str], **equal: str) -> DataFrame:
    """Conjunction of facet values and a case-folded substring over joined columns."""
    out = items
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out.where(F.lower(F.concat_ws(" ", *haystack)).contains(query.lower())) if query else out


def counts_by(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def tree_counts(items: DataFrame, *levels: str) -> DataFrame:
    """Counts at every level of a hierarchy; level tells how many keys a row has."""
    out = items.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in levels])
    return out.withColumn("level", sum((1 - F.col(f"_g_{c}") for c in levels), F.lit(0)).cast("long")).drop(*[f"_g_{c}" for c in levels])


def page(items: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A visible range of an ordered list."""
    return items.orderBy(*order).offset(offset).limit(limit)


def hydrate(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Dictionary-encoded rows (book_idx, chapter, nums) to one row per problem; a leading * marks a solution."""
    flat = rows.select("book_idx", "chapter", F.explode("nums").alias("raw"))
    return flat.join(books, "book_idx").withColumn("has_solution", F.col("raw").startswith("*")).withColumn("num", F.regexp_replace("raw", r"^\*", "")).drop("raw", "book_idx")


def late(keys: DataFrame, wide: DataFrame, on: list[str]) -> DataFrame:
    """Wide columns only for the rows already chosen."""
    return wide.join(keys, on, "left_semi")


def bake(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Plain text of each chunk: its non-empty block texts joined by blank lines, in order."""
    one = F.when(F.coalesce("text", F.lit("")) != "", F.struct(order, "text"))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["text"]), "\n\n").alias("text"))
