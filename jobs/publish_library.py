"""Publish a text table as a library: a reader's page per document, by book, and an audited catalogue of books.

    python jobs/publish_library.py --config jobs/publish_library.json --documents PATH --library PATH

A book is a source in one language, a document one of its chapters.  Pages
carry what a reader lists and checks before it fetches a text: preview, content
anchor, number of search terms, faulty math delimiters, and the chapter that
a copy repeats.  The catalogue counts them by book and says which books are
ready, need a review or are blocked.  Pages go to one partition per language and
book, the catalogue to one per language; a rerun replaces the pages of the books
it sees and leaves the others, so it gives the same library again.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import mathx, text
from inkstrata.operators import overlay
from inkstrata.sources import publish

log = logging.getLogger("jobs.publish_library")
DEFAULTS = {"preview": 200, "least_chapters": 2, "most_copies": 0.5, "most_faults": 0.2}
BOOK = ["lang", "source"]
PAGES = "doc_id long, anchor string, preview string, n_chars long, n_terms long, fault string, copy_of long, lang string, source string"
BOOKS = "source string, chapters long, empty long, copies long, faults long, n_chars long, first_chapter long, status string, lang string"


def named() -> list[Column]:
    """Language and source as they name folders."""
    return [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none")).alias(c) for c in BOOK]


def pages(docs: DataFrame, preview: int) -> DataFrame:
    """One row per document; a null text is an empty page, a null language or source is written as `none`.

    copy_of is the smallest id among the chapters of the same book and text, null
    for that one itself and for empty pages.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named(), body.alias("text"))
    rows = rows.select(
        "doc_id",
        *BOOK,
        F.sha1("text").alias("_same"),
        overlay.anchor(md=F.col("text")).alias("anchor"),
        text.preview(F.col("text"), preview).alias("preview"),
        F.length("text").cast("long").alias("n_chars"),
        F.size(text.tokens(text.fold(F.col("text")))).cast("long").alias("n_terms"),
        mathx.delimiter_fault(F.col("text")).alias("fault"),
    )
    # a map-side minimum per text, joined back: a group of copies never meets in one window
    first = rows.where("n_chars > 0").groupBy(*BOOK, "_same").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copy = F.when(F.col("_first") != F.col("doc_id"), F.col("_first"))
    return rows.join(first, [*BOOK, "_same"], "left").withColumn("copy_of", copy).drop("_same", "_first")


def status(c: dict) -> Column:
    """blocked without enough chapters or any text, review where copies or faults are too many, else ready."""
    n = F.col("chapters")
    return F.when((n < c["least_chapters"]) | (F.col("empty") == n), "blocked").when((F.col("copies") > n * c["most_copies"]) | (F.col("faults") > n * c["most_faults"]), "review").otherwise("ready")


def catalogue(made: DataFrame, c: dict) -> DataFrame:
    sums = made.groupBy(*BOOK).agg(
        F.count(F.lit(1)).alias("chapters"),
        F.count_if(F.col("n_chars") == 0).alias("empty"),
        F.count("copy_of").alias("copies"),
        F.count("fault").alias("faults"),
        F.sum("n_chars").alias("n_chars"),
        F.min("doc_id").alias("first_chapter"),
    )
    return sums.withColumn("status", status(c))


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Publish the table at `documents` (doc_id, text, lang, source) to `library`; gives the rows read and written.

    The catalogue is made from the published pages of the languages at hand, not from the texts again.
    """
    c = DEFAULTS | config
    docs = spark.read.parquet(c["documents"]).select("doc_id", "text", *BOOK)
    publish(pages(docs, c["preview"]).hint("rebalance", *BOOK), f"{c['library']}/pages", *BOOK)
    here = docs.select(*named()).distinct()
    # whole languages: a partition of the catalogue also holds the books that this run does not see
    fresh = spark.read.schema(PAGES).parquet(f"{c['library']}/pages").join(here.select("lang").distinct(), "lang", "left_semi")
    publish(catalogue(fresh, c).hint("rebalance", "lang"), f"{c['library']}/books", "lang")
    books = spark.read.schema(BOOKS).parquet(f"{c['library']}/books").join(here, BOOK, "left_semi")
    wrote = books.agg(F.sum("chapters").alias("pages"), F.count(F.lit(1)).alias("books")).first()
    done = {"read": docs.count(), "pages": wrote["pages"] or 0, "books": wrote["books"]}
    log.info("read %s: %d rows; wrote %s: %d pages, %d books", c["documents"], done["read"], c["library"], done["pages"], done["books"])
    return done


def read(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(pages, books) as they stand."""
    return spark.read.schema(PAGES).parquet(f"{config['library']}/pages"), spark.read.schema(BOOKS).parquet(f"{config['library']}/books")


def main(argv: list[str]) -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    for name in ("documents", "library"):
        args.add_argument(f"--{name}")
    given = vars(args.parse_args(argv))
    config = json.loads(Path(given.pop("config")).read_text()) | {k: v for k, v in given.items() if v}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from inkstrata.session import session

    spark = session()
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
