"""Listings of what is known, pending or wanted, as set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import numbers as N


def every_key(key: str, *frames: DataFrame) -> DataFrame:
    """The distinct non-null keys of all frames."""
    return reduce(DataFrame.union, [f.select(key) for f in frames]).where(F.col(key).isNotNull()).distinct()


def known(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key (a content hash, a slug) is listed already; each once, however often it is listed."""
    return rows.join(seen.select(*on), on, "left_semi")


def failed(report: DataFrame, ok: Column, locator: str) -> DataFrame:
    """Distinct locators of a report's rows that are not ok; an unknown outcome is no failure."""
    return report.where(ok.eqNullSafe(F.lit(False))).select(locator).distinct()


def in_flight(started: DataFrame, ended: DataFrame, on: list[str]) -> DataFrame:
    """Keys that were started and not ended."""
    return started.select(*on).distinct().join(ended.select(*on), on, "left_anti")


def jobs(key: str, **kinds: DataFrame) -> DataFrame:
    """One list of several kinds of work: key and kind."""
    return reduce(DataFrame.unionByName, [f.select(key, F.lit(kind).alias("kind")) for kind, f in kinds.items()])


def by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The row of each wanted id; an id without one has nulls."""
    return ids.select(key).distinct().join(rows, key, "left")


def english_by_key(units: DataFrame, batches: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The source text of every unit named in a batch."""
    return batches.select(*keys, "batch").join(units.select(*keys, text), keys)


def hit_limit(said: Column, words: dict[str, str], provider: Column) -> Column:
    """Whether an answer says that its provider's quota is used up; words: a pattern per provider."""
    return F.coalesce(*[F.when(provider == p, said.rlike(w)) for p, w in words.items()], F.lit(False))


def select_proposed(proposals: DataFrame, **equal: str | None) -> DataFrame:
    """Open proposals, narrowed by the given fields."""
    out = proposals.where("status = 'proposed'")
    for c, v in equal.items():
        out = out.where(F.col(c) == v) if v is not None else out
    return out


def annotations(rows: DataFrame, slug: str, key: str, created: str) -> DataFrame:
    """Notes of each book in reading order: by the numbers in their keys, piece by piece, then by time; place counts from 1."""
    order = Window.partitionBy(slug).orderBy(N.number_tuple(F.col(key)), created, key)
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
