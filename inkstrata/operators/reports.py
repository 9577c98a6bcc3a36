"""Compositions for dashboards and proposals: health, feeds, lint, verification, scorecards, relative times."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.operators.ranks import global_rank


def since(expr: str, now: datetime) -> datetime:
    """12h, 3d, 90m, today or an ISO time as an instant; the caller gives the present."""
    s = expr.strip().lower()
    if s == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*(min|m|h|d)", s):
        return now - timedelta(minutes=float(m[1]) * {"min": 1, "m": 1, "h": 60, "d": 1440}[m[2]])
    d = datetime.fromisoformat(s)
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


def entry_time(seen: Column, *others: Column) -> Column:
    """First sighting, else the earliest stamp that can be read; stamps without zone are UTC."""

    def t(c: Column) -> Column:
        return F.try_to_timestamp(c)

    rest = F.array_min(F.array_compact(F.array(*[t(c) for c in others]))) if others else F.lit(None).cast("timestamp")
    return F.coalesce(t(seen), rest)


def crawl_state(ready: Column, quota: Column, room: Column, downloading: Column) -> Column:
    return F.when(downloading, "downloading").when(ready == 0, "idle").when(quota == 0, "quota_empty").when(room <= 0, "holding").otherwise("draining")


def daemon_health(lines: DataFrame, interval_s: int, now: Column) -> DataFrame:
    """Last start and end marks of a log, duration, whether it runs, seconds to the next run."""
    a = F.max(F.when(F.col("line").rlike("(tick|loop) start"), F.col("at")))
    b = F.max(F.when(F.col("line").rlike("(tick|loop) end"), F.col("at")))
    one = lines.agg(a.alias("last_start"), b.alias("last_end"))
    running = F.coalesce(F.col("last_start") > F.col("last_end"), F.col("last_start").isNotNull())
    span = F.unix_timestamp("last_end") - F.unix_timestamp("last_start")
    eta = F.greatest(F.lit(0), F.unix_timestamp("last_end") + interval_s - F.unix_timestamp(now))
    return one.select("last_start", "last_end", running.alias("running"), F.when(span >= 0, span).alias("duration_s"), F.when(~running, eta).alias("next_in_s"))


def proposals_feed(rows: DataFrame, resolved_limit: int) -> DataFrame:
    """All open proposals, newest first, then the latest resolved ones; pos orders them."""
    open_ = F.col("status").isin("proposed", "parked")
    a = global_rank(rows.where(open_), [-F.datediff("created", F.lit("1970-01-01"))], [F.desc("created"), F.col("id")], "pos")
    b = rows.where(~open_).orderBy(F.desc("updated"), "id").limit(resolved_limit).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("updated"), "id")) + (1 << 30))
    return a.unionByName(b)


def lint(rows: DataFrame, domains: dict[str, list[str]], unblock_kinds: list[str], reject_codes: list[str]) -> DataFrame:
    """id and fault: id shape, repeats, domain, type, status, resolution, codes and unblock."""
    known = F.create_map(*[F.lit(x) for d, t in domains.items() for x in (d, ",".join(t))])
    kinds = F.split(F.element_at(known, F.coalesce("domain", F.lit(""))), ",")
    res = F.trim(F.coalesce("resolution", F.lit("")))
    codes = F.filter(F.split(res, "[ ,+]+"), lambda c: c != "")
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("id").rlike(r"^P-\d{4}-\d{2}-\d{2}-[a-z0-9-]+$"), F.lit(False)), "id"),
            F.when(n > 1, "repeated id"),
            F.when(kinds.isNull(), "domain").when(~F.array_contains(kinds, F.coalesce("type", F.lit(""))), "type"),
            F.when(~F.coalesce(F.col("status").isin("proposed", "parked", "accepted", "rejected", "superseded"), F.lit(False)), "status"),
            F.when(F.col("status").isin("accepted", "rejected", "superseded") & (res == ""), "no resolution"),
            F.when((F.col("status") == "rejected") & (F.size(F.array_except(codes, F.array(*[F.lit(c) for c in reject_codes]))) > 0), "reject code"),
            F.when((F.col("status") == "parked") & ~F.coalesce(F.col("unblock_kind").isin(*unblock_kinds), F.lit(False)), "unblock"),
        )
    )
    return rows.withColumn("faults", checks).select("id", F.explode("faults").alias("fault"))


def verify(proposals: DataFrame, live: DataFrame, critical: DataFrame) -> DataFrame:
    """id and verdict: formulas by live occurrences, catalogues by critical findings, others stay inconclusive."""
    j = proposals.join(live, "id", "left").join(critical, "slug", "left")
    math = F.when(F.coalesce("live_occ", F.lit(-1)) < 0, "inconclusive").when(F.col("live_occ") == 0, "resolved").otherwise("live")
    cat = F.when(F.col("critical").isNull(), "inconclusive").when(F.col("critical") == 0, "resolved").otherwise("live")
    return j.select("id", F.when(F.col("domain") == "math", math).when((F.col("domain") == "catalog") | F.coalesce(F.col("caption_gap"), F.lit(False)), cat).otherwise("inconclusive").alias("verdict"))


def caption_gap(title: Column, kind: Column) -> Column:
    return (kind == "tooling-gap") & F.lower(F.coalesce(title, F.lit(""))).rlike("caption|figure|table|catalog")


def superseded(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Proposals whose gap is gone become superseded."""
    j = proposals.join(verdicts.where("verdict = 'resolved'").select("id", F.lit(True).alias("_r")), "id", "left")
    return j.withColumn("status", F.when(F.coalesce("_r", F.lit(False)) & (F.col("status") == "proposed"), "superseded").otherwise(F.col("status"))).drop("_r")


def scorecard(chapters: DataFrame, entries: DataFrame, residual: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per book: chapters, blocks, items, catalogue counts, residual (null: unverified), flags."""
    base = chapters.groupBy("slug").agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.coalesce("body_count", F.lit(0))).alias("blocks"), F.sum(F.coalesce("problem_count", F.lit(0))).alias("problems"))
    cat = entries.groupBy("slug").agg(F.count(F.lit(1)).alias("entries"))
    return base.join(cat, "slug", "left").na.fill(0, ["entries"]).join(residual, "slug", "left").join(flags, "slug", "left")


def anchor_verdict(anchors: Column, texts: Column, chapters: Column) -> Column:
    """Whether a solutions book can be cut by chapter anchors."""
    few = chapters.isNotNull() & (chapters >= 3) & (anchors < F.greatest(F.lit(2), F.floor(chapters / 2)))
    return F.when((anchors == 0) & (texts > 0), "unnumbered").when(anchors == 0, "no_anchor").when(few, "partial").otherwise("feasible")


def progress_line(done: DataFrame, total: int, at: str) -> DataFrame:
    """done, rate per minute and seconds left of a batch."""
    span = (F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))) / 60
    one = done.agg(F.count(F.lit(1)).alias("done"), span.alias("minutes"))
    rate = F.when(F.col("minutes") > 0, F.col("done") / F.col("minutes"))
    return one.select("done", F.round(rate, 3).alias("per_min"), F.round((total - F.col("done")) / rate * 60, 0).alias("eta_s"))


def kept_newest(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def known_gaps(targets: DataFrame, seen: DataFrame) -> DataFrame:
    """Discovered works that are not known yet, with the derived row of a solution book; they come after all listed ones."""
    fresh = targets.join(seen.select("slug").distinct(), "slug", "left_anti")
    return global_rank(fresh, [F.col("field_id")], [F.col("slug")], "order").withColumn("order", F.col("order") + 10_000)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_upsert(base: DataFrame, fresh: DataFrame, keys: list[str], fields: list[str], only_missing: bool = False) -> DataFrame:
    """Field by field: the new value where there is one (or, with only_missing, only where the old one is null)."""
    j = base.join(fresh.select(*keys, *[F.col(f).alias(f"_n_{f}") for f in fields]), keys, "full")
    pick = [(F.coalesce(f, f"_n_{f}") if only_missing else F.coalesce(f"_n_{f}", f)).alias(f) for f in fields]
    return j.select(*keys, *[c for c in base.columns if c not in keys and c not in fields], *pick)


def unregistered(files: DataFrame, targets: DataFrame, ingested: DataFrame) -> DataFrame:
    """What to do with files that no registry names: register, skip or unresolved."""
    j = files.join(targets.select("slug", F.lit(True).alias("_t")).distinct(), "slug", "left").join(ingested.select("slug", F.lit(True).alias("_i")).distinct(), "slug", "left")
    return j.withColumn("action", F.when(F.col("_i"), "skip").when(F.col("_t"), "register").otherwise("unresolved")).drop("_t", "_i")


def valid_chain(chain: Column, providers: list[str]) -> Column:
    """The provider order, or null if any is unknown or none is given."""
    return F.when((F.size(chain) > 0) & F.forall(chain, lambda p: p.isin(*providers)), chain)


def valid_commit(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """Link commits with their outcome: conflict where another work has the same id, kept where it is linked already."""
    other = links.select("link_id", F.col("slug").alias("_o")).distinct()
    j = wanted.join(other, "link_id", "left").groupBy(*wanted.columns).agg(F.bool_or(F.col("_o") != F.col("slug")).alias("_x"), F.bool_or(F.col("_o") == F.col("slug")).alias("_s"))
    return j.select(*wanted.columns, F.when(F.coalesce("_x", F.lit(False)), "conflict").when(F.coalesce("_s", F.lit(False)), "kept").otherwise("added").alias("outcome"))
