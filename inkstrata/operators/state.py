"""Pipeline observability: stages, gates, funnels, timelines, sessions, leases, proposals, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.operators.ranks import global_rank


def stage(has_unified: Column, has_parsed: Column, pending: Column, raw: Column, has_rules: Column, blocked: Column, problems: Column, solved: Column, translated: Column) -> Column:
    """Where a book stands, derived from what exists; earlier steps win."""
    done = F.concat(F.when((problems > 0) & (solved > 0), "4 merged").otherwise("3 parsed"), F.when(translated, " +zh").otherwise(""))
    return (
        F.when(~has_unified & ~has_parsed, F.when(pending, "0.5 ocr").when(raw, "0 ingest").otherwise("X missing"))
        .when(~has_rules, F.when(blocked, "R audit-blocked").otherwise("1 audit"))
        .when(~has_parsed, "2 parse")
        .otherwise(done)
    )


def todo(stage_: Column, critical: Column, optional: Column, sol_owned: Column, solved: Column, sol_settled: Column, sol_ready: Column, translated: Column) -> Column:
    """What is left to do, space-joined; (optional) parts do not hold a book back."""
    late = F.array_compact(
        F.array(
            F.when(critical > 0, F.concat(F.lit("catalog_audit("), critical.cast("string"), F.lit(")"), F.when(optional, "(optional)").otherwise(""))),
            F.when(sol_owned & (solved == 0) & ~sol_settled, F.when(sol_ready, "sol_extract").otherwise("sol_ingest")),
            F.when(~translated, "translate(optional)"),
        )
    )
    return (
        F.when(stage_.rlike("^(0|X)"), "ingest").when(stage_.startswith("1"), "audit").when(stage_.startswith("2"), "parse").when(stage_.startswith("R"), "-").otherwise(F.when(F.size(late) > 0, F.array_join(late, " ")).otherwise("-"))
    )


DEPTHS = ["triage", "qc", "ingest", "ocr", "audit", "parse", "catalog", "deploy", "live", "stuck"]


def depth(stage_: Column, todo_: Column, deployed: Column) -> Column:
    """Bucket of the pipeline a stage lies in."""
    p = F.element_at(F.split(F.coalesce(stage_, F.lit("")), " "), 1)
    return (
        F.when(stage_.startswith("R") | (p == "X"), "stuck")
        .when(p == "0.1", "triage")
        .when(p == "0.2", "qc")
        .when(p.isin("0", "0.3"), "ingest")
        .when(p == "0.5", "ocr")
        .when(p == "1", "audit")
        .when(p == "2", "parse")
        .when(p.isin("3", "4"), F.when(deployed, "live").when(todo_.contains("catalog_audit"), "catalog").otherwise("deploy"))
        .otherwise("stuck")
    )


def histogram(rows: DataFrame, bucket: str, order: list[str], held: Column) -> DataFrame:
    """Rows and held rows of every bucket in order, zero where there is none."""
    dim = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(b) for b in order])).alias("ord", bucket))
    n = rows.withColumn("_h", held).groupBy(bucket).agg(F.count(F.lit(1)).alias("total"), F.count_if("_h").alias("held"))
    return dim.join(n, bucket, "left").na.fill(0, ["total", "held"])


def gates(rows: DataFrame, rules: DataFrame, slug: str, stage_: str, default: str = "hold") -> DataFrame:
    """allowed: the action of the first matching rule (slug or *, stage or *); null slugs match * only; any invalid rule holds all.

    Each row meets at most one rule of each of the four patterns, by equality,
    so rules of any number are joined and every row stays, equal ones too.
    """
    ok = rules.agg(F.coalesce(F.bool_and(F.coalesce(F.col("slug").isNotNull() & F.col("stage").isNotNull() & F.col("action").isin("allow", "hold"), F.lit(False))), F.lit(True)).alias("_valid"), F.min(F.when((F.col("slug") == "*") & (F.col("stage") == "*"), F.struct("rule_idx", "action"))).alias("_all"))
    first = rules.groupBy(F.col("slug").alias("_s"), F.col("stage").alias("_g")).agg(F.min(F.struct("rule_idx", "action")).alias("_r"))
    out = rows.withColumn("_s", F.coalesce(slug, F.lit("*"))).withColumn("_g", F.col(stage_))
    out = out.join(first.withColumnRenamed("_r", "_both"), ["_s", "_g"], "left")
    out = out.join(first.where("_g = '*'").select("_s", F.col("_r").alias("_slug")), "_s", "left")
    out = out.join(first.where("_s = '*'").select("_g", F.col("_r").alias("_stage")), "_g", "left")
    hit = F.least("_both", "_slug", "_stage", "_all")
    return out.crossJoin(F.broadcast(ok)).withColumn("allowed", F.col("_valid") & (F.coalesce(hit["action"], F.lit(default)) == "allow")).select(*rows.columns, "allowed")


def next_actionable(rows: DataFrame, order: list[str] = ("0.2", "0.3", "0.5", "1", "2", "3", "4")) -> DataFrame:
    """The row furthest upstream that has work to do."""
    p = F.element_at(F.split("stage", " "), 1)
    rank = F.coalesce(*[F.when(p == s, F.lit(k)) for k, s in enumerate(order)], F.lit(len(order)))
    return rows.where(~F.col("todo").isin("-", "") & ~F.col("stage").startswith("R")).withColumn("_r", rank).orderBy("_r", "slug").limit(1).drop("_r")


def stuck_reason(qc: Column, note: Column, book_qc: Column, blocked: Column, stage_: Column) -> Column:
    return F.when(qc == "reject", F.concat_ws(": ", F.lit("qc-reject"), F.left(note, F.lit(72)))).when(book_qc.isNotNull(), F.concat_ws(": ", F.lit("book_qc"), F.left(book_qc, F.lit(72)))).when(blocked.isNotNull(), F.concat_ws(": ", F.lit("audit-blocked"), F.left(blocked, F.lit(72)))).when(stage_.startswith("X"), stage_)


def funnel(rows: DataFrame, since: Column, entered: str, deployed_at: str, stuck: str) -> DataFrame:
    """bucket, n, reasons and mean lead seconds of the cohort: deployed, stuck or inflight, each row once."""
    c = rows.where(F.col(entered) >= since)
    bucket = F.when(F.col(deployed_at).isNotNull(), "deployed").when(F.col(stuck).isNotNull(), "stuck").otherwise("inflight")
    lead = F.when(F.col(deployed_at).isNotNull(), F.unix_timestamp(deployed_at) - F.unix_timestamp(entered))
    return c.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lead), 3).alias("lead_s"))


def first_seen(rows: DataFrame, keys: list[str], at: str, known: DataFrame | None = None) -> DataFrame:
    """Earliest evidence per key; a first sighting that is already known stays."""
    found = rows.groupBy(*keys).agg(F.min(at).alias("first_seen"))
    if known is None:
        return found
    return found.join(known.select(*keys, F.col("first_seen").alias("_k")), keys, "full").select(*keys, F.coalesce("_k", "first_seen").alias("first_seen"))


def timeline(rows: DataFrame, keys: list[str], at: str | list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*([at] if isinstance(at, str) else at))
    before = F.lag(value).over(w)
    return rows.withColumn("_b", before).where(F.col(value).isNotNull() & (F.col("_b").isNull() | (F.col("_b") != F.col(value)))).drop("_b")


def seeded(base: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Historical anchors for keys without any event."""
    return base.unionByName(anchors.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def session_index(events: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """Sessions by silence: a gap above gap_s starts a new one."""
    w = Window.partitionBy(key).orderBy(at)
    fresh = F.coalesce((F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w)) > gap_s).cast("int"), F.lit(1))
    marked = events.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events")).withColumn("duration_s", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def session_rebuild(index: DataFrame, log: DataFrame, now: Column, stale_s: int) -> DataFrame:
    """Rows for sessions with events but no index row whose last event is stale; their outcome is unknown."""
    agg = log.groupBy("session").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "tool").alias("total_calls"))
    lost = agg.join(index.select("session"), "session", "left_anti").where(F.unix_timestamp(now) - F.unix_timestamp("ended") > stale_s)
    return lost.withColumn("ok", F.lit(None).cast("boolean")).withColumn("duration_s", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def outcomes(sessions: DataFrame, key: str, ok: Column, seconds: Column) -> DataFrame:
    """Sessions, failures (denied only), unknown and seconds: null is neither success nor failure."""
    return sessions.withColumn("_o", ok).withColumn("_s", seconds).groupBy(key).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("_o").eqNullSafe(F.lit(False))).alias("failed"), F.count_if(F.col("_o").isNull()).alias("unknown"), F.sum(F.coalesce("_s", F.lit(0))).alias("seconds"))


def sessions_of(sessions: DataFrame, limit: int) -> DataFrame:
    """Newest sessions of each slug, by its own slug or by what it touched."""
    flat = sessions.withColumn("of", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("slug"), F.coalesce("touched", F.array().cast("array<string>")))))))
    w = Window.partitionBy("of").orderBy(F.desc("started"), "id")
    return flat.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def carried_time(lines: DataFrame, keys: list[str], pos: str, at: str) -> DataFrame:
    """The time of the line, else of the last line before that has one, else of the next."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return lines.withColumn("effective", F.coalesce(F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(at, True).over(Window.partitionBy(*keys).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1))))


def provider_health(workers: DataFrame, chain: list[str]) -> DataFrame:
    """Workers per provider of the chain: idle, ok, degraded (some failed) or fallback (a later one works while the first is idle)."""
    spark = workers.sparkSession
    dim = spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in chain])).alias("ord", "provider"))
    n = workers.groupBy("provider").agg(F.count(F.lit(1)).alias("workers"), F.count_if("failed").alias("failures"))
    j = dim.join(n, "provider", "left").na.fill(0, ["workers", "failures"])
    first = F.max(F.when(F.col("ord") == 0, F.col("workers"))).over(Window.partitionBy(F.lit(1)))
    return j.withColumn("status", F.when(F.col("workers") == 0, "idle").when(F.col("failures") * 2 > F.col("workers"), "degraded").when((F.col("ord") > 0) & (first == 0), "fallback").otherwise("ok"))


def quota_slots(accounts: DataFrame, picks: DataFrame, order: list[str], coarse: Column) -> DataFrame:
    """The first picks zipped with the free slots of the accounts, in order of account: both sides are ranked where they are, and meet by rank.

    coarse: a value that never falls along the order and has few distinct ones.
    """
    slots = accounts.where("remaining > 0").withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("remaining").cast("int"))))
    slots = global_rank(slots, [F.col("account")], [F.col("slot")], "_k")
    mine = global_rank(picks, [coarse], [F.col(c) for c in order], "_k")
    return mine.join(slots.select("_k", "account", "slot"), "_k").drop("_k")


def usage(starts: DataFrame) -> DataFrame:
    """Pages per day and account; a slug counts once a day."""
    return starts.dropDuplicates(["day", "account", "slug"]).groupBy("day", "account").agg(F.sum("pages").alias("pages"))


def frontier(proposals: DataFrame) -> DataFrame:
    """Life-cycle buckets per domain and in total: each proposal lies in one of them."""
    b = F.when(F.col("status") == "proposed", "actionable").when(F.col("status") == "parked", "parked").otherwise("terminal")
    rows = proposals.withColumn("bucket", b).withColumn("domain", F.coalesce("domain", F.lit("?")))
    return rows.rollup("domain").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == x).alias(x) for x in ("actionable", "parked", "terminal")], (F.grouping("domain") == 1).alias("is_total"))


def stale(proposals: DataFrame, commits: DataFrame) -> DataFrame:
    """Open proposals whose files changed since they were verified, and how often.

    Commits are counted once per domain and instant; later days and later
    instants of the same day are summed apart, so no pairs are made and no
    window holds more than the days of a domain or the instants of one day.
    """
    open_ = proposals.where(F.col("status").isin("proposed", "parked")).select("id", "domain", F.col("verified_at").alias("at"))
    marks = open_.select("domain", "at", F.lit(0).alias("n")).unionByName(commits.select("domain", F.col("committed_at").alias("at"), F.lit(1).alias("n")))
    marks = marks.where("domain IS NOT NULL AND at IS NOT NULL").groupBy("domain", "at").agg(F.sum("n").alias("n")).withColumn("day", F.to_date("at"))

    def later(*keys: str, order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    days = marks.groupBy("domain", "day").agg(F.sum("n").alias("n")).select("domain", "day", later("domain", order="day").alias("_days"))
    after = marks.withColumn("_own", later("domain", "day", order="at")).join(days, ["domain", "day"]).select("domain", "at", (F.col("_own") + F.col("_days")).alias("commits")).where("commits > 0")
    return open_.join(after, ["domain", "at"]).groupBy("id").agg(F.sum("commits").alias("commits"))


def change_status(proposals: DataFrame, wanted: DataFrame, new: str, allowed: list[str]) -> DataFrame:
    """All or nothing: the job fails if any wanted id is missing or may not change."""
    j = wanted.select("id").join(proposals.select("id", "status"), "id", "left")
    bad = j.agg(F.count_if(F.col("status").isNull() | ~F.col("status").isin(*allowed)).alias("bad"))
    guard = bad.select(F.when(F.col("bad") > 0, F.raise_error(F.lit("some proposals cannot change"))).otherwise(F.lit(True)).alias("_ok"))
    out = proposals.join(wanted.select("id", F.lit(True).alias("_w")).distinct(), "id", "left").crossJoin(F.broadcast(guard))
    return out.where("_ok").withColumn("status", F.when(F.col("_w"), F.lit(new)).otherwise(F.col("status"))).drop("_w", "_ok")


def lease_verdict(alive: Column, same_process: Column, age_s: Column, ttl_s: Column, grace_s: Column, terminated: Column) -> Column:
    """drop dead or reused processes; past the ttl terminate, past the grace after that kill."""
    return F.when(~alive | ~same_process, "drop").when(age_s <= ttl_s, "keep").when(~terminated, "terminate").when(age_s > ttl_s + grace_s, "kill").otherwise("wait")


def staleness(status_age: Column, worker_age: Column, limit_s: int) -> Column:
    return F.when(status_age <= limit_s, F.lit(None)).when(worker_age.isNotNull() & (worker_age <= limit_s), "lagging").otherwise("stopped")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed or modified paths between two snapshots (path, sha)."""
    j = before.select("path", F.col("sha").alias("b")).join(after.select("path", F.col("sha").alias("a")), "path", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified").alias("change"))


def collectable(books: DataFrame, in_flight: DataFrame, now: Column, days: int) -> DataFrame:
    """Deployed books that neither they nor their solution have in flight, old enough."""
    busy = in_flight.select(F.regexp_replace("slug", "_sol$", "").alias("slug")).distinct()
    return books.where(F.col("deployed")).join(busy, "slug", "left_anti").where(F.col("deployed_at") <= now - F.make_interval(days=F.lit(days)))


def capacity(manifest: DataFrame, now: Column, stale_s: int) -> DataFrame:
    """harvestable (not uploading) and occupied (ready, or uploading and fresh) uploads; no timestamp counts as old."""
    age = F.unix_micros(now) - F.unix_micros("submitted_at")
    fresh = ~F.col("uploading") | F.coalesce(age < stale_s * 1_000_000, F.lit(False))
    return manifest.agg(F.count(F.lit(1)).alias("in_flight"), F.count_if(~F.col("uploading")).alias("harvestable"), F.count_if(fresh).alias("occupied"))


def reading_stats(items: DataFrame, key: str, ratio: str, at: str, started: float = 0.02, read: float = 0.9) -> DataFrame:
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("touched"), F.count_if(F.col(ratio) >= started).alias("started"), F.count_if(F.col(ratio) >= read).alias("read"), F.max(at).alias("last_at"))


def recent(items: DataFrame, key: str, item: str, ratio: str, at: str, limit: int = 4, started: float = 0.02) -> DataFrame:
    """The latest started item of each key, newest keys first."""
    return items.where(F.col(ratio) >= started).groupBy(key).agg(F.max_by(item, F.struct(F.col(at), F.col(item))).alias(item), F.max(at).alias("last_at")).orderBy(F.desc("last_at"), key).limit(limit)


def resolved_config(*layers: Column) -> Column:
    """The most specific layer that is set."""
    return F.coalesce(*layers)
