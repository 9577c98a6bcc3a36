"""Streaming twins, drained over the events table; they must equal their batch forms."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from inkstrata.plans.registry import ORACLE_SQL, query
from inkstrata.plans import state  # noqa: F401  registers the batch twins
from inkstrata.sources import read, shared_dir
from inkstrata.streaming import changes, leases


def _events(spark, d):
    batch = read(spark, d, "events")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in batch.dtypes])


def _checkpoint(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(ORACLE_SQL["stage_timeline"])
def stream_stage_changes(spark, d):
    changed = changes.stage_changes(_events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    return changes.drain(changed, f"s{uuid.uuid4().hex}", "append", _checkpoint(spark)).select("event_id", "user_id", "event_type")


@query(ORACLE_SQL["first_seen"])
def stream_first_seen(spark, d):
    seen = changes.first_seen(_events(spark, d), "user_id", "ts")
    return changes.drain(seen, f"s{uuid.uuid4().hex}", "complete", _checkpoint(spark)).select("user_id", F.unix_micros("first_seen").alias("first_us"))


#: A lease of twelve hours for each user, kept by any event but an error, which closes it.
LEASES = """
    WITH w AS (SELECT user_id, epoch_us(ts) AS tu, event_type AS label, lag(epoch_us(ts)) OVER u AS prev_at, lag(event_type) OVER u AS prev, lead(epoch_us(ts)) OVER u AS next_at FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_type)),
    o AS (SELECT *, tu + 43200000000 AS until, label <> 'error' AND (prev_at IS NULL OR prev = 'error' OR tu > prev_at + 43200000000) AS opens, (SELECT max(epoch_us(ts)) // 1000 FROM events) AS watermark FROM w),
    g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY tu, label ROWS UNBOUNDED PRECEDING) AS lease FROM o),
    l AS (SELECT user_id, lease, count(*) AS beats, array_to_string(list_reverse(list_slice(list(label ORDER BY tu DESC, label DESC), 1, 5)), ',') AS recent FROM g WHERE label <> 'error' GROUP BY user_id, lease),
    e AS (SELECT user_id, lease, 'closed' AS event, tu AS at_us FROM g WHERE label = 'error' AND prev <> 'error' AND tu <= prev_at + 43200000000
          UNION ALL SELECT user_id, lease, 'lapsed', until FROM g WHERE label <> 'error' AND (next_at > until OR (next_at IS NULL AND (until + 999) // 1000 <= watermark)))
    SELECT user_id, 'opened' AS event, tu AS at_us, CAST(0 AS BIGINT) AS beats, '' AS recent FROM g WHERE opens
    UNION ALL SELECT e.user_id, e.event, e.at_us, l.beats, l.recent FROM e JOIN l ON l.user_id = e.user_id AND l.lease = e.lease
"""


@query(LEASES)
def stream_leases(spark, d):
    """Leases by event time: opened, closed, or lapsed once the watermark has passed their end, with their last five events."""
    before = leases.provided(spark)
    try:
        told = leases.lease_events(_events(spark, d), "user_id", "ts", "event_type", timedelta(hours=12), "0 seconds", ending="error", cap=5)
        return changes.drain(told, f"s{uuid.uuid4().hex}", "append", _checkpoint(spark))
    finally:
        leases.restored(spark, before)


@query("""
    WITH c AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS watermark FROM events)
    SELECT event_type, epoch_us(start) AS start_us, n FROM c, w WHERE start + INTERVAL 6 HOUR <= watermark
""")
def stream_closed_windows(spark, d):
    """Counts of six hours and type, told once no row can change them: the watermark, an hour behind, has passed their end."""
    counted = changes.windowed(_events(spark, d), "ts", "6 hours", "1 hour", "event_type")
    return changes.drain(counted, f"s{uuid.uuid4().hex}", "append", _checkpoint(spark)).select("event_type", F.unix_micros("start").alias("start_us"), "n")
