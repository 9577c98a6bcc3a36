"""Leases kept alive by heartbeats: state with timers, so a lease that lapses is told without a new event.

`transformWithState` needs the RocksDB state store: `provided` sets it before the
query starts, `restored` puts the session's own setting back.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _due(until: int | None) -> int | None:
    """The millisecond from which a lease is over."""
    return None if until is None else -(-until // 1000)


class Leases(StatefulProcessor):
    """One lease per key: its end, beats and the last labels (a bounded list), and a timer at its end.

    Out come `opened`, `closed` (an ending event) and `lapsed` (no beat for ttl):
    event, its time in microseconds, beats so far, recent labels, oldest first.
    The state is read and written once for all rows of a key in a batch.
    """

    def __init__(self, name: str, ttl_us: int, ending: str, cap: int) -> None:
        self.name, self.ttl, self.ending, self.cap = name, ttl_us, ending, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("held", "until long, beats long, recent array<string>")

    def _told(self, key: Any, event: str, at: int, beats: int, recent: list[str]) -> Row:
        return Row(**{self.name: key[0], "event": event, "at_us": at, "beats": beats, "recent": ",".join(recent)})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.lease.get()
        until, beats, recent = (held[0], held[1], list(held[2])) if held else (None, 0, [])
        before = _due(until)
        for at, label in sorted((r["us"], r["label"] or "") for r in rows):
            if until is not None and at > until:
                yield self._told(key, "lapsed", until, beats, recent)
                until, beats, recent = None, 0, []
            if label == self.ending:
                if until is not None:
                    yield self._told(key, "closed", at, beats, recent)
                    until, beats, recent = None, 0, []
                continue
            if until is None:
                yield self._told(key, "opened", at, 0, [])
            until, beats = max(until or 0, at + self.ttl), beats + 1
            recent = [*recent, label][-self.cap :]
        if before is not None and before != _due(until):
            self.handle.deleteTimer(before)
        if until is not None:
            self.lease.update((until, beats, recent))
            if before != _due(until):
                self.handle.registerTimer(_due(until))
        elif held:
            self.lease.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.lease.get()
        if held:
            self.lease.clear()
            yield self._told(key, "lapsed", held[0], held[1], list(held[2]))

    def close(self) -> None:
        pass


def provided(spark: SparkSession) -> str | None:
    """Sets the state store that timers need; gives the former setting, for `restored`."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    return before


def restored(spark: SparkSession, before: str | None) -> None:
    if before is None:
        spark.conf.unset(PROVIDER)
    else:
        spark.conf.set(PROVIDER, before)


def lease_events(stream: DataFrame, key: str, at: str, label: str, ttl: timedelta, late: str, ending: str = "", cap: int = 200) -> DataFrame:
    """key, event, at_us, beats, recent: the life of each key's lease by event time.

    An event of label `ending` closes the lease, any other one opens it or
    keeps it for another ttl.  A lease lapses when the watermark passes its end,
    whether or not its key is heard of again.  Events later than `late` are dropped.
    """
    kinds = dict(stream.dtypes)
    rows = stream.selectExpr(f"`{key}` AS key", f"`{at}` AS at", f"unix_micros(`{at}`) AS us", f"CAST(`{label}` AS string) AS label").withWatermark("at", late)
    form = f"{key} {kinds[key]}, event string, at_us long, beats long, recent string"
    return rows.groupBy("key").transformWithState(statefulProcessor=Leases(key, ttl // timedelta(microseconds=1), ending, cap), outputStructType=form, outputMode="Append", timeMode="EventTime")
