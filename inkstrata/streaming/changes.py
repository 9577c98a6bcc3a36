"""Structured Streaming twins: append on change, first sighting, bounded tails, sessions, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")


def stage_changes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's last one; the last value is the state."""
    kinds = dict(stream.dtypes)

    def run(group, parts: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for at, v in _rows(parts, [order])[[order, value]].itertuples(index=False):
            if v is not None and v != last:
                out.append((group[0], at, v))
                last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, value])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"
    return stream.groupBy(key).applyInPandasWithState(run, schema, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Earliest time per key, updated by late evidence."""
    return stream.groupBy(key).agg(F.min(at).alias("first_seen"))


def recent(stream: DataFrame, key: str, order: str, value: str, most: int = 200) -> DataFrame:
    """The last `most` values of each key as one JSON list, and the order of the newest; state is bounded."""
    kinds = dict(stream.dtypes)

    def run(group, parts: Iterator[pd.DataFrame], state: GroupState):
        import json

        held = json.loads(state.get[0]) if state.exists else []
        rows = _rows(parts, [order])
        held = (held + [str(v) for v in rows[value]])[-most:]
        state.update((json.dumps(held),))
        yield pd.DataFrame([(group[0], json.dumps(held), len(held), rows[order].iloc[-1])], columns=[key, "recent", "n", "upto"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, recent string, n int, upto {kinds[order]}", "held string", "update", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions by silence with a watermark (an addition: the batch operators have no event-time limit)."""
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def windowed(stream: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and key with a watermark (an addition)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote: a table beside the checkpoint.

    Each micro-batch replaces its own folder, so a batch that runs again after
    a failure leaves nothing twice.  In complete mode the last batch is the result.
    """
    out, done = f"{checkpoint.rstrip('/')}-{name}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        done.append(number)

    q = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*[f"{out}/{n}" for n in (done[-1:] if mode == "complete" else sorted(set(done)))])
