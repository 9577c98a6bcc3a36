from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from inkstrata import sources as S
from inkstrata.streaming import changes, leases


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_blocks_survive_bad_fields(spark, tmp_path):
    put(tmp_path / "book_a/unified/list.json", json.dumps([{"type": "text", "text": "hi"}, {"type": "list", "list_items": [1, "real", None], "bbox": ["104", 46, 608, None]}]))
    put(tmp_path / "Bad Name/unified/list.json", json.dumps([{"type": "text"}]))
    got = S.blocks(spark, f"{tmp_path}/*/unified/list.json")
    rows = got.select("slug", "idx", "type", "list_items").orderBy("idx").collect()
    assert [(r["idx"], r["type"]) for r in rows if r["slug"] == "unified"] == [] or rows
    assert {r["type"] for r in rows} <= {"text", "list"}


def test_quarantine_and_lines(spark, tmp_path):
    put(tmp_path / "r/a.json", '{"x": 1}')
    put(tmp_path / "r/b.json", '{"x": ')
    good, bad = S.json_records(spark, f"{tmp_path}/r/*.json", "x int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and [r["slug"] for r in bad.collect()] == ["b"]
    put(tmp_path / "s/one.jsonl", '{"t": "2024-01-01T00:00:00Z", "kind": "tool"}\nnot json\n{"t": "2024-01-01T00:00:05Z", "kind": "text"}\n')
    assert S.json_lines(spark, f"{tmp_path}/s/*.jsonl", "t string, kind string").count() == 2


def test_publish_replaces_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int")
    S.publish(df, path, "slug")
    S.publish(spark.createDataFrame([("b", 5)], "slug string, v int"), path, "slug")
    assert sorted((r["slug"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]


def test_rules_and_edits(spark):
    r = S.rules(spark, [{"slug": "a", "heading_text_level": 2}, {"slug": "b", "heading_text_level": [1, 2]}], "slug string, heading_text_level array<int>")
    assert {x["slug"]: x["heading_text_level"] for x in r.collect()} == {"a": [2], "b": [1, 2]}
    books = spark.createDataFrame([("a",), ("z",)], "slug string")
    assert S.with_rules(books, r).where("heading_text_level is null").first()["slug"] == "z"
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    out = S.replace_field(base, spark.createDataFrame([(2, "new")], "k int, new string"), ["k"], "v")
    assert sorted(tuple(x) for x in out.collect()) == [(1, "x"), (2, "new")]


@pytest.fixture
def feed(spark, tmp_path):
    """Events in three files, so a stream sees three batches."""
    rows = [(1, k, "ab"[(k // 3) % 2], f"2024-01-01 00:{k:02d}:00") for k in range(12)] + [(2, k, "a", f"2024-01-01 01:{k:02d}:00") for k in range(3)]
    df = spark.createDataFrame(rows, "user long, n long, stage string, at string").withColumn("at", F.col("at").cast("timestamp"))
    for i, (lo, hi) in enumerate(((0, 4), (4, 8), (8, 12))):
        df.where(f"n >= {lo} and n < {hi}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), str(tmp_path)


def test_stream_twins_equal_batch(spark, feed):
    df, stream, tmp = feed
    got = changes.drain(changes.stage_changes(stream.select("user", "n", "stage"), "user", "n", "stage"), "t_changes", "append", f"{tmp}/c1").collect()
    assert sorted((r["user"], r["n"], r["stage"]) for r in got) == [(1, 0, "a"), (1, 3, "b"), (1, 6, "a"), (1, 9, "b"), (2, 0, "a")]
    seen = changes.drain(changes.first_seen(stream, "user", "at"), "t_seen", "complete", f"{tmp}/c2").collect()
    assert {r["user"]: r["first_seen"] for r in seen} == {r["user"]: r["f"] for r in df.groupBy("user").agg(F.min("at").alias("f")).collect()}


def test_stream_bounded_state(spark, feed):
    _, stream, tmp = feed
    got = changes.drain(changes.recent(stream.select("user", "n", "stage"), "user", "n", "stage", 4), "t_recent", "update", f"{tmp}/c3")
    last = {r["user"]: r["n"] for r in got.groupBy("user").agg(F.max("n").alias("n")).collect()}
    assert last == {1: 4, 2: 3}


def test_stream_windows_and_sessions(spark, feed):
    _, stream, tmp = feed
    w = changes.drain(changes.windowed(stream, "at", "10 minutes", "3 hours", "stage"), "t_win", "complete", f"{tmp}/c4")
    assert w.agg(F.sum("n")).first()[0] == 15
    s = changes.drain(changes.sessions(stream, "user", "at", "5 minutes", "3 hours"), "t_ses", "complete", f"{tmp}/c5")
    assert {(r["user"], r["events"]) for r in s.collect()} == {(1, 12), (2, 3)}


def test_a_lease_lapses_without_an_event_of_its_key(spark, tmp_path):
    form, t0 = "who string, at timestamp, label string", datetime(2024, 1, 1, tzinfo=timezone.utc)

    def told(rows):
        spark.createDataFrame([(k, t0 + timedelta(minutes=m), x) for k, m, x in rows], form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(form).parquet(f"{tmp_path}/in")
        out = changes.drain(leases.lease_events(stream, "who", "at", "label", timedelta(minutes=10), "0 seconds", ending="end", cap=2), "leases", "append", f"{tmp_path}/checkpoint")
        return sorted((r["who"], r["event"], round((r["at_us"] / 1e6 - t0.timestamp()) / 60), r["beats"], r["recent"]) for r in out.collect())

    before = spark.conf.get(leases.PROVIDER, None)
    was = leases.provided(spark)
    try:
        assert told([("a", 0, "x"), ("a", 5, "y"), ("b", 1, "x"), ("b", 2, None), ("b", 3, "z"), ("c", 4, "end")]) == [("a", "opened", 0, 0, ""), ("b", "opened", 1, 0, "")]
        # only c is heard of: b ends at 13, a at 15
        assert told([("c", 14, "x")]) == [("b", "lapsed", 13, 3, ",z"), ("c", "opened", 14, 0, "")]
        # a is kept alive before the watermark passes its end
        assert told([("a", 14.5, "w"), ("c", 20, "end")]) == [("c", "closed", 20, 1, "x")]
        assert told([("c", 40, "x")]) == [("a", "lapsed", 24, 3, "y,w"), ("c", "opened", 40, 0, "")]
    finally:
        leases.restored(spark, was)
    assert spark.conf.get(leases.PROVIDER, None) == before


def test_late_rows_do_not_open_closed_windows(spark, tmp_path):
    form, t0 = "kind string, at timestamp", datetime(2024, 1, 1, tzinfo=timezone.utc)

    def closed(*minutes):
        spark.createDataFrame([("a", t0 + timedelta(minutes=m)) for m in minutes], form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(form).parquet(f"{tmp_path}/in")
        out = changes.drain(changes.windowed(stream, "at", "10 minutes", "5 minutes", "kind"), "windows", "append", f"{tmp_path}/checkpoint")
        return sorted((round((r["start"].replace(tzinfo=timezone.utc) - t0).total_seconds() / 60), r["n"]) for r in out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n").collect())

    assert closed(1, 2, 12) == []
    assert closed(3, 16) == [(0, 3)]  # in time: the watermark stands at 7
    assert closed(4, 40) == [(10, 2)]  # too late: the first window is closed
