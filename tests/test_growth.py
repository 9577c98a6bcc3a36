"""What shows only on larger tables: sides that are broadcast, files, calls to the state store, times between two seconds."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import pytest

from inkstrata import sources as src
from inkstrata.operators import search, stored
from inkstrata.plans import ORACLE_SQL, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["context_references", "realigned_patches", "repair_sources"])
def test_nothing_that_grows_is_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_upload_half_a_second_inside_the_limit_is_fresh(spark, tmp_path):
    rows = [(1, "2024-01-29 22:00:00", "click"), (2, "2024-01-29 22:00:00.5", "click"), (3, "2024-01-29 21:59:59.9", "view"), (4, None, "view"), (5, None, "error"), (6, "2024-01-29 23:30:00", None)]
    spark.createDataFrame(rows, "event_id long, at string, event_type string").selectExpr("event_id", "CAST(at AS timestamp_ntz) AS ts", "event_type").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "events.parquet")
    got = QUERIES["upload_capacity"](spark, str(tmp_path))
    assert compare(got, ORACLE_SQL["upload_capacity"], connect(str(tmp_path))) == ""
    assert got.first()["occupied"] == 3


def test_rule_sets_are_packed_in_few_files(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("rules-*"))
    rows = QUERIES["rule_files"](spark, "/root/testdata/sf0.01").count()
    (made,) = set(shared.glob("rules-*")) - before
    assert rows == 100 and len(list(made.rglob("part-*"))) < 10


def test_packed_rule_sets_read_as_files_of_their_own(spark, tmp_path):
    texts = {"s1": "title: A\nchapters: [{num: 1, title: One}]", "s 2": "title: B", "s3": "title: [open", "s4": "- a list", "s5": "title: C\n---\ntitle: D"}
    for folder, text in texts.items():
        (tmp_path / "one" / folder).mkdir(parents=True)
        (tmp_path / "one" / folder / "rules.yaml").write_text(text)
    src.pack_rules(spark.createDataFrame(list(texts.items()), "folder string, value string"), str(tmp_path / "packed"))
    good, bad = src.rule_files(spark, str(tmp_path / "one" / "*" / "rules.yaml"), "title string")
    seen = src.packed_rules(spark, str(tmp_path / "packed"), "title string")
    assert sorted(map(tuple, seen.where("reason is null").select("folder", "r.title", "faults").collect())) == sorted(map(tuple, good.select("slug", "title", "faults").collect()))
    want = sorted((r["folder"].replace("%20", " "), r["reason"], r["value"]) for r in bad.collect())
    assert sorted(map(tuple, seen.where("reason is not null").select("folder", "reason", "value").collect())) == want and len(want) == 4


def test_lease_reads_and_writes_its_state_once_for_a_batch(spark):
    from inkstrata.streaming.leases import Leases

    calls, state = [], {}

    class Handle:
        def __getattr__(self, name):
            def call(*args):
                if name in ("getValueState", "getListState"):
                    return self
                calls.append(name)
                if name == "update":
                    state["v"] = args[0]
                return {"get": state.get("v"), "exists": "v" in state, "listTimers": []}.get(name)

            return call

    one = Leases("k", 100, "end", 3)
    one.init(Handle())
    rows = [{"us": 10 * i, "at": datetime.fromtimestamp(i / 1e5, timezone.utc), "label": f"b{i}"} for i in range(50)]
    told = list(one.handleInputRows((1,), iter(rows[::-1]), None))
    assert [(r["event"], r["at_us"]) for r in told] == [("opened", 0)] and len(calls) <= 3
    assert state["v"] == (590, 50, ["b47", "b48", "b49"])
    (over,) = one.handleExpiredTimer((1,), None, None)
    assert (over["event"], over["at_us"], over["beats"], over["recent"]) == ("lapsed", 590, 50, "b47,b48,b49")


def test_stored_segments_are_taken_whole_where_nothing_was_replaced(spark, tmp_path):
    form, path = "lang string, doc_id long, text string", str(tmp_path / "index")
    stored.add(spark.createDataFrame([("a", 1, "one two"), ("a", 2, "two"), ("a", 70000, "two three"), (None, 3, "two")], form), path, 0, "lang", "doc_id")

    def same():
        want = search.segments(stored.postings(spark, path, "lang", "doc_id"), "lang", "doc_id").collect()
        got = stored.segments(spark, path, "lang", "doc_id").select("lang", "token", "segment", "offsets").collect()
        return sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 0

    assert "Join" not in stored._current(spark.range(3).selectExpr("id AS doc_id", "0 AS batch"), str(tmp_path / "none"), "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert same()
    stored.add(spark.createDataFrame([("a", 2, "four"), ("b", 1, None), ("a", 5, "two")], form), path, 1, "lang", "doc_id")
    assert same()
