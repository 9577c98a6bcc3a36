"""The jobs over growing copies of the tables, their reruns, and their SQL."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import search as S
from inkstrata.operators import stored as X
from jobs import publish_library, search_index
from jobs.queries import ORACLE_SQL, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], connect(SF)) == ""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tokens(spark, docs):
    found = S.postings(docs.where("text is not null"), ["lang", "doc_id"])
    return rows(found.select("lang", "doc_id", "token"))


def test_index_takes_only_what_is_new(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text", "source")
    path, half = str(tmp_path / "documents"), docs.where("doc_id < 100")
    config = {"documents": path, "index": str(tmp_path / "index"), "checkpoint": str(tmp_path / "checkpoint"), "files_per_batch": 2}
    half.repartition(5).write.parquet(path)
    first = search_index.run(spark, config)
    assert first["read"] == first["chunks"] == half.count() and first["replaced"] == 0 and first["batches"] == 3
    assert rows(X.postings(spark, config["index"], "lang", "doc_id").select("lang", "doc_id", "token")) == tokens(spark, half)
    before = rows(search_index.read(spark, config))
    assert search_index.run(spark, config) == dict.fromkeys(first, 0)
    assert rows(search_index.read(spark, config)) == before
    # the rest, ten documents in other words, and five that are gone
    changed = half.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("altered words "), F.upper("text")))
    gone = half.where("doc_id % 20 = 5").withColumn("text", F.lit(None).cast("string"))
    docs.where("doc_id >= 100").unionByName(changed).unionByName(gone).coalesce(1).write.mode("append").parquet(path)
    second = search_index.run(spark, config)
    assert second["read"] == 115 and second["replaced"] == 15 and second["batches"] == 1
    now = docs.where("NOT (doc_id < 100 AND (doc_id % 10 = 0 OR doc_id % 20 = 5))").unionByName(changed)
    assert rows(X.postings(spark, config["index"], "lang", "doc_id").select("lang", "doc_id", "token")) == tokens(spark, now)
    for terms in (["altered"], ["ther", "onen"], ["th", "e"], ["nowhere"]):
        assert rows(X.candidates(spark, config["index"], "lang", "doc_id", terms)) == rows(S.candidates(now, "lang", "doc_id", terms))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "index")
    X.add(docs, path, 0, "lang", "doc_id")
    second = docs.where("doc_id < 20").withColumn("text", F.lit("new words zzwords"))
    for _ in range(2):
        counts = X.add(second, path, 1, "lang", "doc_id")
        assert counts["replaced"] == 20
    assert X.live_chunks(spark, path, "lang", "doc_id").count() == docs.count()
    assert X.postings(spark, path, "lang", "doc_id", ["zzwords"]).count() == 20


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    X.add(spark.read.parquet(f"{SF}/documents.parquet"), path, 0, "lang", "doc_id")
    found = X.postings(spark, path, "lang", "doc_id", ["ther", "onen"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "Scan parquet" in x and "offsets" in x)
    assert "PartitionFilters: [bucket" in scan and "text" not in scan
    files = spark.read.parquet(f"{path}/postings")
    terms = files.where(files.bucket.isin(*[X.bucket(F.lit(t)) for t in ("ther", "onen")]))
    assert 0 < terms.select("bucket").distinct().count() <= 2 < files.select("bucket").distinct().count()


def test_segments_are_bounded_and_odd_rows_have_a_place(spark, tmp_path):
    odd = [(1, "en", "a same word"), (1, "en", "another part"), (None, "en", "lost word"), (S.SPAN + 1, "en", "same word"), (-3, None, "same"), (5, "en", None), (6, "en", "")]
    path = str(tmp_path / "index")
    X.add(spark.createDataFrame(odd, "doc_id long, lang string, text string"), path, 0, "lang", "doc_id")
    got = {(r["lang"], r["token"], r["segment"]): r["chunks"] for r in search_index.read(spark, {"index": path}).collect()}
    assert got[("en", "same", 0)] == "1" and got[("en", "same", 1)] == str(S.SPAN + 1) and got[(None, "same", -1)] == "-3"
    assert got[("en", "another", 0)] == "1" and not any(t == "lost" for _, t, _ in got)
    assert {r["doc_id"] for r in X.live_chunks(spark, path, "lang", "doc_id").collect()} == {1, S.SPAN + 1, -3, 6}


def test_library_is_the_same_after_a_rerun_and_grows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    path, config = str(tmp_path / "documents"), {"documents": str(tmp_path / "documents"), "library": str(tmp_path / "library")}
    docs.where("lang <> 'de'").write.parquet(path)
    one = publish_library.run(spark, config)
    first = [rows(x) for x in publish_library.read(spark, config)]
    assert one == publish_library.run(spark, config)
    assert first == [rows(x) for x in publish_library.read(spark, config)]
    assert one["read"] == one["pages"] == len(first[0]) and one["books"] == len(first[1])
    # a later run over German books alone leaves the others in place
    docs.where("lang = 'de'").write.mode("overwrite").parquet(str(tmp_path / "german"))
    publish_library.run(spark, config | {"documents": str(tmp_path / "german")})
    pages, books = publish_library.read(spark, config)
    assert pages.count() == docs.count() and rows(pages.where("lang <> 'de'")) == first[0]
    assert books.count() == docs.select("lang", "source").distinct().count()
    # one book alone: the others of its language stay in the catalogue
    docs.where("lang = 'en' AND source = 'src1'").limit(3).write.parquet(str(tmp_path / "one"))
    assert publish_library.run(spark, config | {"documents": str(tmp_path / "one")}) == {"read": 3, "pages": 3, "books": 1}
    pages, again = publish_library.read(spark, config)
    assert again.count() == docs.select("lang", "source").distinct().count() and again.where("lang = 'en' AND source = 'src1'").first()["chapters"] == 3


def test_library_of_odd_rows(spark, tmp_path):
    odd = [(1, "one text", "en", "a"), (2, "one text", "en", "a"), (3, "one text", "en", "b"), (None, "one text", "en", "a"), (4, None, None, ""), (5, "", "none", "none"), (6, "half $x", "en", "b")]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    config = {"documents": str(tmp_path / "d"), "library": str(tmp_path / "l")}
    assert publish_library.run(spark, config) == {"read": 7, "pages": 7, "books": 3}
    pages, books = publish_library.read(spark, config)
    assert {(r["doc_id"], r["copy_of"]) for r in pages.where("copy_of is not null").collect()} == {(2, 1)}
    assert {(r["lang"], r["source"]): r["status"] for r in books.collect()} == {("en", "a"): "ready", ("en", "b"): "review", ("none", "none"): "blocked"}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "e"))
    assert publish_library.run(spark, config | {"documents": str(tmp_path / "e")}) == {"read": 0, "pages": 0, "books": 0}
    assert publish_library.read(spark, config)[0].count() == 7


@pytest.mark.parametrize(("job", "paths"), [("search_index", ("documents", "index", "checkpoint")), ("publish_library", ("documents", "library"))])
def test_command_line(job, paths, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"documents": f"{SF}/documents.parquet"}))
    given = [x for p in paths[1:] for x in (f"--{p}", str(tmp_path / p))]
    said = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), "--config", str(config), *given], capture_output=True, text=True, timeout=300, cwd=tmp_path, check=True)
    assert "read" in said.stderr and (tmp_path / paths[1]).is_dir()
