"""Keep a search index of a growing text table: takes the files that are new, adds them as one batch each time.

    python jobs/search_index.py --config jobs/search_index.json --documents PATH --index PATH --checkpoint PATH

New files of the table are read as a stream that ends when it has caught up;
the stream's checkpoint knows what was taken.  Each micro-batch becomes one
batch of the stored index (`inkstrata.operators.stored`): a document that
comes again takes the place of its earlier version, one that comes with a null
text is gone.  A batch that failed half-way runs again under its own number
and writes over its own folders, so a rerun gives the same index.  Checkpoint
and index belong together: a new index needs a new checkpoint.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.operators import search, stored

log = logging.getLogger("jobs.search_index")
DEFAULTS = {"book": "lang", "chunk": "doc_id", "text": "text", "buckets": stored.BUCKETS, "files_per_batch": 1000}


def _watched(path: str) -> str:
    """A table may be one file, which a stream takes by a pattern only; a pattern that matches a folder means its files."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Catch up with the table at `documents`; gives the number of batches and what they read and wrote.

    config: documents, index and checkpoint are paths; book, chunk and text name
    columns; buckets is fixed for the life of an index; files_per_batch bounds
    a micro-batch.  A table without new files adds nothing.
    """
    c = DEFAULTS | config
    done = dict.fromkeys(("batches", "read", "postings", "chunks", "replaced"), 0)

    def write(batch: DataFrame, number: int) -> None:
        counts = stored.add(batch, c["index"], number, c["book"], c["chunk"], c["text"], c["buckets"])
        for k, v in {"batches": 1, **counts}.items():
            done[k] += v
        log.info("batch %d: %s", number, counts)

    columns = [c["book"], c["chunk"], c["text"]]
    schema = spark.read.parquet(c["documents"]).select(*columns).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(_watched(c["documents"]))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", c["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s", c["index"], done)
    return done


def read(spark: SparkSession, config: dict) -> DataFrame:
    """The live index: one row per book, token and range of chunk ids, with the ids in order."""
    c = DEFAULTS | config
    rows = stored.segments(spark, c["index"], c["book"], c["chunk"])
    ids = F.transform("offsets", lambda x: x + F.col("segment") * search.SPAN)
    return rows.select(c["book"], "token", "segment", F.size("offsets").cast("long").alias("n"), F.array_join(ids, ",").alias("chunks"))


def main(argv: list[str]) -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    for name in ("documents", "index", "checkpoint"):
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
