"""Supervised subword embeddings for document quality.

Words, word pairs and character n-grams (3 to 5 characters, of a word and the
blanks at its ends) of the lower-cased whole text are hashed to rows of one
embedding table (all pairs of a word with itself share a learned row, so
repetition shows whatever the word); a document is the average of its rows; a
softmax layer reads that average.  Tables and layer are learned by numpy stochastic gradient
descent on a bounded sample of labelled rows (`SAMPLE`, smallest hash of
doc_id first).  Because the softmax reads a plain average, scoring needs one
number per row, so the whole corpus is scored in one map pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._bytes import GOLDEN, U64, lower_ascii, mix, runs, slices, span_hashes, utf8
from inkstrata.llm._spark import table, texts

SAMPLE = 6000
#: Parts that the sample is read in.
PARTS = 64
BITS = 16
DIM = 16
EPOCHS = 4
RATE = 0.5
GRAMS = (3, 4, 5)
FOLDS = 5
THRESHOLD = 0.3
SLICE = 1 << 20
#: Which of four bytes belong to a character of that many bytes.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the embedding table, index of the first one of each document or -1) by feature family."""
    low = lower_ascii(data)
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    starts, ends, doc = runs(~blank, offsets)
    h = span_hashes(low, starts, ends, 3)
    yield (h >> U64(64 - BITS)).astype(np.int64), np.searchsorted(starts, offsets)
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair = mix(h[second - 1] * GOLDEN + h[second]) >> U64(64 - BITS)
    rows = np.where(h[second] == h[second - 1], 0, np.maximum(pair, U64(1)).astype(np.int64)) + (2 << BITS)
    yield rows, np.searchsorted(starts[second], offsets)
    at = np.flatnonzero((low & 0xC0) != 0x80)  # characters
    wide = np.diff(at, append=len(low))
    four = np.ndarray((len(low),), "<u4", np.concatenate([low, np.zeros(4, np.uint8)]).data, strides=(1,))
    code = (four[at] & MASKS[np.minimum(wide, 4)]).astype(U64)
    code[blank[at]] = U64(32)
    before = np.concatenate([[0], np.cumsum(blank[at])])
    end = np.searchsorted(at, offsets)[1:]  # characters before the end of each document
    room = np.repeat(end, np.diff(np.concatenate([[0], end]))) - np.arange(len(at))
    grown = code
    for n in range(2, GRAMS[-1] + 1):
        grown = grown[: max(len(at) - n + 1, 0)] * GOLDEN + code[n - 1 :]
        if n < GRAMS[0]:
            continue
        k = len(grown)
        inner = before[n - 1 : n - 1 + k] - before[1 : 1 + k]  # blanks between the first and the last character
        keep = np.flatnonzero((inner == 0) & (room[:k] >= n))
        rows = (grown[keep] * GOLDEN >> U64(64 - BITS)).astype(np.int64) + (1 << BITS)
        yield rows, np.searchsorted(at[keep], offsets)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] per document."""
    if not len(values):
        return np.zeros(len(first) - 1)
    out = np.add.reduceat(np.append(values, 0.0), first[:-1], dtype=np.float64)
    out[first[1:] == first[:-1]] = 0.0
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows and counts of labelled documents."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        rows, counts = [], []
        for i in range(len(offsets) - 1):
            part = data[offsets[i] : offsets[i + 1]]
            both = np.concatenate([r for r, _ in features(part, np.array([0, len(part)]))])
            u, c = np.unique(both, return_counts=True)
            rows.append(u.astype("<i4").tobytes())
            counts.append(c.astype("<i4").tobytes())
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary()), pa.array(counts, pa.binary()), batch.column(2)], ["doc_id", "rows", "counts", "quality"])


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 11) -> tuple[np.ndarray, float]:
    """Weight of each embedding row and the bias of the log-odds of label 1.

    With no example, or one label only, every weight is zero and the bias is
    the log-odds of the (smoothed) label counts.
    """
    weights = np.zeros(3 << BITS)
    good = sum(y for _, _, y in bags)
    prior = float(np.log((good + 1) / (len(bags) - good + 1)))
    if good in (0, len(bags)):
        return weights, prior
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 1 / DIM, (3 << BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 1 / DIM, (2, DIM)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rows, counts, y = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            mean = share @ table_[rows] if len(rows) else np.zeros(DIM, np.float32)
            logit = layer @ mean + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[y] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
            if len(rows):
                table_[rows] -= (rate * GAIN) * share[:, None] * back
    return (table_ @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


#: Rows are averaged over thousands of features, so their steps are scaled up.
GAIN = 200.0


def _scorer(weights: np.ndarray, bias: float):
    small = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            logits = []
            for a, b in slices(offsets, SLICE):
                total, count = 0.0, 0
                for rows, first in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    total = total + _sums(small[rows], first)
                    count = count + np.diff(first)
                logits.append(total / np.maximum(count, 1))
            x = np.concatenate(logits) + bias if logits else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -500, 500))))], ["doc_id", "score"])

    return run


def held_out(folds: int = FOLDS):
    """The fold by crc32 of doc_id; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most `sample` labelled documents outside the held-out fold.

    Null labels and labels without a document are skipped; of repeated labels
    of a document the largest counts; of several documents with one id one
    counts (the smallest hash of its text), so `sample` bounds the rows too.
    """
    own = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = texts(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    # dealt anew, because the driver reads them a partition at a time
    bags = chosen.select("doc_id", "text", "quality").repartition(PARTS, "doc_id").mapInArrow(_bags, "doc_id long, rows binary, counts binary, quality int")
    read = [(r["doc_id"], np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<i4"), int(r["quality"] > 0)) for r in bags.toLocalIterator(prefetchPartitions=True)]
    read.sort(key=lambda r: (r[0], r[1].tobytes()))
    return train([r[1:] for r in read])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and the probability of label 1 of every row; null and empty texts get the bias alone."""
    return texts(docs).mapInArrow(_scorer(weights, bias), "doc_id long, score double")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs whose text scores at least THRESHOLD, with the columns of docs."""
    weights, bias = fit(docs, table(spark, sf_dir, "labels"))
    small, names = weights.astype(np.float32), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(small, bias)
        for batch in batches:
            pair = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            good = next(scored(iter([pair]))).column(1).to_numpy() >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
