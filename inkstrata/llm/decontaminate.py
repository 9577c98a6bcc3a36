"""Benchmark decontamination by winnowing.

Words become 64-bit hashes; of every six neighbouring five-word grams the one
with the smallest hash is kept, on both sides, by the same rule.  A shared
span of ten words therefore always shares a kept gram.  Test and training
fingerprints are joined, hits are extended to the longest common span, and
spans of at least ten words count.  Items of fewer words are one window each
and are joined by the gram of their own length.  A document whose fingerprints
hit so often that extending each would cost more than its length is compared
window by window, so no text costs the product of its repeats and an item's.

The benchmark is read in blocks of bounded bytes; each block is broadcast and
meets every document once, so nothing is shuffled and no list of candidate
pairs is made.  More items only mean more blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._bytes import GOLDEN, U64, lower_ascii, mix, runs, slices, span_hashes, utf8
from inkstrata.llm._spark import staged, table, texts

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 8 << 20
SLICE = 1 << 20
#: Hits of one document, besides eight a word, up to which each is extended by itself.
HEAVY = 4096

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends and the document of each word of lower-cased bytes."""
    starts, ends, doc = runs(WORD[data], offsets)
    return span_hashes(data, starts, ends), starts, ends, doc


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word gram inside one document, and its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = np.zeros(n, U64)
    for j in range(k):
        g = mix(g + h[j : n + j] + U64((j + 1) * int(GOLDEN) & (2**64 - 1)))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return g[at], at


def winnow(g: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Indices into g of the grams that are smallest in some run of `window` neighbouring grams."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, where = g[:n].copy(), np.arange(n)
    for j in range(1, window):
        lower = g[j : n + j] < least
        least = np.where(lower, g[j : n + j], least)
        where = np.where(lower, np.arange(j, n + j), where)
    return np.unique(where[doc[at[:n]] == doc[at[window - 1 :]]])


class Block:
    """The fingerprints of some benchmark items, ready to meet documents."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        items = sorted({(i, t) for i, t in items if t is not None and i is not None})
        self.ids = np.array([i for i, _ in items], np.int64)
        data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
        data = lower_ascii(data)
        self.h, starts, ends, self.doc = words(data, offsets)
        self.text = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        count = np.bincount(self.doc, minlength=len(items))
        g, at = grams(self.h, self.doc, GRAM)
        kept = winnow(g, at, self.doc, WINDOW - GRAM + 1)
        self.prints = self._table(g[kept], at[kept])
        self.long: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(count[(count > 0) & (count < WINDOW)]).tolist():
            g, at = grams(self.h, self.doc, n)
            own = count[self.doc[at]] == n
            self.short[n] = self._table(g[own], at[own])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every window of the items of at least WINDOW words, made when a document first needs it."""
        if self.long is None:
            self.long = self._table(*grams(self.h, self.doc, WINDOW))
        return self.long

    @staticmethod
    def _table(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, then for each the run of item positions that have it."""
        order = np.argsort(g, kind="stable")
        keys, first = np.unique(g[order], return_index=True)
        return keys, np.append(first, len(g)), at[order]


def _known(prints: tuple[np.ndarray, np.ndarray, np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of g are among the keys, and the key of each."""
    keys = prints[0]
    if not len(keys) or not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = (keys[:, None] >> U64(44)).ravel() if len(keys) < 2**16 else None
    if low is not None:  # a small filter first: most grams of most documents meet nothing
        seen = np.zeros(2**20, bool)
        seen[low.astype(np.int64)] = True
        some = np.flatnonzero(seen[(g >> U64(44)).astype(np.int64)])
    else:
        some = np.arange(len(g))
    k = np.minimum(np.searchsorted(keys, g[some]), len(keys) - 1)
    ok = keys[k] == g[some]
    return some[ok], k[ok]


def hits(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
    """Words per document, hit flags per word, and the items found in each document."""
    data = lower_ascii(data)
    h, starts, ends, doc = words(data, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    mark = np.zeros(len(h) + 1, np.int64)
    found: dict[int, set[int]] = {}

    def same(i: int, j: int, length: int) -> bool:
        return all(data[starts[i + x] : ends[i + x]].tobytes() == block.text[j + x] for x in range(length))

    def take(i: int, j: int, length: int) -> None:
        if same(i, j, length):
            mark[i] += 1
            mark[i + length] -= 1
            found.setdefault(int(doc[i]), set()).add(int(block.ids[block.doc[j]]))

    def take_windows(length: int, prints: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray | None = None) -> None:
        """Every place of a window, each once, however many items have it; own: the documents to look at."""
        g, at = grams(h, doc, length)
        if own is not None:
            g, at = g[own[doc[at]]], at[own[doc[at]]]
        some, k = _known(prints, g)
        at = at[some]
        good = np.array([same(i, j, length) for i, j in zip(at.tolist(), prints[2][prints[1][k]].tolist(), strict=True)], bool)
        at, k = at[good], k[good]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + length, -1)
        for of, key in np.unique(np.stack([doc[at], k]), axis=1).T.tolist():
            found.setdefault(of, set()).update(block.ids[block.doc[prints[2][prints[1][key] : prints[1][key + 1]]]].tolist())

    if len(h):
        g, at = grams(h, doc, GRAM)
        kept = winnow(g, at, doc, WINDOW - GRAM + 1)
        g, at = g[kept], at[kept]
        some, k = _known(block.prints, g)
        first, items = block.prints[1:]
        pairs = first[k + 1] - first[k]
        # a document whose hits repeat (one word over and over, a phrase of many items) is read window by window instead of hit by hit
        heavy = np.bincount(doc[at[some]], weights=pairs, minlength=len(n)) > HEAVY + 8 * n
        if heavy.any():
            take_windows(WINDOW, block.windows(), heavy)
            light = ~heavy[doc[at[some]]]
            some, k, pairs = some[light], k[light], pairs[light]
        each = np.repeat(first[k] - (np.cumsum(pairs) - pairs), pairs) + np.arange(int(pairs.sum()))
        i, j = at[np.repeat(some, pairs)], items[each]
        # two hits on one diagonal and in one span are extended once
        done: dict[tuple[int, int, int], int] = {}
        for a, b in sorted(zip(i.tolist(), j.tolist(), strict=True)):
            of, item = doc[a], block.doc[b]
            key = (int(of), int(item), a - b)
            if done.get(key, -1) > a:
                continue
            left = 0
            while a - left > 0 and b - left > 0 and doc[a - left - 1] == of and block.doc[b - left - 1] == item and h[a - left - 1] == block.h[b - left - 1]:
                left += 1
            right = 0
            while a + right < len(h) and b + right < len(block.h) and doc[a + right] == of and block.doc[b + right] == item and h[a + right] == block.h[b + right]:
                right += 1
            done[key] = a + right
            if left + right >= WINDOW:
                take(a - left, b - left, left + right)
        for length, prints in block.short.items():
            take_windows(length, prints)
    return n, np.cumsum(mark[:-1]) > 0, found


def _pass(block: Block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n_words, spans, items = [], [], []
            for a, b in slices(offsets, SLICE):
                n, hit, found = hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], block)
                first = np.cumsum(n) - n
                n_words += n.tolist()
                for k in range(b - a):
                    ids = found.get(k)
                    items.append(sorted(ids) if ids else [])
                    spans.append(_ranges(hit[first[k] : first[k] + n[k]]) if ids else [])
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"]
            )

    return run


def _ranges(hit: np.ndarray) -> list[int]:
    """start, end, start, end ... of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


FOUND = "doc_id long, n_words long, spans array<long>, items array<long>"


def _merge(group: pa.Table) -> pa.Table:
    """Blocks of one row: the union of hit spans and items."""
    hit = np.zeros(group["n_words"][0].as_py(), bool)
    for spans in group["spans"].to_pylist():
        for a, b in zip(spans[::2], spans[1::2], strict=True):
            hit[a:b] = True
    items = sorted({i for x in group["items"].to_pylist() for i in x})
    return pa.table({"row": group["row"][:1], "doc_id": group["doc_id"][:1], "n_words": group["n_words"][:1], "spans": pa.array([_ranges(hit)], pa.list_(pa.int64())), "items": pa.array([items], pa.list_(pa.int64()))})


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of about block_bytes, one at a time in the driver."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        yield Block([tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()])


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs without any hit, with all their columns.

    Each block is one map pass; where there are several, the rows that are left
    are written after each, so neither the driver nor a plan holds two blocks.
    """
    at = docs.columns.index("text")

    def keep(block: Block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                good = np.ones(batch.num_rows, bool)
                for a, b in slices(offsets, SLICE):
                    good[[a + k for k in hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], block)[2]]] = False
                yield batch.filter(pa.array(good))

        return run

    schema = docs.schema
    several = False
    for block in _blocks(benchmark, block_bytes):
        docs = (staged(docs, "winnow-left") if several else docs).mapInArrow(keep(block), schema)
        several = True
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit word spans (start, end, ...) and item ids for every row of docs.

    Null texts have no words.  Null items, items without words and an empty
    benchmark hit nothing; repeated items count once.  A repeated row of docs
    repeats in the result.
    """
    own = texts(docs)
    blocks = _blocks(benchmark, block_bytes)
    one, more = next(blocks), next(blocks, None)
    if more is None:
        return own.mapInArrow(_pass(one), FOUND)
    numbered = staged(own.withColumn("row", F.monotonically_increasing_id()), "winnow").select("row", "text", "doc_id")
    out = None
    for block in chain((one, more), blocks):  # each is asked for once the one before has been written
        found = numbered.select("row", "text").mapInArrow(_pass(block), FOUND).withColumnRenamed("doc_id", "row")
        # rows without a hit say their number of words once, with the first block
        found = staged(found if out is None else found.where("size(items) > 0"), "winnow-found")
        out = found if out is None else out.unionByName(found)
    out = out.join(numbered.select("row", "doc_id"), "row")
    return out.groupBy("row").applyInArrow(_merge, "row long, " + FOUND).drop("row")


def sha256_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda k: F.element_at("spans", (k + 1).cast("int")) - F.element_at("spans", k.cast("int")))
    n_hit = F.when(F.size("spans") == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
