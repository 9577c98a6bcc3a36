"""SimHash near-duplicates linked through BK-trees.

Fingerprints are computed on whole texts in one map pass.  Equal fingerprints
collapse before anything is linked, so exact copies cost one row per task.
Two fingerprints within radius r agree on one of r + 1 bands of bits
(pigeonhole), so every band value is a shard with its own BK-tree: children
keyed by the integer Hamming distance to their parent, and a query follows
only the edges within the radius.  The trees grow with the corpus, so none is
broadcast: a shard's tree meets the fingerprints routed to it in one task.
A shard above `SPLIT` members is divided by narrower bands before it is routed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._bytes import U64, lower_ascii, slices, utf8
from inkstrata.llm._graph import components
from inkstrata.llm._spark import given, staged, table, texts, width

# The primes of the public XXH64 specification.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
RADIUS = 2
SHINGLE = 3
SPLIT = 4096
#: A component meets its smallest doc_id in so many parts.
PARTS = 32
BUCKET_ROWS = 200_000
SLICE = 1 << 20


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans of `data` at once."""
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded.data, strides=(1,))
    s = seed & (2**64 - 1)
    h = np.full(len(starts), U64((s + int(P5)) & (2**64 - 1)))
    at, left = starts.astype(np.int64), lengths.astype(np.int64)
    long = np.flatnonzero(left >= 32)
    if len(long):
        at, left = at.copy(), left.copy()
        v = [np.full(len(long), U64((s + add) & (2**64 - 1))) for add in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        live = np.arange(len(long))
        while len(live):
            who = long[live]
            for k in range(4):
                v[k][live] = _round(v[k][live], eight[at[who] + 8 * k])
            at[who] += 32
            left[who] -= 32
            live = live[left[who] >= 32]
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            acc = (acc ^ _round(U64(0), v[k])) * P1 + P4
        h[long] = acc
    h += lengths.astype(U64)
    eights = left >> 3
    for k in range(3):
        who = np.flatnonzero(eights > k)
        if len(who):
            h[who] = _rotl(h[who] ^ _round(U64(0), eight[at[who] + 8 * k]), 27) * P1 + P4
    at = at + 8 * eights
    left = left & 7
    who = np.flatnonzero(left >= 4)
    if len(who):
        h[who] = _rotl(h[who] ^ (four[at[who]].astype(U64) * P1), 23) * P2 + P3
        at[who] += 4
        left[who] -= 4
    for k in range(3):
        who = np.flatnonzero(left > k)
        if len(who):
            h[who] = _rotl(h[who] ^ (padded[at[who] + k].astype(U64) * P5), 11) * P1
    h ^= h >> U64(33)
    h *= P2
    h ^= h >> U64(29)
    h *= P3
    h ^= h >> U64(32)
    return h


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document joined by one space: bytes, word starts, word ends, words per document."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    word_before = np.zeros(len(data), bool)
    word_before[1:] = ~blank[:-1]
    word_before[first] = False
    keep = ~blank | word_before
    text = np.where(blank, np.uint8(32), data)[keep]
    new = np.concatenate([[0], np.cumsum(keep)])[offsets]
    solid = text != 32
    prior = np.zeros(len(text), bool)
    prior[1:] = solid[:-1]
    head = np.zeros(len(text) + 1, bool)
    head[new] = True
    starts = np.flatnonzero(solid & (~prior | head[:-1]))
    after = np.zeros(len(text), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | head[1:])) + 1
    count = np.diff(np.searchsorted(starts, new))
    return text, starts, ends, count


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit SimHash per document."""
    text, starts, ends, words = spaced(lower_ascii(data), offsets)
    out = np.zeros(len(words), U64)
    has = np.flatnonzero(words > 0)
    if not len(has):
        return out
    n = np.maximum(words[has] - size + 1, 1)
    base = (np.cumsum(words) - words)[has]
    of = np.cumsum(n) - n
    first = np.arange(int(n.sum())) - np.repeat(of - base, n)
    last = first + np.repeat(np.minimum(words[has], size) - 1, n)
    h = xxh64(text, starts[first], ends[last] - starts[first])
    # byte lanes count one bit each for up to 255 shingles, then lanes are widened
    blocks = (n + 254) // 255
    block_of = np.cumsum(blocks) - blocks
    where = np.repeat(of - 255 * block_of, blocks) + 255 * np.arange(int(blocks.sum()))
    lanes = U64(0x0101010101010101)
    ones = np.empty((len(has), 64), np.int64)
    for k in range(8):
        part = np.add.reduceat((h >> U64(k)) & lanes, where).astype("<u8")
        ones[:, k::8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), block_of, axis=0)
    out[has] = ((2 * ones > n[:, None]).astype(U64) << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
    return out


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        parts = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE)]
        fp = np.concatenate(parts) if parts else np.zeros(0, U64)
        yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def bands(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands that cover the bits."""
    cut = [bits * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []

    def link(self, x: int, radius: int) -> list[int]:
        """Nodes within the radius of x; then x becomes a node."""
        value, kids, found = self.value, self.kids, []
        me, stack, home = len(value), [0] if value else [], -1
        while stack:
            node = stack.pop()
            d = (x ^ value[node]).bit_count()
            if d <= radius:
                found.append(node)
            edges = kids[node]
            for e, child in edges.items():
                if d - radius <= e <= d + radius:
                    stack.append(child)
        node = 0
        while value:  # the insertion path
            d = (x ^ value[node]).bit_count()
            home = kids[node].get(d, -1)
            if home < 0:
                kids[node][d] = me
                break
            node = home
        value.append(x)
        kids.append({})
        return found


def _forest(fps: list[int], reps: list[int], radius: int, out: dict[int, int]) -> None:
    """Unite the members of one shard in `out`, a union-find that keeps the smallest rep."""

    def root(x: int) -> int:
        while out.setdefault(x, x) != x:
            out[x] = out[out[x]]
            x = out[x]
        return x

    tree = BKTree()
    for i, x in enumerate(fps):
        for j in tree.link(x, radius):
            a, b = root(reps[i]), root(reps[j])
            if a != b:
                out[max(a, b)] = min(a, b)


def _shards(radius: int):
    def run(group: pa.Table) -> pa.Table:
        band, key = group["band"].to_numpy(), group["key"].to_numpy()
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        fps, reps = group["fp"].to_numpy()[order].view(U64), group["rep"].to_numpy()[order]
        new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])]))
        to: dict[int, int] = {}
        for a, b in zip(new, np.append(new[1:], len(key)), strict=True):
            if b - a > 1:
                _forest(fps[a:b].tolist(), reps[a:b].tolist(), radius, to)
        a, b = [], []
        for x in list(to):
            top = x
            while to[top] != top:
                top = to[top]
            if top != x:
                a.append(x)
                b.append(top)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def route(rows: DataFrame, count: int, *keep: str) -> DataFrame:
    """Each fingerprint once per band of count + 1: fp, rep, kept columns, band and the band's bits as key."""
    cuts = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", shift).bitwiseAND((1 << wide) - 1).alias("key")) for k, (shift, wide) in enumerate(bands(count))])
    return rows.withColumn("cut", F.explode(cuts)).select("fp", "rep", *keep, "cut.band", "cut.key")


def shards(reps: DataFrame, radius: int, split: int = SPLIT) -> DataFrame:
    """fp, rep, band, key: every pair within the radius shares a (band, key).

    A shard above `split` members is routed again by twice as many bands, of
    which those that differ inside it count; a pair differs in at most `radius`
    of them, so with more than that one agrees.  A shard that differs in fewer
    bands stays whole: it has few bits to differ in.
    """
    routed = route(reps, radius).withColumn("shard", F.xxhash64("band", "key"))
    big = staged(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("shard"), "big-shards")
    if not big.head(1):
        return routed.drop("shard")
    inner = route(routed.join(big, "shard", "left_semi"), 2 * radius + 1, "shard")
    varied = inner.groupBy("shard", "band").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("shard", "band")
    varied = staged(varied.join(varied.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > radius), "shard").select("shard", "band"), "varied-bands")
    divided = inner.join(varied, ["shard", "band"], "left_semi").select("fp", "rep", (F.col("band") + 1000).alias("band"), F.xxhash64("shard", "band", "key").alias("key"))
    return routed.join(varied.select("shard").distinct(), "shard", "left_anti").select("fp", "rep", "band", "key").unionByName(divided)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null or blank texts have fingerprint zero and link like any other.  A row
    per input row; rows that repeat a doc_id repeat in the result.  A null
    doc_id counts as larger than any other.  Fingerprints are linked, not ids:
    sharing an id, or having none, joins nothing.  Extra columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = staged(texts(docs, ids=True).mapInArrow(_map, "doc_id long, fp long"), "simhash")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    routed = shards(reps.select("fp", F.col("fp").alias("rep")), radius, split)
    buckets = max(width(spark), -(-marked.count() * (radius + 1) // BUCKET_ROWS))  # more rows make more buckets, not larger ones
    routed = routed.withColumn("bucket", F.pmod(F.xxhash64("band", "key"), F.lit(buckets)))
    edges = routed.groupBy("bucket").applyInArrow(_shards(radius), "a long, b long")
    linked = staged(reps.join(components(edges, "simhash"), F.col("fp") == F.col("node"), "left").select("fp", "rep", "root"), "simhash-linked")
    of, alone, part = F.col("fp").alias("of"), F.col("root").isNull(), F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")
    first = linked.where(~alone).groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    grouped = linked.where(~alone).withColumn("part", part).join(first, ["root", "part"]).select(of, "component_id")
    known = grouped.unionByName(linked.where(alone).select(of, F.col("rep").alias("component_id")))
    return marked.join(known, F.col("fp") == F.col("of")).select(given("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), given("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
