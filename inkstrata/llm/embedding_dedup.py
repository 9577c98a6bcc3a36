"""Embedding near-duplicates by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions; each projection, shifted
and cut into steps of `STEP`, gives an integer, and `HASHES` of them name a
bucket of one of `TABLES` tables.  For a cosine of 0.98 (distance 0.2) a pair
shares a bucket of some table with probability 0.994; expected recall over
closer pairs is higher (measured in the tests).  Exact copies collapse first.
Buckets of one vector are dropped before vectors are moved; a bucket above
`CHUNK` vectors is divided over pairs of its chunks.  A pair is counted only
in the first table in which it meets, so no list of pairs is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._bytes import GOLDEN, U64, mix
from inkstrata.llm._graph import components
from inkstrata.llm._spark import NO_ID, given, staged, table, width

COSINE = 0.98
STEP = 1.6
HASHES = 14
TABLES = 20
CHUNK = 4096
BATCH = 4096
#: Rows of a chunk compared at once, and vectors that meet in one group.
STRIP = 256
BUCKET_ROWS = 32_768

_PLANES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def codes(units: np.ndarray) -> np.ndarray:
    """Bucket codes (rows, TABLES) of unit vectors."""
    dim = units.shape[1]
    if dim not in _PLANES:
        rng = np.random.default_rng(dim)
        _PLANES[dim] = rng.normal(size=(TABLES * HASHES, dim)), rng.uniform(0, STEP, TABLES * HASHES)
    planes, shift = _PLANES[dim]
    cells = np.floor((units @ planes.T + shift) / STEP).astype(np.int64).view(U64).reshape(len(units), TABLES, HASHES)
    h = np.zeros((len(units), TABLES), U64)
    for k in range(HASHES):
        h = mix(h + cells[:, :, k] + U64((k + 1) * int(GOLDEN) & (2**64 - 1)))
    return h


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, then key (128 bits of label and vector), label, vector bytes: null where it cannot link."""
    for batch in batches:
        keys, vectors = [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.zeros(0)
            if label is not None and v.is_valid and v.values is not None and not v.values.null_count:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), "<f8")
            top = np.abs(x).max() if len(x) else 0.0
            good = len(x) and np.isfinite(x).all() and top > 0
            if good:
                x = x / top + 0.0  # the direction alone counts; squares neither overflow nor vanish
            vectors.append(x.tobytes() if good else None)
            keys.append(hashlib.blake2b(f"{label}:".encode() + vectors[-1], digest_size=16).digest() if good else None)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "key", "vector"])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and the codes of its vector mixed with its label."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            raw, labels = part.column(2).to_pylist(), np.array(part.column(1).to_pylist(), np.int64)
            out: list[bytes | None] = [None] * len(raw)
            for size in {len(r) for r in raw}:
                who = [i for i, r in enumerate(raw) if len(r) == size]
                h = mix(codes(units([raw[i] for i in who])) ^ mix(labels[who].view(U64) * GOLDEN + U64(size))[:, None])
                for i, row in zip(who, h, strict=True):
                    out[i] = row.view(np.int64).tolist()
            yield pa.record_batch([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["rep", "codes"])


def _linked(cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Links and spanning edges among the vectors of each bucket (or pair of its chunks)."""

    def run(group: pa.Table) -> pa.Table:
        cols = {c: group[c].to_numpy() for c in ("t", "code", "i", "j", "own", "rep", "w")}
        vectors = group["vector"].combine_chunks() if group.num_rows else group["vector"]
        order = np.lexsort((cols["rep"], cols["j"], cols["i"], cols["code"], cols["t"]))
        cols = {c: v[order] for c, v in cols.items()}
        key = np.stack([cols[c] for c in ("t", "code", "i", "j")])
        new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        reps, links, a, b = [], [], [], []
        for lo, hi in zip(new, np.append(new[1:], len(order)), strict=True):
            raw = vectors.take(pa.array(order[lo:hi])).to_pylist()
            if hi - lo < 2 or len({len(r) for r in raw}) > 1:  # sizes are part of the code, so the latter is a hash collision
                continue
            t, rep, w, own = cols["t"][lo], cols["rep"][lo:hi], cols["w"][lo:hi], cols["own"][lo:hi]
            x = units(raw)
            left = np.flatnonzero(own == cols["i"][lo])
            right = np.flatnonzero(own == cols["j"][lo])
            same = cols["i"][lo] == cols["j"][lo]
            near = np.empty((len(left), len(right)), bool)
            h = codes(x) if t else None
            strips = [slice(k, k + STRIP) for k in range(0, len(left), STRIP)]
            for k in strips:
                near[k] = x[left[k]] @ x[right].T >= cosine
                for s in range(t):
                    near[k] &= h[left[k], s][:, None] != h[right, s][None, :]
            if same:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            n = np.concatenate([near[k] @ w[right] for k in strips])
            reps.append(rep[left[n > 0]])
            links.append(n[n > 0])
            if not same:
                n = sum(w[left[k]] @ near[k] for k in strips)
                reps.append(rep[right[n > 0]])
                links.append(n[n > 0])
            top_l, top_r, none = rep[left].copy(), rep[right].copy(), np.iinfo(np.int64).max
            while True:
                new_l = np.minimum(top_l, np.concatenate([np.where(near[k], top_r[None, :], none).min(axis=1) for k in strips]))
                new_r = np.minimum(top_r, np.min([np.where(near[k], new_l[k, None], none).min(axis=0) for k in strips], axis=0))
                if (new_l == top_l).all() and (new_r == top_r).all():
                    break
                top_l, top_r = new_l, new_r
            for at, top in ((left, top_l), (right, top_r)):
                moved = rep[at] != top
                a.append(rep[at][moved])
                b.append(top[moved])
        zero = [np.zeros(0, np.int64)]
        reps, links, a, b = (np.concatenate(v or zero).astype(np.int64) for v in (reps, links, a, b))
        pad = np.zeros(len(a), np.int64)
        return pa.table({"rep": np.concatenate([reps, a]), "links": np.concatenate([links, pad]), "root": np.concatenate([reps, b])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) for every row.

    Rows link only within one label that is not null.  Vectors that are null,
    empty, zero or hold null or non-finite numbers link with nothing, as do
    vectors of different length.  n_links counts copies too.  vec_id is taken
    as unique; rows that repeat one count as copies of each other, and a null one
    as larger than any other.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("embedding"))
    rows = staged(own.mapInArrow(_usable, "vec_id long, label long, key binary, vector binary"), "vectors")
    good = rows.where("key is not null")
    reps = staged(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("label").alias("label"), F.first("vector").alias("vector")), "distinct-vectors")
    marked = reps.select("rep", "label", "vector").mapInArrow(_bucketed, "rep long, codes array<long>")
    flat = staged(marked.select("rep", F.posexplode("codes").alias("t", "code")), "buckets")
    many = staged(flat.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-buckets")
    moved = many.agg(F.sum(F.col("n") * F.ceil(F.col("n") / chunk))).first()[0] or 0
    groups = max(4 * width(spark), -(-moved // BUCKET_ROWS))  # more vectors make more groups, not larger ones
    parts = F.ceil(F.col("n") / chunk).cast("int")
    met = flat.join(many, ["t", "code"]).select("t", "code", "rep", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("own"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("t", "code", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = met.join(reps.select("rep", "w", "vector"), "rep").withColumn("bucket", F.pmod(F.xxhash64("t", "code", "i", "j"), F.lit(groups)))
    found = staged(full.groupBy("bucket").applyInArrow(_linked(cosine), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors").withColumnRenamed("node", "rep")
    known = reps.join(links, "rep", "left").join(roots, "rep", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return out.select(given("vec_id"), "n_links", given("component_id"), "kept")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
