"""Katz backoff language model over words: Good-Turing counts, exact backoff weights.

Documents are dealt into chunks of bounded bytes.  A chunk asks, once for each
of its distinct words and word pairs, for their corpus counts: sorted 64-bit
keys go to range partitions, the range adds up all chunks and answers in the
order of the question, so an answer is one small number per key.  One chunk
that trained on a pair is made its owner; owners add up, per context, the
discounted mass and the lower-order mass that make the backoff weights exact.
The counts and the weights are staged tables (by order and key range, and by
context); a token is scored by its pair where that was seen and else, one
order down, by its word times the weight of its context.

Probabilities.  Pair: (c - D(c)) / c(h).  Unseen pair of a known context h:
alpha(h) P(w), alpha(h) = sum of D(c(h, .)) / c(h) / (1 - sum of P(w) over the
followers of h).  Word: (c - D(c)) / N; the mass taken away is the one unknown
type's.  D is Katz's Good-Turing discount up to K and constant above, so each
context keeps some mass.  Every distribution over the V + 1 types sums to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._bytes import GOLDEN, U64, lower_ascii, mix, runs, span_hashes, utf8
from inkstrata.llm._spark import NO_ID, given, staged, table, texts

CHUNK_BYTES = 5 << 20
K = 5
FOLDS, HELD = 7, 2

END_KEY = U64(0x8E5D3C1B2A190807)
START_KEY = U64(0x1F2E3D4C5B6A7988)


def planes(x: np.ndarray) -> bytes:
    """Little-endian byte planes: what is constant across a plane compresses away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(b, np.uint8)
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(dtype).ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts in the fewest of 1, 2, 4 or 8 bytes that hold the largest, said by the first byte; none wraps."""
    top = int(x.max()) if len(x) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    return bytes([size]) + planes(x.astype(f"<u{size}"))


def unpack_counts(b: bytes) -> np.ndarray:
    return unplanes(b[1:], f"<u{b[0]}").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, "<u8"))


def _dealt(chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents as compressed blocks, one per chunk and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # id and text: many rows without an id, or with the same one, are dealt like others
            ids, said = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for k in (0, 3))
            chunk = (mix(mix(ids * GOLDEN) + said) % U64(chunks)).astype(np.int64)
            rows = []
            for c in np.unique(chunk):
                part = batch.filter(pa.array(chunk == c))
                data, offsets = utf8(part.column(1))
                body = pa.compress(pa.py_buffer(data.tobytes()), "zstd", asbytes=True)
                rows.append((int(c), part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.diff(offsets).astype("<i8").tobytes(), part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), len(data), body))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch(
                [pa.array(cols[0], pa.int32()), *[pa.array(cols[k], pa.binary()) for k in (1, 2, 3)], pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary())], ["chunk", "ids", "sizes", "train", "bytes", "body"]
            )

    return run


DEALT = "chunk int, ids binary, sizes binary, train binary, bytes long, body binary"


class Chunk:
    """The tokens of one chunk with its distinct words and word pairs."""

    def __init__(self, rows: pa.Table) -> None:
        ids, train, sizes, words, doc = [], [], [], [], []
        at = 0
        for r in rows.to_pylist():
            data = np.frombuffer(pa.decompress(r["body"], r["bytes"], "zstd", asbytes=True), np.uint8) if r["bytes"] else np.zeros(0, np.uint8)
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], "<i8"))])
            low = lower_ascii(data)
            starts, ends, own = runs(~((low == 32) | ((low >= 9) & (low <= 13))), offsets)
            words.append(span_hashes(low, starts, ends, 5))
            doc.append(own + at)
            at += len(offsets) - 1
            ids.append(np.frombuffer(r["ids"], "<i8"))
            train.append(np.frombuffer(r["train"], np.uint8).astype(bool))
            sizes.append(np.bincount(own, minlength=len(offsets) - 1) + 1)
        self.ids, self.train, self.size = np.concatenate(ids), np.concatenate(train), np.concatenate(sizes)
        doc = np.concatenate(doc)
        last = np.cumsum(self.size) - 1
        self.first = last - self.size + 1
        tokens = np.full(int(self.size.sum()), END_KEY)
        tokens[np.arange(len(doc)) + doc] = np.concatenate(words)
        self.doc = np.repeat(np.arange(at), self.size)
        self.context = np.empty_like(tokens)
        self.context[1:] = tokens[:-1]
        self.context[self.first] = START_KEY
        pair = mix(mix(self.context * GOLDEN) + tokens)
        self.words, self.word_at = np.unique(tokens, return_inverse=True)
        self.pairs, self.pair_first, self.pair_at = np.unique(pair, return_index=True, return_inverse=True)
        del pair, doc, words, tokens
        taught = self.train[self.doc]
        self.asked = [
            (self.words, np.bincount(self.word_at[taught], minlength=len(self.words))),
            (self.pairs, np.bincount(self.pair_at[taught], minlength=len(self.pairs))),
        ]


def _ask(ranges: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        out = []
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], U64)
        for order, (keys, counts) in enumerate(Chunk(rows).asked, 1):
            cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            for r in np.flatnonzero(np.diff(cut)):
                a, b = cut[r], cut[r + 1]
                out.append((order, int(r), chunk, pack_keys(keys[a:b]), pack_counts(counts[a:b])))
        cols = list(zip(*out, strict=True))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("ord", "range", "chunk", "keys", "counts"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    return run


ASKED = "ord int, range int, chunk int, keys binary, counts binary"
ANSWER = "ord int, range int, chunk int, counts binary, owner binary, c long, n long"


def _answer(rows: pa.Table) -> pa.Table:
    """Corpus counts in the order of each question; with chunk null: how many keys have each count."""
    rows = rows.sort_by("chunk")
    order, range_ = rows["ord"][0].as_py(), rows["range"][0].as_py()
    parts = [unpack_keys(b) for b in rows["keys"].to_pylist()]
    own = np.concatenate([unpack_counts(b) for b in rows["counts"].to_pylist()])
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, own)  # whole numbers: a float sum would round above 2**53
    taught = np.flatnonzero(own > 0)
    first = np.full(len(keys), -1)
    first[at[taught[::-1]]] = taught[::-1]  # the lowest chunk that trained on it
    owner = np.zeros(len(own), np.uint8)
    owner[first[first >= 0]] = 1
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    out = [(order, range_, c, pack_counts(total[at[a:b]]), np.packbits(owner[a:b]).tobytes(), None, None) for c, a, b in zip(rows["chunk"].to_pylist(), cut, cut[1:], strict=False)]
    small = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    out += [(order, range_, None, None, None, c, int(small[c])) for c in range(1, K + 2)]
    out += [(order, range_, None, None, None, -1, int((total > 0).sum())), (order, range_, None, None, None, -2, int(total.sum()))]
    cols = list(zip(*out, strict=True))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(ANSWER.split(", "), cols, types, strict=True)})


def discounts(n: dict[int, int]) -> np.ndarray:
    """D(0..K + 1): what is taken from each count; the last entry holds above K.

    Katz: D(r) = r - r d(r), d(r) = (r*/r - A) / (1 - A), r* = (r + 1) n(r + 1) / n(r),
    A = (K + 1) n(K + 1) / n(1).  Where the counts of counts give no d in (0, 1),
    absolute discounting n(1) / (n(1) + 2 n(2)) (a half if undefined) stands in.
    """
    one, two = n.get(1, 0), n.get(2, 0)
    flat = one / (one + 2 * two) if one and two else 0.5
    out = np.full(K + 2, flat)
    out[0] = 0.0
    if one:
        a = (K + 1) * n.get(K + 1, 0) / one
        for r in range(1, K + 1):
            star = (r + 1) * n.get(r + 1, 0) / n[r] if n.get(r) else 0.0
            d = (star / r - a) / (1 - a) if a < 1 else 0.0
            if 0.0 < d < 1.0:
                out[r] = r - r * d
    out[K + 1] = out[K]
    return out


class Model:
    """The numbers every task needs: totals and discounts."""

    def __init__(self, stats: dict[tuple[int, int], int]) -> None:
        self.types, self.tokens = stats.get((1, -1), 0), stats.get((1, -2), 0)
        self.word = discounts({c: stats.get((1, c), 0) for c in range(1, K + 2)})
        self.pair = discounts({c: stats.get((2, c), 0) for c in range(1, K + 2)})
        few = {c: stats.get((1, c), 0) for c in range(1, K + 1)}
        lost = sum(k * self.word[c] for c, k in few.items()) + (self.types - sum(few.values())) * self.word[K + 1]
        self.unknown = lost / self.tokens if self.tokens else 1.0

    def word_p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.word[np.minimum(c, K + 1)]) / max(self.tokens, 1), self.unknown)


SCORED = "what int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, context long, k long, taken double, lower double, c long"


def _score(model: Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """what 0: documents; 1: contexts of unseen pairs by document; 2: contexts' masses from owned pairs."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        answers = answers.sort_by([("ord", "ascending"), ("range", "ascending")]).to_pylist()
        counts, owned = {}, []
        for order in (1, 2):
            mine = [a for a in answers if a["ord"] == order]
            parts = [unpack_counts(a["counts"]) for a in mine]
            counts[order] = np.concatenate(parts)
            if order == 2:
                owned = np.concatenate([np.unpackbits(np.frombuffer(a["owner"], np.uint8), count=len(p)) for a, p in zip(mine, parts, strict=True)]).astype(bool)
        cw = counts[1][chunk.word_at]
        n_end = counts[1][np.searchsorted(chunk.words, END_KEY)]
        ch = np.empty_like(cw)
        ch[1:] = cw[:-1]
        ch[chunk.first] = n_end  # as many starts as ends
        cb = counts[2][chunk.pair_at]
        seen = cb > 0
        lower = model.word_p(cw)
        p = np.where(seen, (cb - model.pair[np.minimum(cb, K + 1)]) / np.maximum(ch, 1), lower)
        docs = len(chunk.ids)

        def per_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(chunk.doc, weights=x, minlength=docs)

        base = per_doc(np.log10((cw + 1) / (model.tokens + model.types + 1)))
        score = per_doc(np.log10(p))
        row = (np.int64(rows["chunk"][0].as_py()) << 32) + np.arange(docs)
        missed = np.flatnonzero(~seen & (ch > 0))
        pairs, k = np.unique(np.stack([chunk.doc[missed].astype(np.int64), chunk.context[missed].view(np.int64)]), axis=1, return_counts=True) if len(missed) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        mine = chunk.pair_first[owned]
        context, at = np.unique(chunk.context[mine], return_inverse=True)
        taken = np.bincount(at, weights=model.pair[np.minimum(cb[mine], K + 1)], minlength=len(context))
        mass = np.bincount(at, weights=lower[mine], minlength=len(context))
        c = np.zeros(len(context), np.int64)
        c[at] = ch[mine]

        made = [
            {"row": row, "doc_id": chunk.ids, "held_out": ~chunk.train, "n_tokens": chunk.size, "n_known": per_doc(cw > 0), "base": base, "score": score},
            {"row": row[pairs[0]], "context": pairs[1], "k": k},
            {"context": context.view(np.int64), "taken": taken, "lower": mass, "c": c},
        ]
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        cols = {}
        for name, kind in (x.split() for x in SCORED.split(", ")):
            parts = []
            for what, part in enumerate(made):
                n = len(next(iter(part.values())))
                values = np.full(n, what) if name == "what" else part.get(name)
                parts.append(pa.nulls(n, kinds[kind]) if values is None else pa.array(values).cast(kinds[kind]))
            cols[name] = pa.chunked_array(parts)
        return pa.table(cols)

    return run


def score(docs: DataFrame, train, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    train: boolean column over doc_id of the documents to learn from.  A text
    is its words and one end token; null and blank texts are the end token
    alone.  Repeated rows count and are scored each; those equal in id and text
    share a chunk.  A null doc_id is held out.  Without training
    documents every token is unknown and each score is zero.
    """
    own = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = own.withColumn("said", F.xxhash64("text")).mapInArrow(_dealt(chunks), DEALT)
    asked = dealt.groupBy("chunk").applyInArrow(_ask(-(-chunks // 2)), ASKED)
    answers = staged(asked.groupBy("ord", "range").applyInArrow(_answer, ANSWER), "counts")
    stats = {(r["ord"], r["c"]): r["n"] for r in answers.where("chunk is null").groupBy("ord", "c").agg(F.sum("n").alias("n")).collect()}
    model = Model(stats)
    told = answers.where("chunk is not null").select("ord", "range", "chunk", "counts", "owner")
    scored = staged(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(model), SCORED), "scores")
    mass = scored.where("what = 2").groupBy("context").agg(F.sum("taken").alias("taken"), F.sum("lower").alias("lower"), F.max("c").alias("c"))
    weights = mass.select("context", F.log10(F.col("taken") / F.col("c") / (1 - F.col("lower"))).alias("alpha"))
    backed = scored.where("what = 1").join(weights, "context").groupBy("row").agg(F.sum(F.col("k") * F.col("alpha")).alias("more"))
    return scored.where("what = 0").join(backed, "row", "left").select(
        given("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
    )


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD)
