"""Exact substring removal: every byte inside a 400-byte string that starts twice.

1. Each window of `LENGTH` bytes has an anchor, its smallest 32-byte gram
   (leftmost of equals), which depends on the window's bytes alone.  Windows
   that follow each other with one anchor make a segment; equal windows lie in
   segments of equal anchors, so anchors divide the work.
2. Segments meet by anchor as hashes.  Anchors met once are done.  Copies of a
   segment collapse to one with a multiplicity before any text moves.
3. The distinct contents of an anchor meet as text; one suffix array per shard
   of anchors, built by linear grouping over content-defined pieces, brings
   equal strings together, and their common prefixes decide each window.

Pieces start where the hash of eight bytes is smallest among the next
`AHEAD` places, so piece borders follow from the bytes ahead; a piece is named
by its bytes and that look-ahead, which keeps the order of pieces the order of
bytes.  A window is judged at the first border inside it: equal bytes before
the border, common prefix after it.  Nothing here compares all pairs.

An anchor that more than `HOT` segments have (a line in a third of all texts)
would make one shard too large for a task: its distinct contents are spread as
windows by their own hashes and counted with a map-side sum instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._bytes import GOLDEN, U64, byte_table, gram_hashes, mix, powers, slices, utf8
from inkstrata.llm._spark import given, staged, table, texts, width
from inkstrata.llm.suffix_array import suffix_array

LENGTH = 400
GRAM = 32
AHEAD = 32
LOOK = AHEAD + 8 - 1
LONGEST = 240
SLICE = 1 << 20
SHARD_BYTES = 3 << 20
HOT = 20_000
BUCKET_ROWS = 200_000
BASE = 0x2545F4914F6CDD1D


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first and last window start of each segment (positions in data)."""
    n, w = len(data), LENGTH - GRAM + 1
    starts = np.flatnonzero(np.arange(n) + LENGTH <= np.repeat(offsets[1:], np.diff(offsets)))
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64), starts, starts
    h = gram_hashes(data)
    key = (h & ~U64(2**24 - 1)) | np.arange(n, dtype=U64) if n < 2**24 else None
    if key is None:  # one document of 16 MB or more: rank its grams so that place breaks ties
        key = (np.unique(h, return_inverse=True)[1].astype(U64) << U64(32)) | np.arange(n, dtype=U64)
    low = U64(2**24 - 1) if n < 2**24 else U64(2**32 - 1)
    grid = np.full((n + w - 1) // w * w + w, U64(2**64 - 1))
    grid[:n] = key
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(back[starts], ahead[starts + w - 1]) & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(starts) != 1)]))
    first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
    total = np.zeros(n + 1, U64)
    np.cumsum(h * powers(BASE, n), out=total[1:])
    content = mix((total[last + w] - total[first]) * powers(pow(BASE, -1, 2**64), n)[first] + (last - first).astype(U64))
    return h[chosen[cut]], content, first, last


ROWS = "what int, anchor long, content long, doc_id long, rid long, first int, last int, many int"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64()}


def _batch(**cols: np.ndarray) -> pa.RecordBatch:
    kinds = dict(x.split() for x in ROWS.split(", "))
    return pa.record_batch([pa.array(np.asarray(cols[n]).astype({"int": np.int32, "long": np.int64}[kinds[n]], copy=False)) for n in NAMES], NAMES)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """what 0: a segment to be judged; 1: windows first..last are repeated (copies inside this batch)."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, rids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, SLICE):
            own = offsets[a : b + 1] - offsets[a]
            anchor, content, first, last = segments(data[offsets[a] : offsets[b]], own)
            if not len(first):
                continue
            doc = np.searchsorted(own, first, side="right") - 1
            first, last = first - own[doc], last - own[doc]
            _, lead, at, count = np.unique(anchor ^ mix(content), return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[at] > 1)
            yield _batch(what=np.zeros(len(lead)), anchor=anchor[lead].view(np.int64), content=content[lead].view(np.int64), doc_id=ids[a + doc[lead]], rid=rids[a + doc[lead]], first=first[lead], last=last[lead], many=count > 1)
            if len(again):
                zero = np.zeros(len(again))
                yield _batch(what=zero + 1, anchor=rids[a + doc[again]], content=zero, doc_id=ids[a + doc[again]], rid=rids[a + doc[again]], first=first[again], last=last[again], many=zero)


def _meet(rows: pa.Table) -> pa.Table:
    """what 1: repeated windows; 2: one segment of each distinct content of an anchor that has several."""
    cols = {n: rows[n].to_numpy() for n in NAMES}
    done = cols["what"] == 1
    ask = {n: v[~done] for n, v in cols.items()}
    order = np.lexsort((ask["rid"], ask["doc_id"], ask["content"], ask["anchor"]))
    ask = {n: v[order] for n, v in ask.items()}
    if not len(order):
        return rows.filter(pa.array(done)).select(NAMES)
    new_anchor = np.concatenate([[True], ask["anchor"][1:] != ask["anchor"][:-1]])
    new = new_anchor | np.concatenate([[True], ask["content"][1:] != ask["content"][:-1]])
    which = np.cumsum(new) - 1
    copies = np.bincount(which) + np.bincount(which, weights=ask["many"]).astype(int)
    repeated = copies[which] > 1
    group = np.cumsum(new_anchor) - 1
    several = np.bincount(group, weights=new)[group] > 1
    parts = [{n: v[done] for n, v in cols.items()}]
    hit = {n: v[repeated] for n, v in ask.items()}
    hit["what"] = np.ones(len(hit["rid"]))
    keep = {n: v[new & several] for n, v in ask.items()}
    keep["what"] = np.full(len(keep["rid"]), 2)
    keep["many"] = repeated[new & several]
    return pa.Table.from_batches([_batch(**p) for p in (*parts, hit, keep)])


CUT = "anchor long, doc_id long, rid long, first int, many int, content binary, window long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted segments of each document, once for rows that repeat: what 2 by content, what 0 (hot anchors) as one hash per window."""
    names = [x.split()[0] for x in CUT.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    w = LENGTH - GRAM + 1
    done: set[tuple[int, int]] = set()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        out: list[tuple] = []
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for i, wanted in enumerate(batch.column(3).to_pylist()):
            if rows[i] in done:  # a repeated row has the same contents
                continue
            done.add(rows[i])
            body, doc_id, rid = data[offsets[i] : offsets[i + 1]], batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for s in wanted:
                part = body[s["first"] : s["last"] + LENGTH]
                if s["what"] == 2:
                    out.append((s["anchor"], doc_id, rid, s["first"], s["many"], part.tobytes(), None))
                    continue
                start = np.arange(s["last"] - s["first"] + 1)
                total = np.zeros(len(part) + 1, U64)
                np.cumsum(gram_hashes(part) * powers(BASE, len(part)), out=total[1:])
                seen = mix((total[start + w] - total[start]) * powers(pow(BASE, -1, 2**64), len(start)))
                same = [pa.array(np.full(len(start), v)).cast(t) for v, t in ((s["anchor"], types[0]), (doc_id, types[1]), (rid, types[2]))]
                yield pa.record_batch([*same, pa.array(s["first"] + start).cast(types[3]), pa.array(np.full(len(start), s["many"])).cast(types[4]), pa.nulls(len(start), types[5]), pa.array(seen.view(np.int64))], names)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def borders(cat: np.ndarray) -> np.ndarray:
    """Places whose hash of eight bytes is smallest among the next AHEAD places."""
    h = byte_table(7)[cat]
    for step in (1, 2, 4):
        h[:-step] = mix(h[:-step] * GOLDEN + h[step:])
    low = h.copy()
    for step in (1, 2, 4, 8, 16):
        low[:-step] = np.minimum(low[:-step], low[step:])
    return h == low


def repeated_windows(contents: list[bytes], anchors: np.ndarray) -> list[np.ndarray]:
    """For each content the flags of its window starts: does the window start anywhere else too?

    contents: distinct within an anchor, each at least LENGTH bytes; equal
    windows must lie in contents of equal anchors.
    """
    size = np.array([len(c) for c in contents])
    pad = bytes(LOOK + 9)
    start = np.cumsum(size + len(pad)) - size - len(pad)
    cat = np.frombuffer(pad.join(contents) + pad, np.uint8).copy()
    real = np.zeros(len(cat), bool)
    for a, n in zip(start, size, strict=True):
        real[a : a + n] = True
    cat[real] += 1  # UTF-8 has no 0xFF: zero marks ends only
    owner = np.repeat(np.arange(len(contents)), size + len(pad))
    mark = borders(cat) & real

    def gaps(at: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], owner[at][1:] != owner[at][:-1]])
        return np.where(first, at - start[owner[at]] + 1, np.diff(at, prepend=0))

    at = np.flatnonzero(mark)
    far = owner[at][gaps(at) > LONGEST]
    bare = np.setdiff1d(np.arange(len(contents)), owner[at[at - start[owner[at]] <= LONGEST]])
    dense = np.isin(anchors, anchors[np.union1d(far, bare)])  # no border for too long: every byte of that anchor is one
    if dense.any():
        mark = real & (mark | dense[owner])
        at = np.flatnonzero(mark)
    gap, own = gaps(at), owner[at]
    piece = np.minimum(np.append(at[1:], len(cat)), start[own] + size[own]) - at
    span = np.minimum(piece, LONGEST) + LOOK
    wide = int(span.max())
    padded = np.concatenate([cat, np.zeros(wide, np.uint8)])
    names = np.empty(len(at), np.int64)
    text = np.empty((len(at),), f"S{wide}")
    for lo in range(0, len(at), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        grid = padded[at[part, None] + np.arange(wide)]
        grid[np.arange(wide) >= span[part, None]] = 0
        text[part] = np.ascontiguousarray(grid).view(f"S{wide}").ravel()
    names = np.unique(text, return_inverse=True)[1]
    del text
    last = np.append(own[1:] != own[:-1], True)
    symbols = np.insert(names + len(contents), np.flatnonzero(last) + 1, np.arange(len(contents)))
    back = np.insert(np.arange(len(at)), np.flatnonzero(last) + 1, -1)
    order = back[suffix_array(symbols)]
    order = order[order >= 0]
    pos = at[order]
    left = start[own[order]] + size[own[order]] - pos
    common = np.zeros(len(order), np.int64)  # with the suffix before
    most = np.minimum(np.minimum(left[1:], left[:-1]), LENGTH)
    live = np.arange(1, len(order))
    done = 0
    tail = np.concatenate([cat, np.zeros(64, np.uint8)])
    while len(live) and done < LENGTH:
        same = np.ndarray((len(tail) - 7,), "<u8", tail.data, strides=(1,))
        differ = same[pos[live] + done] != same[pos[live - 1] + done]
        stop = live[differ]
        if len(stop):
            eight = np.arange(8)
            ne = tail[pos[stop, None] + done + eight] != tail[pos[stop - 1][:, None] + done + eight]
            common[stop] = done + ne.argmax(axis=1)
        live = live[~differ]
        done += 8
        common[live] = done
    common[1:] = np.minimum(common[1:], most)
    out = np.zeros(len(cat), bool)
    before = gap[order]
    both = np.maximum(common, np.append(common[1:], 0))
    some = np.flatnonzero(both >= LENGTH - int(before.max()) + 1)  # no other suffix decides a window
    link = np.where(np.diff(some, prepend=-2) == 1, common[some], 0)
    pos, room, before, both = pos[some], left[some], before[some], both[some]
    live = np.arange(len(some))
    hashes = np.zeros(len(some), U64)
    tables = byte_table(9)
    for d in range(int(before.max()) if len(some) else 0):
        live = live[before[live] > d]
        if d:
            hashes[live] = mix(hashes[live] * GOLDEN + tables[padded[pos[live] - d]])
        who = live[(room[live] + d >= LENGTH) & (both[live] >= LENGTH - d)]
        if len(who) < 2:
            continue
        part = np.cumsum(link < LENGTH - d)[who].astype(U64)
        key = mix(part * GOLDEN) ^ hashes[who]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[pos[who[count[which] > 1]] - d] = True
    return [out[a : a + n - LENGTH + 1] for a, n in zip(start, size, strict=True)]


RANGES = "doc_id long, rid long, first int, last int"


def _array(rows: pa.Table) -> pa.Table:
    """Repeated windows of the contents of one shard that are not repeated as a whole."""
    rows = rows.sort_by([("anchor", "ascending"), ("doc_id", "ascending"), ("rid", "ascending"), ("first", "ascending")])
    flags = repeated_windows(rows["content"].to_pylist(), rows["anchor"].to_numpy())
    out = []
    for flag, many, doc, rid, first in zip(flags, rows["many"].to_pylist(), rows["doc_id"].to_pylist(), rows["rid"].to_pylist(), rows["first"].to_pylist(), strict=True):
        if not many and flag.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
            out += [(doc, rid, first + int(a), first + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "rid", "first", "last"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})


def _spread(windows: DataFrame) -> DataFrame:
    """Ranges of the repeated windows of hot anchors, counted by their own hashes."""
    again = windows.groupBy("anchor", "window").agg(F.sum(F.col("many") + 1).alias("n")).where("n > 1").select("anchor", "window")
    return windows.join(again, ["anchor", "window"], "left_semi").select("doc_id", "rid", "first", F.col("first").alias("last"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        n, removed, spans, kept = np.diff(offsets), [], [], []
        for i, found in enumerate(batch.column(2)):
            body = data[offsets[i] : offsets[i + 1]]
            if not found.is_valid or not len(found.values):
                removed.append(0)
                spans.append([])
                kept.append(body.tobytes())
                continue
            first, last = found.values.field("first").to_numpy(), found.values.field("last").to_numpy()
            cover = np.zeros(len(body) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, last + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist())
            kept.append(body[~gone].tobytes())
        yield pa.record_batch([batch.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end, ... of removed bytes) and kept (bytes) per row.

    Null texts are empty; texts under LENGTH bytes keep all.  Repeated rows
    are copies of each other.  A null doc_id stays null.  Other columns are ignored.  Hashes that stand
    for content have 128 bits with their anchor.
    """
    spark = docs.sparkSession
    own = texts(docs, ids=True).withColumn("rid", F.xxhash64("doc_id", "text"))
    asked = staged(own.select("doc_id", "rid", "text").mapInArrow(_ask, ROWS), "anchors")
    often = staged(asked.where("what = 0").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"), "hot-anchors")
    any_hot = bool(often.head(1))
    usual = asked.join(often, "anchor", "left_anti").select(*NAMES) if any_hot else asked
    buckets = max(width(spark), -(-usual.count() // BUCKET_ROWS))  # more rows make more buckets, not larger ones
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets))
    met = staged(usual.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_meet, ROWS), "segments")
    open_ = met.where("what = 2")
    size = open_.agg(F.sum(F.col("last") - F.col("first") + LENGTH)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    if any_hot:
        crowd = asked.where("what = 0").join(often, "anchor", "left_semi")
        # equal contents collapse, map-side first, before any window is spread
        once = crowd.groupBy("anchor", "content").agg(F.sum(F.col("many") + 1).alias("n"), F.min(F.struct("doc_id", "rid", "first", "last")).alias("one"))
        once = staged(once, "hot-contents")
        open_ = open_.unionByName(once.select(F.lit(0).alias("what"), "anchor", "content", "one.*", (F.col("n") > 1).cast("int").alias("many")).select(*NAMES))
    wanted = open_.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("what", "anchor", "first", "last", "many")).alias("wanted"))
    cut = own.join(wanted.hint("shuffle_hash"), ["doc_id", "rid"]).select("doc_id", "rid", "text", "wanted").mapInArrow(_cut, CUT)
    cut = staged(cut, "cut") if any_hot else cut
    texts_ = cut.where("content is not null").drop("window").withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(shards)))
    found = texts_.groupBy("shard").applyInArrow(_array, RANGES)
    ranges = met.where("what = 1").select("doc_id", "rid", "first", "last").unionByName(found)
    if any_hot:
        copies = crowd.join(once.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("doc_id", "rid", "first", "last")
        ranges = ranges.unionByName(copies).unionByName(_spread(cut.where("content is null")))
    ranges = staged(ranges, "ranges")
    # rows that repeat give the same ranges, which count once, or each would get the ranges of all
    per_doc = ranges.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    return own.join(per_doc.hint("shuffle_hash"), ["doc_id", "rid"], "left").select(given("doc_id"), "text", "found").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
