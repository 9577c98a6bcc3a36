"""UTF-8 byte views of Arrow text columns and vectorised rolling hashes.

All text operators of this subpackage look at a batch of documents as one
contiguous ``uint8`` array plus offsets.  Nulls become empty texts.  Work is
done in slices of bounded size, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

# Multipliers of a public 64-bit finaliser (splitmix64).
MIX_A = U64(0xBF58476D1CE4E5B9)
MIX_B = U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: a bijection on uint64 whose every bit is well mixed."""
    x = x ^ (x >> U64(30))
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * GOLDEN + U64(seed * int(MIX_A) & (2**64 - 1)))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U64)
    filled, step = 1, base & (2**64 - 1)
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * U64(step)
        filled += take
        step = step * step & (2**64 - 1)
    return out[:n]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): document i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole documents with at most `most` bytes; a longer document stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Copy with A-Z lower-cased; other bytes stay."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross documents: starts, ends, document of each."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span (spans ascending and disjoint)."""
    if not len(starts):
        return np.zeros(0, U64)
    longest = int((ends - starts).max())
    pw = powers(0x2545F4914F6CDD1D ^ (seed << 8), longest)
    # bytes outside spans get zero weight, so reduceat over starts is exact
    reach = np.zeros(len(data) + 1, np.int8)
    reach[starts] += 1
    reach[ends] -= 1
    inside = np.cumsum(reach[:-1]).astype(bool)
    lengths = ends - starts
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = byte_table(seed)[data[inside]] * pw[place]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mix(sums ^ (lengths.astype(U64) * GOLDEN))


def gram_hashes(data: np.ndarray, seed: int = 2) -> np.ndarray:
    """Hash of the 32 bytes from each position (the last 31 positions are meaningless)."""
    h = byte_table(seed)[data]
    width = 1
    while width < 32:
        up = h[width:] if len(h) > width else np.zeros(0, U64)
        h = h * U64((0x9FB21C651E98DF25 + 2 * width * 0x5851F42D4C957F2D) & (2**64 - 1) | 1)
        h[: len(up)] += up
        h ^= h >> U64(29)
        width *= 2
    return mix(h)
