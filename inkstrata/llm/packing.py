"""Cost-balanced packing of token sequences.

Documents are tokenized where they are read.  Whole 1024-token pieces are
sequences of their own; what remains of each document is placed, longest
first, into the open sequence of lowest cost that still has room, the cost of
a piece being linear plus quadratic in its length (masked attention).  A piece
that fits nowhere is cut over the sequences with room.  Each group of
documents opens exactly as many tokens of capacity as it holds: 1024 per
sequence and powers of two for the rest, so no sequence needs padding.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm._spark import table, texts

CAPACITY = 1024
GROUP_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 512
END = 0

#: The fast core's pattern matcher backtracks over white space and gives up on runs of some hundred thousand; texts with longer runs than this go to the tokenizers library.
LONG_BLANK = 50_000

_LOADED: dict[str, object] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a byte-level BPE file of the tokenizers library, through the faster tiktoken core.

    The vocabulary and the added special strings come from the file; ids are
    those of Tokenizer.encode(text, add_special_tokens=False) (tested).  A text
    with a run of more than LONG_BLANK blanks is encoded by that library.
    """
    if path not in _LOADED:
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        core = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        whole = tokenizers.Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            if len(text) > LONG_BLANK and any(m.end() - m.start() > LONG_BLANK for m in re.finditer(r"\s+", text)):
                return whole.encode(text, add_special_tokens=False).ids
            if any(s in text for s in special):
                return core.encode(text, allowed_special="all")
            return core.encode_ordinary(text)

        _LOADED[path] = encode
    return _LOADED[path]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Room:
    """Open sequences by remaining capacity; finds the cheapest with enough room in log time."""

    def __init__(self, capacities: list[int], most: int) -> None:
        self.size = 1 << most.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.tree: list[tuple[float, int] | None] = [None] * (2 * self.size)
        for k, room in enumerate(capacities):
            self.heaps[room].append((0.0, k))
        for room, heap in enumerate(self.heaps):
            if heap:
                heapq.heapify(heap)
                self._lift(room)

    def _lift(self, room: int) -> None:
        tree, at = self.tree, room + self.size
        tree[at] = self.heaps[room][0] if self.heaps[room] else None
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = b if a is None else a if b is None or a <= b else b
            at >>= 1

    def take(self, length: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with room for `length`, removed; None if there is none."""
        best, lo, hi = None, length + self.size, 2 * self.size
        a, b, tree = lo, hi, self.tree
        while a < b:
            if a & 1:
                if tree[a] is not None and (best is None or tree[a] < best[0]):
                    best = (tree[a], a)
                a += 1
            if b & 1:
                b -= 1
                if tree[b] is not None and (best is None or tree[b] < best[0]):
                    best = (tree[b], b)
            a >>= 1
            b >>= 1
        if best is None:
            return None
        entry, at = best
        while at < self.size:
            at = 2 * at if tree[2 * at] == entry else 2 * at + 1
        room = at - self.size
        heapq.heappop(self.heaps[room])
        self._lift(room)
        return (*entry, room)

    def put(self, spent: float, k: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (spent, k))
            self._lift(room)


def place(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences are filled exactly."""
    out, tails, k = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            out.append((doc, start, capacity, k, 0))
            k += 1
        if n % capacity:
            tails.append((-(n % capacity), doc, n - n % capacity))
    total = -sum(t[0] for t in tails)
    capacities = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    room, base = Room(capacities, capacity), k
    heapq.heapify(tails)  # the longest first; parts that did not fit come back
    while tails:
        minus, doc, start = heapq.heappop(tails)
        length = -minus
        got = room.take(length)
        if got is None:
            got = room.take(1)
            fits = got[2]
            heapq.heappush(tails, (fits - length, doc, start + fits))
            length = fits
        spent, seq, left = got
        out.append((doc, start, length, base + seq, capacities[seq] - left))
        room.put(spent + cost(length), seq, left - length)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _packer(path: str, capacity: int, group: int, keep_ids: bool):
    def emit(docs: list[tuple[int, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        pieces = place([len(ids) for _, ids in docs], capacity)
        rows = []
        for doc, start, length, seq, offset in pieces:
            doc_id, ids = docs[doc]
            rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + seq, offset))
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        names = NAMES
        if keep_ids:
            cols.append(pa.array([docs[p[0]][1][p[1] : p[1] + p[2]] for p in pieces], pa.list_(pa.int32())))
            names = [*NAMES, "ids"]
        return pa.record_batch(cols, names), base + max(p[3] for p in pieces) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 36
        docs: list[tuple[int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), END], "<u4")
                docs.append((doc_id, ids))
                held += len(ids)
                if held >= group:
                    out, base = emit(docs, base)
                    yield out
                    docs, held = [], 0
        if docs:
            yield emit(docs, base)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row per piece; every token of every row of docs lies in exactly one piece.

    capacity: a power of two.  group_tokens bounds what a task holds at once.
    keep_ids adds the token ids.  Null and empty texts are one end token; a
    repeated row is packed again; an empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return texts(docs).mapInArrow(_packer(tokenizer, capacity, group_tokens, keep_ids), schema)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe())
