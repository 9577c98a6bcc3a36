"""Suffix array by linear grouping.

Two phases, both linear.  First, suffixes are put into groups by their longest
Lyndon prefix: groups are taken in descending order, each of its suffixes finds
the previous suffix of a smaller group, and those previous suffixes move behind
their old groups, by how many suffixes of the group point at them.  Then groups
are emitted in ascending order: each suffix emitted places the chain of larger
suffixes that it ends, found by the same pointers, next in their own groups.
Nothing is renamed recursively, and symbols may be any integers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` in ascending order; an empty suffix is smaller than any other."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    _, codes = np.unique(symbols, return_inverse=True)
    text = np.append(codes + 1, 0)
    first = np.argsort(text, kind="stable")
    ordered = text[first]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, n + 1))
    head = np.repeat(starts, sizes)
    group_of = np.empty(n + 1, np.int64)
    group_of[first] = head
    rank = np.empty(n + 1, np.int64)
    rank[first] = np.arange(n + 1)
    size_at = np.zeros(n + 1, np.int64)
    size_at[starts] = sizes
    order, place, group, size = first.tolist(), rank.tolist(), group_of.tolist(), size_at.tolist()
    before = [-1] * (n + 1)
    hits = [0] * (n + 1)

    end = n + 1
    while end > 1:  # the group of the empty suffix points at nothing
        g = group[order[end - 1]]
        members = order[g:end]
        if len(members) > 1:
            members.sort()
        found = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                if not hits[j]:
                    found.append(j)
                hits[j] += 1
        end = g
        if not found:
            continue
        if len(found) == len(members):
            layers = (found,)
        else:
            by_count: dict[int, list[int]] = {}
            for j in found:
                by_count.setdefault(hits[j], []).append(j)
            layers = [by_count[k] for k in sorted(by_count, reverse=True)]
        for layer in layers:
            moved = []
            for j in layer:
                hits[j] = 0
                old = group[j]
                left = size[old] - 1
                size[old] = left
                to = old + left
                at = place[j]
                if at != to:
                    other = order[to]
                    order[at] = other
                    place[other] = at
                    order[to] = j
                    place[j] = to
                moved.append(old)
            fresh: dict[int, int] = {}
            for j, old in zip(layer, moved, strict=True):
                group[j] = new = old + size[old]
                fresh[new] = fresh.get(new, 0) + 1
            for new, count in fresh.items():
                size[new] = count

    out = [-1] * (n + 1)
    fill = list(range(n + 1))
    out[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            j = before[j]
    return np.array(out[1:], np.int64)
