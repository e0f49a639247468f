"""Suffix arrays by linear grouping.

Phase one gathers suffixes that share their Lyndon prefix (the longest Lyndon word at their front). Groups are
taken in descending order. Each suffix of a group points to the nearest suffix before it of a lower group;
those pointed to have the group's word appended to their own prefix, so they move to a new group just
above their old one, by how often they were pointed to. Phase two walks the array from its smallest suffix and
puts each suffix on its left, and those the pointers lead to, at the next place of their groups. No
ranks are renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Order of the suffixes of ``symbols``, whose last one is smaller than all others and unique."""
    n = len(symbols)
    if n == 0:
        return []
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    fresh = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(fresh, n))
    array: list[int] = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(fresh, sizes)
    size = np.zeros(n, np.int64)
    size[fresh] = sizes
    # Lists are faster than arrays one item at a time. A group is named by its first place.
    place, group, size = place.tolist(), group_of.tolist(), size.tolist()
    before = [-1] * n

    end = n
    while end > 0:
        start = group[array[end - 1]]
        pointed: dict[int, int] = {}
        members = array[start:end]
        if end - start > 1:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            ((p, _),) = pointed.items()
            moves = [[p]]
        elif pointed:
            together: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                together.setdefault((-times, group[p]), []).append(p)
            moves = [together[k] for k in sorted(together)] if len(together) > 1 else list(together.values())
        else:
            moves = []
        for moved in moves:
            old = group[moved[0]]
            left = size[old]
            for p in moved:
                left -= 1
                last = old + left
                here, other = place[p], array[last]
                array[here], place[other] = other, here
                array[last], place[p] = p, last
            new = old + left
            size[old] = left
            size[new] = len(moved)
            for p in moved:
                group[p] = new
        end = start

    out = [-1] * n
    free = list(range(n))  # next free place by group
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = before[p]
    return out


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """For each place the number of symbols its suffix shares with the one before it, not beyond a symbol up to ``stop``."""
    out = np.zeros(len(order), np.int64)
    held = np.arange(1, len(order))
    depth = 0
    while len(held):
        a, b = symbols[order[held] + depth], symbols[order[held - 1] + depth]
        held = held[(a == b) & (a > stop)]
        out[held] += 1
        depth += 1
    return out
