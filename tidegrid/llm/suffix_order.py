"""Linear suffix sorting by grouping.

First part: suffixes start in groups by their first symbol. Groups are processed in
descending order; each suffix of a group points to its previous smaller position, and
the positions pointed at, whose Lyndon prefix grows by the group's, move to new groups
just above their own, those with more pointers above those with fewer. At the end a
group holds the suffixes with one Lyndon prefix and groups are in their final order.

Second part: from the least suffix on, each emitted suffix settles the one before it
and, along the previous-smaller pointers, those that end with it, at the front of their
groups. No names are made for substrings and nothing is sorted twice.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of an integer sequence in ascending order."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.append(symbols.astype(np.int64) - int(symbols.min()) + 1, 0)  # an end mark below all symbols
    order = np.argsort(text, kind="stable")
    first = np.concatenate([[True], np.diff(text[order]) != 0])
    starts = np.maximum.accumulate(np.where(first, np.arange(n + 1), 0))
    group_of = np.empty(n + 1, np.int64)
    group_of[order] = starts
    place_of = np.empty(n + 1, np.int64)
    place_of[order] = np.arange(n + 1)
    size = np.zeros(n + 2, np.int64)
    size[: n + 1] = np.bincount(starts, minlength=n + 1)
    return np.array(_emit(*_groups(order.tolist(), group_of.tolist(), place_of.tolist(), size.tolist()))[1:], np.int64)


def _groups(members: list[int], group: list[int], place: list[int], size: list[int]) -> tuple[list[int], list[int]]:
    """The final group of each suffix, named by its first place, and its previous smaller position."""
    smaller = [-1] * len(members)
    end = len(members)
    while end > 1:
        here = group[members[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(members[here:end]) if end - here > 1 else members[here:end]:
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = here
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, k in pointed.items():
                by_count.setdefault(k, []).append(j)
            levels = [by_count[k] for k in sorted(by_count, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:  # to the back of its group
                g = group[j]
                k = moved.get(g, 0) + 1
                moved[g] = k
                back = g + size[g] - k
                at, other = place[j], members[back]
                members[at], members[back] = other, j
                place[other], place[j] = at, back
            for j in level:
                g = group[j]
                group[j] = g + size[g] - moved[g]
            for g, k in moved.items():
                size[g] -= k
                if size[g]:
                    size[g + size[g]] = k
                else:
                    size[g] = k
    return group, smaller


def _emit(group: list[int], smaller: list[int]) -> list[int]:
    n = len(group)
    out, front, settled = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    settled[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not settled[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            settled[j] = True
            j = smaller[j]
    return out
