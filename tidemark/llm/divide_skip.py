"""T-occurrence search by DivideSkip: which members hold T or more of a query's elements.

Each element of the query has an inverted list, the places of the members that hold it. The L lists of the most common elements
are the long ones, the others the short ones. A member of T lists stands in T - L of the short ones at least, so these are merged
by a heap that counts occurrences and skips members that can't get there; the members that do are then sought in the long lists by
binary search. A long list is never made: whether a member stands in it is whether the member's sorted set holds its element.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np

#: The cost of a heap's step by the cost of a probe, for a list of one member more.
MU = 0.0085


def long_lists(least: int, members: int) -> int:
    """How many lists are long: more of them make fewer steps of the heap and more probes; one short occurrence stays."""
    return max(0, min(least - 1, int(least / (MU * np.log2(max(members, 2)) + 1))))


def merge_skip(lists: Sequence[Sequence[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, occurrences) of every member that stands in `least` of the sorted lists or more; least is 1 or more."""
    heap = [(row[0], k, 0) for k, row in enumerate(lists) if len(row)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            jump = top + 1
        else:  # a member before the one that least - 1 lists precede stands in fewer than `least`
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            jump = max(top + 1, heap[0][0])
        for _, k, at in popped:
            at = bisect_left(lists[k], jump, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


def holds(members: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Which elements a sorted set holds, by binary search."""
    if not len(members):
        return np.zeros(len(elements), bool)
    return members[np.minimum(np.searchsorted(members, elements), len(members) - 1)] == elements


def search(query: np.ndarray, rank: np.ndarray, members: Sequence[np.ndarray], least: np.ndarray) -> list[tuple[int, int]]:
    """(place, occurrences) of the members that hold least[place] of the query's elements or more.

    rank: of each element of the query, higher for more common ones; members: sorted sets; least: 1 or more each.
    """
    if not len(members):
        return []
    lowest = int(least.min())
    n_long = long_lists(lowest, len(members))
    order = np.argsort(rank, kind="stable")
    short, long = (np.sort(query[part]) for part in (order[: len(order) - n_long], order[len(order) - n_long :]))
    found = [np.flatnonzero(holds(m, short)) for m in members]
    lists: dict[int, list[int]] = {}
    for place, rows in enumerate(found):
        for k in rows.tolist():
            lists.setdefault(k, []).append(place)
    out = []
    for place, n in merge_skip(list(lists.values()), max(1, lowest - n_long)):
        if n >= least[place] - n_long:
            n += int(holds(members[place], long).sum())
            if n >= least[place]:
                out.append((place, n))
    return out
