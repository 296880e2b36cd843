"""BK-trees over 64-bit fingerprints, many trees at a time.

A tree's children are keyed by their integer Hamming distance to the parent; a
search follows the edges whose key is within the radius of the query's own
distance to the node, which the triangle inequality allows.  Building and
searching go level by level over arrays, so that a task handles the trees of
all its buckets together.
"""

from __future__ import annotations

import numpy as np


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """Trees over fingerprints; tree t holds the items with tree_of == t (ascending)."""

    def __init__(self, prints: np.ndarray, tree_of: np.ndarray):
        self.prints = prints
        n = len(prints)
        roots = np.flatnonzero(np.r_[True, tree_of[1:] != tree_of[:-1]]) if n else np.zeros(0, np.int64)
        self.root_of_tree = roots
        parent, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        waiting = np.setdiff1d(np.arange(n), roots, assume_unique=True)
        at = roots[np.searchsorted(roots, waiting, side="right") - 1]  # the node each waiting item stands at
        while len(waiting):
            d = distance(prints[waiting], prints[at])
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            ranked = slot[order]
            first = np.r_[True, ranked[1:] != ranked[:-1]]
            child = waiting[order][first]  # the first item of a slot becomes its node
            parent[child], key[child] = at[order][first], d[order][first]
            below = np.repeat(child, np.diff(np.r_[np.flatnonzero(first), len(order)]))
            waiting, at = waiting[order][~first], below[~first]
        self.slots = np.sort(np.flatnonzero(parent >= 0))
        order = np.lexsort((key[self.slots], parent[self.slots]))
        self.child = self.slots[order]
        self.slot = parent[self.child] * 65 + key[self.child]  # ascending: children of a node stand together by key

    def within(self, queries: np.ndarray, trees: np.ndarray, radius: int):
        """Yield (query number, item) arrays of all items within the radius, frontier by frontier."""
        who, node = np.arange(len(queries)), self.root_of_tree[trees]
        while len(who):
            d = distance(queries[who], self.prints[node])
            near = d <= radius
            if near.any():
                yield who[near], node[near]
            low = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), side="right")
            count = high - low
            who = np.repeat(who, count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node = self.child[np.repeat(low, count) + step]


class Groups:
    """Union of array items; the root of a group is its least item."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, items: np.ndarray) -> np.ndarray:
        out = self.parent[items]
        while True:
            up = self.parent[out]
            if (up == out).all():
                self.parent[items] = out
                return out
            out = up

    def root(self, item: int) -> int:
        while (up := int(self.parent[item])) != item:
            item = up
        return item

    def join_one(self, a: int, b: int) -> bool:
        """Join two items; False if they were together."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
