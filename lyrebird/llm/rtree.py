"""An R-tree of count vectors, packed bottom up.

A point holds, for each group of tokens, how many tokens of a set fall into it.
Two sets share at most the sum of their coordinates' minima, and a set shares
with any set below a node at most the sum of minima with the node's upper corner.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 4, 8


class CountTree:
    """points: a row of counts for each set; sizes: of the sets; tags: pairs of equal tags are not wanted."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, tags: np.ndarray):
        half = points[:, ::2].sum(1, dtype=np.int64)
        self.order = np.lexsort((half, sizes, tags))
        corner, low, high = points[self.order], sizes[self.order], sizes[self.order]
        first, last = tags[self.order], tags[self.order]
        self.levels = [(corner, low, high, first, last)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            corner, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(corner), fan)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
            fan = FAN

    def probe(self, point: np.ndarray, size: int, tag: int, full: bool = False) -> np.ndarray:
        """Rows, of other tags, whose overlap with the point may reach a Jaccard similarity of 0.8.

        full: the point has a coordinate at its largest value, which says nothing.
        """
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high, first, last = self.levels[depth]
            near = (5 * high[nodes] >= 4 * size) & (4 * low[nodes] <= 5 * size) & ((first[nodes] != tag) | (last[nodes] != tag))
            nodes = nodes[near]
            if not full and len(nodes):
                shared = np.minimum(corner[nodes], point).sum(1, dtype=np.uint32).astype(np.int64)
                nodes = nodes[9 * shared >= 4 * (size + low[nodes])]
            if depth:
                fan = LEAF if depth == 1 else FAN
                nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]
