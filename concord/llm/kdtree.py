"""kd-trees over the parts of vectors, and the filtering step of Lloyd's algorithm on them.

A node has its bounding box, the number of its points and their sum. The entries of a codebook
go down the tree together; at a node every entry goes that is farther than another from all of
the box, and a node that a single entry is left for is assigned as a whole, by its sum. All
numbers are integers, in doubles while those are exact and else as Python's, so ties are ties.
"""

from __future__ import annotations

import numpy as np

LEAF = 64


class PartTree:
    """points: one row each. starts, ends: each node's range of `order`; left: the first of its two children, -1 at leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        starts, ends, left, lows, highs, sums = [0], [len(points)], [], [], [], []
        node = 0
        while node < len(starts):
            s, e = starts[node], ends[node]
            own = points[self.order[s:e]]
            low, high = own.min(0), own.max(0)
            lows.append(low)
            highs.append(high)
            sums.append(own.sum(0))
            spread = high - low
            if e - s > leaf and spread.any():
                at = own[:, int(np.argmax(spread))].astype(np.float64)
                half = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(at, half)]
                left.append(len(starts))
                starts += [s, s + half]
                ends += [s + half, e]
            else:
                left.append(-1)
            node += 1
        self.points = points[self.order]
        self.starts, self.ends, self.left = np.array(starts), np.array(ends), np.array(left)
        self.lows, self.highs, self.sums = np.array(lows, points.dtype), np.array(highs, points.dtype), np.array(sums, points.dtype)

    def __getstate__(self) -> dict:
        """Doubles, which are integers here, in four bytes where that is enough."""
        small = lambda x: x.dtype == np.float64 and (np.abs(x) < 1 << 31).all()
        return {k: x.astype(np.int32) if small(x) else x for k, x in vars(self).items()} | {"exact": self.points.dtype}

    def __setstate__(self, state: dict) -> None:
        exact = state.pop("exact")
        vars(self).update({k: x.astype(exact) if k in ("points", "lows", "highs", "sums") else x for k, x in state.items()})

    def remaining(self, nodes: np.ndarray, among: np.ndarray, entries: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Which of the entries `among` each node still needs.

        Against the entry nearest to the middle of the box, any other is measured in the corner of
        the box that suits it best; if it is farther even there, or as far and later, it goes.
        """
        low, high = self.lows[nodes], self.highs[nodes]
        middle = np.where(among, squares - (low + high) @ entries.T, np.inf).argmin(1)
        keep = among.copy()
        numbers = np.arange(len(entries))
        for best in np.unique(middle):
            own = np.flatnonzero(middle == best)
            away = entries - entries[best]
            gain = squares[best] - squares + 2 * (high[own] @ np.maximum(away, 0).T + low[own] @ np.minimum(away, 0).T)
            needed = (gain > 0) | ((gain == 0) & (numbers <= best))
            needed[:, best] = True
            keep[own] &= needed
        return keep

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry of each point in the order of the table, points of each entry, their sums, points assigned with whole nodes)."""
        squares = (entries * entries).sum(1)
        codes = np.empty(len(self.order), np.int64)
        counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, self.points.dtype)
        whole = 0
        nodes, among = np.array([0]), np.ones((1, len(entries)), bool)
        while len(nodes):
            among = self.remaining(nodes, among, entries, squares)
            single = among.sum(1) == 1
            for node, entry in zip(nodes[single], among[single].argmax(1)):
                s, e = self.starts[node], self.ends[node]
                codes[s:e] = entry
                counts[entry] += e - s
                sums[entry] += self.sums[node]
                whole += e - s
            nodes, among = nodes[~single], among[~single]
            for node, left in zip(nodes[self.left[nodes] < 0], among[self.left[nodes] < 0]):
                s, e = self.starts[node], self.ends[node]
                some = np.flatnonzero(left)
                own = some[(squares[some] - 2 * (self.points[s:e] @ entries[some].T)).argmin(1)]
                codes[s:e] = own
                counts += np.bincount(own, minlength=len(entries))
                np.add.at(sums, own, self.points[s:e])
            inner = self.left[nodes] >= 0
            first = self.left[nodes[inner]]
            nodes, among = np.concatenate([first, first + 1]), np.concatenate([among[inner]] * 2)
        out = np.empty(len(codes), np.int64)
        out[self.order] = codes
        return out, counts, sums, whole

    def original(self) -> np.ndarray:
        """The points in the order of the table."""
        out = np.empty_like(self.points)
        out[self.order] = self.points
        return out
