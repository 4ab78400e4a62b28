"""A GNAT: multiway hyperplane tree whose nodes keep distance ranges between split points and sibling subtrees.

Points with integer coordinates are lifted onto a sphere by one more coordinate, so that the Euclidean distance of
a query (lifted by zero) falls as its inner product rises: a window of inner products is an annulus of
distances. Every point belongs to the child of its nearest split point. For each pair of split point i and child j
of a node the smallest and largest distance from i to the points of j are kept; with the distance of a query
to i they bound its distance to all points of j, and a child whose bounds miss the annulus is eliminated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def lift(points: np.ndarray, norm2: float) -> np.ndarray:
    """Points with a last coordinate that gives all of them the squared norm ``norm2``."""
    own = np.einsum("ij,ij->i", points, points)
    return np.column_stack([points, np.sqrt(np.maximum(norm2 - own, 0))])


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all queries to all points."""
    square = (np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", points, points)[None, :]
              - 2 * (queries @ points.T))
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Tree:
    """Split points of all nodes after each other; a child is a node or, bit-inverted, a leaf."""

    points: np.ndarray
    starts: list[int] = field(default_factory=list)  # first split point of each node
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    ranges: list[np.ndarray] = field(default_factory=list)  # of each node: [lowest | highest][i, j]

    @staticmethod
    def grow(sample: np.ndarray, arity: int, leaf: int, seed: int = 7) -> "Tree":
        """Nodes of up to ``arity`` split points, far from each other, until ``leaf`` sample points or fewer are left."""
        rng = np.random.default_rng(seed)
        tree, chosen = Tree(sample[:0]), []

        def node(members: np.ndarray) -> int:
            if len(members) <= leaf:
                tree.leaves += 1
                return ~(tree.leaves - 1)
            pool = members[rng.permutation(len(members))[: 3 * arity]]
            picks, nearest = [0], distances(sample[pool[:1]], sample[pool])[0]
            while len(picks) < arity and nearest.max() > 0:
                picks.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, distances(sample[pool[picks[-1:]]], sample[pool])[0])
            if len(picks) < 2:
                tree.leaves += 1
                return ~(tree.leaves - 1)
            at = len(tree.starts)
            tree.starts.append(sum(map(len, chosen)))
            tree.children.append([])
            chosen.append(pool[picks])
            nearest = distances(sample[members], sample[pool[picks]]).argmin(axis=1)
            for j in range(len(picks)):
                child = node(members[nearest == j])
                tree.children[at].append(child)
            return at

        node(np.arange(len(sample)))
        tree.points = sample[np.concatenate(chosen)] if chosen else sample[:0]
        tree.ranges = tree.no_ranges()
        return tree

    def no_ranges(self) -> list[np.ndarray]:
        """Ranges of a tree without points."""
        sizes = [len(c) for c in self.children]
        return [np.stack([np.full((m, m), np.inf), np.full((m, m), -np.inf)]) for m in sizes]

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each lifted point. Near ties may fall either way, so the leaf has to be kept."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))] if self.starts else []
        while todo:
            at, members = todo.pop()
            start, m = self.starts[at], len(self.children[at])
            d = distances(points[members], self.points[start: start + m])
            nearest = d.argmin(axis=1)
            for j, child in enumerate(self.children[at]):
                inside = nearest == j
                if not inside.any():
                    continue
                if child < 0:
                    out[members[inside]] = ~child
                else:
                    todo.append((child, members[inside]))
        return out

    def _leaves_below(self, child: int) -> list[int]:
        return [~child] if child < 0 else [leaf for c in self.children[child] for leaf in self._leaves_below(c)]

    def widen(self, ranges: list[np.ndarray], points: np.ndarray, leaf: np.ndarray) -> None:
        """Take the distances of points in known leaves to all split points on their way into ``ranges``."""
        for at, children in enumerate(self.children):
            start, below = self.starts[at], np.full(max(self.leaves, 1), -1)
            for j, child in enumerate(children):
                below[self._leaves_below(child)] = j
            place = below[leaf]
            for j in range(len(children)):
                members = np.flatnonzero(place == j)
                if len(members):
                    d = distances(points[members], self.points[start: start + len(children)])
                    ranges[at][0][:, j] = np.minimum(ranges[at][0][:, j], d.min(axis=0))
                    ranges[at][1][:, j] = np.maximum(ranges[at][1][:, j], d.max(axis=0))

    def bounds(self, queries: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible distance of each query to the points of each leaf; empty leaves have none."""
        low = np.zeros((len(queries), max(self.leaves, 1)))
        high = np.full(low.shape, np.inf)
        if not self.starts:
            return low, high
        d = distances(queries, self.points)
        todo = [(0, low[:, 0].copy(), high[:, 0].copy())]
        while todo:
            at, above_low, above_high = todo.pop()
            start, m = self.starts[at], len(self.children[at])
            own, (nearest, farthest) = d[:, start: start + m], self.ranges[at]
            for j, child in enumerate(self.children[at]):
                empty = not np.isfinite(nearest[:, j]).all()
                lows = np.maximum(own - farthest[:, j], nearest[:, j] - own).max(axis=1) - slack
                highs = (own + farthest[:, j]).min(axis=1) + slack
                lows = np.full(len(queries), np.inf) if empty else np.maximum(lows, above_low)
                highs = np.full(len(queries), -np.inf) if empty else np.minimum(highs, above_high)
                if child < 0:
                    low[:, ~child], high[:, ~child] = lows, highs
                else:
                    todo.append((child, lows, highs))
        return low, high
