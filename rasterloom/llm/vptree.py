"""Vantage-point trees over 64-bit fingerprints under Hamming distance, as flat numpy arrays.

Each node parts fingerprints by their distance d to its vantage point: near if d <= mu, far if d > mu. Two fingerprints
within radius r of each other have a midpoint within (r+1)//2 of both, and the midpoint lies on one side. So a
fingerprint goes to each side that its ball of that half radius reaches (triangle bound), and every linked pair meets
in at least one leaf. Only fingerprints at d in [mu - half + 1, mu + half] go both ways.
"""

from __future__ import annotations

import numpy as np


def distance(x: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(point))


def sides(d: np.ndarray, mu: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    return d <= mu + half, d + half > mu


def _split(x: np.ndarray, half: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """The vantage point and radius that copy the fewest fingerprints to both sides; None if none shrinks the set."""
    best = None
    for point in x[rng.integers(0, len(x), 12)]:
        counts = np.cumsum(np.bincount(distance(x, point), minlength=65 + half))
        for mu in {int(np.searchsorted(counts, len(x) * q)) for q in (0.3, 0.5, 0.7)}:
            near, far = int(counts[min(mu + half, 64)]), len(x) - int(counts[mu - half] if mu >= half else 0)
            cost = near * near + far * far
            if max(near, far) < 0.95 * len(x) and (best is None or cost < best[0]):
                best = (cost, int(point), mu)
    return best and best[1:]


class Tree:
    """points, radii: of inner nodes; child[i] = (near, far), a node number or ~leaf."""

    def __init__(self, sample: np.ndarray, half: int, leaf: int, seed: int = 7, most: int = 1 << 18):
        rng = np.random.default_rng(seed)
        self.half, self.points, self.radii, self.child, self.leaves = half, [], [], [], 0
        todo = [(np.unique(sample), None)]
        while todo:
            x, parent = todo.pop(0)  # breadth first, so that the bound on leaves cuts depth evenly
            cut = _split(x, half, rng) if len(x) > leaf and self.leaves + len(todo) < most else None
            me = len(self.points) if cut else ~self.leaves
            if parent is not None:
                self.child[parent[0]][parent[1]] = me
            if not cut:
                self.leaves += 1
                continue
            self.points.append(cut[0])
            self.radii.append(cut[1])
            self.child.append([0, 0])
            near, far = sides(distance(x, cut[0]), cut[1], half)
            todo += [(x[near], (me, 0)), (x[far], (me, 1))]

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, leaf) of every leaf that each fingerprint's half-radius ball reaches."""
        if not self.points:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), ~node, np.int64))
                continue
            for side, go in enumerate(sides(distance(x[at], self.points[node]), self.radii[node], self.half)):
                todo.append((self.child[node][side], at[go]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def linked(x: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of all pairs of the distinct fingerprints x within the radius.

    A tree of its own parts a large set; a leaf's pairs are compared in blocks.
    """
    half = (radius + 1) // 2
    tree = Tree(x, half, block) if len(x) > 2 * block else None
    rows, leaves = tree.route(x) if tree else (np.arange(len(x)), np.zeros(len(x), np.int64))
    order = np.argsort(leaves, kind="stable")
    out_i, out_j = [], []
    for at in np.split(rows[order], np.flatnonzero(np.diff(leaves[order])) + 1):
        at = np.sort(at)
        for lo in range(0, len(at), block):
            near = np.bitwise_count(x[at[lo : lo + block], None] ^ x[None, at[lo:]]) <= radius
            i, j = np.nonzero(np.triu(near, 1))
            out_i.append(at[lo + i])
            out_j.append(at[lo + j])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    if tree:  # a pair can meet in several leaves
        pair = np.unique(i * len(x) + j)
        i, j = pair // len(x), pair % len(x)
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (i, j): label passing with shortcuts."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low
