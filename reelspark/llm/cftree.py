"""Cluster features and the trees that hold them; plain NumPy, used inside tasks.

A cluster feature (CF) of unit vectors is (n, linear sum, radius bound). CFs add up, so
a tree of them summarises any number of vectors. For unit vectors the mean cosine between
the members of two CFs is the dot product of their means.
"""

from __future__ import annotations

import numpy as np

#: Vectors compared at once with the others, and CFs whose costs are held in one matrix at most.
STRIP, MATRIX = 256, 4_096


class _Node:
    __slots__ = ("leaf", "children", "sums", "counts", "means", "half", "size")

    def __init__(self, leaf: bool, dim: int, branching: int) -> None:
        self.leaf = leaf
        self.children: list = []  # entry numbers in a leaf, else nodes
        self.sums = np.zeros((branching + 1, dim))
        self.counts = np.zeros(branching + 1)
        self.means = np.zeros((branching + 1, dim))
        self.half = np.zeros(branching + 1)  # half the squared norm of each mean
        self.size = 0

    def add(self, child, total: np.ndarray, n: float) -> None:
        i = self.size
        self.children.append(child)
        self.sums[i], self.counts[i] = total, n
        self.size += 1
        self._refresh(i)

    def grow(self, i: int, total: np.ndarray, n: float) -> None:
        self.sums[i] += total
        self.counts[i] += n
        self._refresh(i)

    def _refresh(self, i: int) -> None:
        mean = self.sums[i] / self.counts[i]
        self.means[i] = mean
        self.half[i] = mean @ mean / 2

    def nearest(self, x: np.ndarray) -> int:
        return int(np.argmax(self.means[: self.size] @ x - self.half[: self.size]))

    def total(self) -> tuple[np.ndarray, float]:
        return self.sums[: self.size].sum(0), float(self.counts[: self.size].sum())


class CFTree:
    """A height-balanced tree of cluster features of unit vectors.

    ``insert`` returns the number of the leaf entry that took the vector (or CF) in. An
    entry absorbs what lies within ``threshold`` of its mean. With ``budget`` it absorbs
    instead while the squared norm of its mean, which is 1 minus its mean squared radius,
    stays above a floor; whenever the tree has more entries than the budget the floor is
    lowered and the entries are inserted again, which changes their numbers. Distances
    tell nothing at that scale: in many dimensions a mean of unlike vectors is as close
    to any vector as to its own members.
    """

    def __init__(self, dim: int, threshold: float, branching: int = 24, budget: int | None = None) -> None:
        self.dim, self.threshold, self.branching, self.budget = dim, threshold, branching, budget
        self.floor = 0.8
        self._start()

    def _start(self) -> None:
        self.root = _Node(True, self.dim, self.branching)
        self.sums: list[np.ndarray] = []
        self.counts: list[float] = []
        # Per entry: means at counts 1, 2, 4, ... and how far what came until the next lay from them.
        self.trail: list[list[tuple[np.ndarray, float]]] = []

    def __len__(self) -> int:
        return len(self.counts)

    def insert(self, total: np.ndarray, n: float = 1.0) -> int:
        x = total / n
        path, node = [], self.root
        while not node.leaf:
            i = node.nearest(x)
            path.append((node, i))
            node = node.children[i]
        entry = None
        if node.size:
            i = node.nearest(x)
            if self.budget is None:
                gap = x - node.means[i]
                takes = gap @ gap <= self.threshold * self.threshold
            else:
                both = (node.sums[i] + total) / (node.counts[i] + n)
                takes = both @ both >= self.floor
            if takes:
                entry = node.children[i]
                node.grow(i, total, n)
                self.sums[entry] = node.sums[i].copy()
                self.counts[entry] += n
                if self.budget is None:
                    self._remember(entry, x, node.means[i])
        if entry is None:
            entry = len(self.counts)
            self.sums.append(total.copy())
            self.counts.append(n)
            self.trail.append([(x, 0.0)])
            node.add(entry, total, n)
        for parent, j in path:
            parent.grow(j, total, n)
        if node.size > self.branching:
            self._split(node, path)
        if self.budget and len(self.counts) > self.budget:
            self._rebuild()
        return entry

    def _remember(self, entry: int, x: np.ndarray, mean: np.ndarray) -> None:
        trail, n = self.trail[entry], int(self.counts[entry])
        at, reach = trail[-1]
        gap = x - at
        trail[-1] = (at, max(reach, float(np.sqrt(gap @ gap))))
        if n & (n - 1) == 0:
            trail.append((mean.copy(), 0.0))

    def _radius(self, entry: int) -> float:
        """A bound for the distance of any member from the entry's mean."""
        mean = self.sums[entry] / self.counts[entry]
        return max(reach + float(np.sqrt(((at - mean) ** 2).sum())) for at, reach in self.trail[entry])

    def _split(self, node: _Node, path: list) -> None:
        while node.size > self.branching:
            means = node.means[: node.size]
            apart = node.half[: node.size, None] + node.half[None, : node.size] - means @ means.T
            a, b = np.unravel_index(np.argmax(apart), apart.shape)
            to_b = apart[:, b] < apart[:, a]
            to_b[a], to_b[b] = False, True
            parts = []
            for chosen in (~to_b, to_b):
                part = _Node(node.leaf, self.dim, self.branching)
                for k in np.flatnonzero(chosen):
                    part.add(node.children[k], node.sums[k], node.counts[k])
                parts.append(part)
            if path:
                parent, i = path.pop()
            else:
                parent, i = _Node(False, self.dim, self.branching), None
                self.root = parent
            if i is None:
                parent.add(parts[0], *parts[0].total())
            else:
                parent.children[i] = parts[0]
                parent.sums[i], parent.counts[i] = parts[0].total()
                parent._refresh(i)
            parent.add(parts[1], *parts[1].total())
            node = parent

    def _rebuild(self) -> None:
        """Lower the floor until the entries fit well within the budget, and insert them again."""
        while len(self.counts) > self.budget * 0.8:
            entries = list(zip(self.sums, self.counts))
            self.floor *= 0.93
            self._start()
            for total, n in entries:
                self.insert(total, n)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, sums, radius bounds) of the leaf entries."""
        radius = [self._radius(i) for i in range(len(self))] if self.budget is None else [0.0] * len(self)
        return np.array(self.counts), np.array(self.sums).reshape(-1, self.dim), np.array(radius)


def ward(n: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of an agglomeration by Ward's criterion (nearest-neighbour chains)."""
    m = len(n)
    if m <= k:
        return np.arange(m)
    n = n.astype(float).copy()
    squared = (means**2).sum(1)
    gap = np.maximum(squared[:, None] + squared[None, :] - 2 * means @ means.T, 0)
    cost = (gap * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))).astype(np.float32)
    np.fill_diagonal(cost, np.inf)
    alive, merges, chain = np.ones(m, bool), [], []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(cost[a]))
            if len(chain) > 1 and cost[a, chain[-2]] <= cost[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height = float(cost[a, b])
        merges.append((height, a, b))
        others = alive.copy()
        others[[a, b]] = False
        o = np.flatnonzero(others)
        both = n[a] + n[b]
        new = ((n[a] + n[o]) * cost[a, o] + (n[b] + n[o]) * cost[b, o] - n[o] * height) / (both + n[o])
        cost[a, o] = cost[o, a] = new
        cost[b, :] = cost[:, b] = np.inf
        n[a] = both
        alive[b] = False
    # The chain finds merges out of order: cut the k - 1 costliest.
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda x: x[0])[: m - k]:
        parent[root(b)] = root(a)
    return np.unique([root(i) for i in range(m)], return_inverse=True)[1]


def join_pairs(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the parts of the pairs (i, j) in ``roots``, where every member leads to the least of its part."""
    while len(i):
        low = np.minimum(roots[i], roots[j])
        if (low == roots[i]).all() and (low == roots[j]).all():
            break
        # The roots themselves move along, so whole parts do.
        np.minimum.at(roots, np.concatenate([roots[i], roots[j], i, j]), np.tile(low, 4))
        while (deeper := roots[roots] != roots).any():
            roots[deeper] = roots[roots[deeper]]


def _parts(means: np.ndarray, cosine: float) -> np.ndarray:
    """The least number in each connected part of the vectors whose dot products reach ``cosine``."""
    roots = np.arange(len(means))
    for start in range(0, len(means), STRIP):
        i, j = np.nonzero(means[start : start + STRIP] @ means[start:].T >= cosine)
        join_pairs(roots, i[i < j] + start, j[i < j] + start)
    return roots


def _all_reach(means: np.ndarray, cosine: float) -> bool:
    return all((means[s : s + STRIP] @ means[s:].T).min() >= cosine for s in range(0, len(means), STRIP))


def _joined(n: np.ndarray, means: np.ndarray, cosine: float) -> np.ndarray:
    """Labels of the Ward agglomeration of one part: the cheapest pair that reaches ``cosine`` joins first.

    Every row remembers its cheapest partner, so a merge costs a row, not the matrix.
    """
    m = len(n)
    size, centre = n.astype(float), means.astype(float)
    label = np.arange(m)
    alive = np.ones(m, bool)

    def row(i: int) -> np.ndarray:
        dots = centre @ centre[i]
        cost = np.maximum(squared + squared[i] - 2 * dots, 0) * (size * size[i] / (size + size[i]))
        cost[(dots < cosine) | ~alive] = np.inf
        cost[i] = np.inf
        return cost

    squared = (centre**2).sum(1)
    cost = np.array([row(i) for i in range(m)])
    least, partner = cost.min(1), cost.argmin(1)
    while True:
        a = int(np.argmin(least))
        if not np.isfinite(least[a]):
            return label
        a, b = sorted((a, int(partner[a])))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        squared[a] = centre[a] @ centre[a]
        alive[b] = False
        label[label == b] = a
        cost[b] = cost[:, b] = np.inf
        least[b] = np.inf
        cost[a] = cost[:, a] = row(a)
        least[a], partner[a] = cost[a].min(), cost[a].argmin()
        lost = np.flatnonzero(alive & ((partner == a) | (partner == b)))
        least[lost], partner[lost] = cost[lost].min(1), cost[lost].argmin(1)
        nearer = alive & (cost[:, a] < least)
        least[nearer], partner[nearer] = cost[nearer, a], a


def agglomerate(n: np.ndarray, means: np.ndarray, cosine: float, parts: np.ndarray | None = None) -> np.ndarray:
    """Labels of a Ward agglomeration that only joins CFs whose mean cosine reaches ``cosine``.

    Only CFs connected by such pairs can ever join, so each connected part is treated by
    itself; where all its pairs qualify the result is one cluster in any order of merges.
    Other parts above MATRIX are agglomerated in runs of neighbours along their widest
    direction, and the clusters found again, while that joins any.
    """
    out = _parts(means, cosine) if parts is None else parts.copy()
    roots, order = out.copy(), np.argsort(out, kind="stable")
    # Parts of one or two are clusters as they are.
    for root in np.flatnonzero(np.bincount(roots, minlength=len(roots)) >= 3):
        part = order[np.searchsorted(roots[order], root) : np.searchsorted(roots[order], root, side="right")]
        if _all_reach(means[part], cosine):
            continue
        size, centre, label = n[part].astype(float), means[part].astype(float), np.arange(len(part))
        while True:
            if len(size) > MATRIX:
                along = centre - centre.mean(0)
                away = along @ along[np.argmax((along**2).sum(1))]
                runs = np.array_split(np.argsort(away, kind="stable"), -(-len(size) // MATRIX))
            else:
                runs = [np.arange(len(size))]
            found = np.empty(len(size), np.int64)
            for run in runs:
                found[run] = run[_joined(size[run], centre[run], cosine)]
            kept, place = np.unique(found, return_inverse=True)
            total = np.zeros((len(kept), centre.shape[1]))
            np.add.at(total, place, centre * size[:, None])
            size = np.bincount(place, weights=size)
            centre, label = total / size[:, None], place[label]
            if len(runs) == 1 or len(kept) == len(found):
                break
        first = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(first, label, part)
        out[part] = first[label]
    return out
