"""Metric trees by the anchors hierarchy, and exact nearest entries of whole balls.

A tree is built from the middle out: about the square root of n anchors are
placed, each on the point that lies farthest from its anchor, and take over the
points that are nearer to them; anchors are then joined upwards, always the two
whose common ball is smallest, and the points of each anchor are treated
likewise below. Every ball caches the sum and the number of its points.

Points are integers. What decides is exact: distances are computed in doubles
only where all sums stay below 2^53, else in Python's integers; a ball drops an
entry only if another is nearer to all of its points by more than rounding can
make, so ties always reach the points themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np


@dataclass
class Tree:
    """Balls from the root down; the points of ball i stand at ``start[i]:stop[i]`` of ``order``; leaves have left -1."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    NAMES = ("order", "start", "stop", "left", "right", "sums", "radius")
    KINDS = (np.int32, np.int32, np.int32, np.int32, np.int32, np.int64, np.float64)

    def packed(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n), dtype=k).tobytes() for n, k in zip(self.NAMES, self.KINDS)}

    @classmethod
    def unpacked(cls, stored: dict[str, bytes]) -> Tree:
        held = {n: np.frombuffer(stored[n], dtype=k) for n, k in zip(cls.NAMES, cls.KINDS)}
        held["sums"] = held["sums"].reshape(len(held["start"]), -1)
        return cls(**held)


def _anchors(x: np.ndarray, most: int) -> np.ndarray:
    """The anchor of every point. A new anchor asks only points farther from theirs than half the way between both."""
    owner, pivots = np.zeros(len(x), dtype=np.int64), [0]
    away = np.linalg.norm(x - x[0], axis=1)
    while len(pivots) < most:
        far = int(away.argmax())  # the farthest point of the widest anchor
        if away[far] == 0:
            break
        between = np.linalg.norm(x[pivots] - x[far], axis=1)
        asked = np.flatnonzero(away > between[owner] / 2)
        near = np.linalg.norm(x[asked] - x[far], axis=1)
        stolen = near < away[asked]
        owner[asked[stolen]], away[asked[stolen]] = len(pivots), near[stolen]
        owner[far], away[far] = len(pivots), 0.0
        pivots.append(far)
    return owner


def build(points: np.ndarray, leaf: int = 64) -> Tree:
    """The tree of at least one point; balls of up to ``leaf`` points, or of equal points, are leaves."""
    x = points.astype(np.float64)
    kids: list[tuple[int, int]] = []
    held: list[np.ndarray | None] = []
    sizes: list[int] = []

    def node(pair: tuple[int, int], members: np.ndarray | None) -> int:
        kids.append(pair)
        held.append(members)
        sizes.append(len(members) if members is not None else sizes[pair[0]] + sizes[pair[1]])
        return len(kids) - 1

    def grow(members: np.ndarray) -> int:
        if len(members) <= leaf:
            return node((-1, -1), members)
        owner = _anchors(x[members], max(2, isqrt(len(members))))
        if owner.max() == 0:
            return node((-1, -1), members)
        by = np.argsort(owner, kind="stable")
        groups = [members[g] for g in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)]
        return joined([grow(g) for g in groups], groups)

    def joined(nodes: list[int], groups: list[np.ndarray]) -> int:
        centre = np.stack([x[g].mean(axis=0) for g in groups])
        radius = np.array([np.linalg.norm(x[g] - c, axis=1).max() for g, c in zip(groups, centre)])

        def common(i: int) -> np.ndarray:
            apart = np.linalg.norm(centre - centre[i], axis=1)
            return np.maximum((apart + radius + radius[i]) / 2, np.maximum(radius, radius[i]))

        cost = np.stack([common(i) for i in range(len(nodes))])
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(nodes) - 1):
            a, b = divmod(int(cost.argmin()), len(nodes))
            wide, na, nb = cost[a, b], sizes[nodes[a]], sizes[nodes[b]]
            centre[a], radius[a] = (centre[a] * na + centre[b] * nb) / (na + nb), wide
            nodes[a] = node((nodes[a], nodes[b]), None)
            gone = np.isinf(cost[a]) & (np.arange(len(nodes)) != a)
            cost[b], cost[:, b] = np.inf, np.inf
            row = common(a)
            row[gone] = row[[a, b]] = np.inf
            cost[a], cost[:, a] = row, row
        return nodes[a]

    root = grow(np.arange(len(x)))
    at, start, order = [root], {root: 0}, np.zeros(len(x), dtype=np.int64)
    for k in at:  # parents before their balls
        left, right = kids[k]
        if left < 0:
            order[start[k] : start[k] + sizes[k]] = held[k]
        else:
            start[left], start[right] = start[k], start[k] + sizes[left]
            at += (left, right)
    place = {k: i for i, k in enumerate(at)}
    begin = np.array([start[k] for k in at])
    end = begin + np.array([sizes[k] for k in at])
    upto = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points[order], axis=0, dtype=np.int64)])
    sums = upto[end] - upto[begin]
    means, y = sums / (end - begin)[:, None], x[order]
    radius = np.array([np.sqrt(((y[a:b] - m) ** 2).sum(axis=1).max()) for a, b, m in zip(begin, end, means)])
    sides = [np.array([place.get(kids[k][s], -1) for k in at]) for s in (0, 1)]
    return Tree(order, begin, end, sides[0], sides[1], sums, radius)


def exact_kind(width: int, largest: int) -> type:
    """The number type in which squared distances of such points are exact."""
    return np.float64 if 4 * max(1, width) * largest * largest < 1 << 53 else object


class Owner:
    """Assigns the points of a tree to their nearest entry (ties: the lower one)."""

    def __init__(self, tree: Tree, points: np.ndarray):
        self.tree, self.points = tree, points[tree.order]  # in the order of the balls
        self.largest = max(1, int(np.abs(points).max(initial=0)))
        self.means = tree.sums / (tree.stop - tree.start)[:, None]
        #: Distances computed so far, from balls and from points.
        self.asked = 0

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's entry (in the order of the balls), and the sums and counts of each entry."""
        tree, width = self.tree, book.shape[1]
        largest = max(self.largest, int(np.abs(book).max(initial=0)))
        kind = exact_kind(width, largest)
        slack = 1e-12 * width * float(largest) ** 2  # beyond what rounding adds to a bound
        rough, exact = book.astype(np.float64), book.astype(kind)
        square = (exact * exact).sum(axis=1)
        between = np.sqrt(np.maximum(((rough[:, None, :] - rough[None, :, :]) ** 2).sum(axis=2), 0))
        entry = np.zeros(len(self.points), dtype=np.int64)
        sums, counts = np.zeros((len(book), width), dtype=np.int64), np.zeros(len(book), dtype=np.int64)
        single = np.zeros(len(self.points), dtype=bool)
        stack = [(0, np.arange(len(book)))]
        while stack:
            ball, near = stack.pop()
            a, b = tree.start[ball], tree.stop[ball]
            if len(near) > 1:
                away = ((rough[near] - self.means[ball]) ** 2).sum(axis=1)
                self.asked += len(near)
                best = int(away.argmin())
                # an entry goes if even the ball's point that leans towards it most is nearer to the best one
                near = near[away - away[best] <= 2 * tree.radius[ball] * between[near[best], near] + slack]
            if len(near) == 1:  # the ball is wholly owned
                entry[a:b] = near[0]
                sums[near[0]] += tree.sums[ball]
                counts[near[0]] += b - a
            elif tree.left[ball] < 0:
                x = self.points[a:b].astype(kind)
                entry[a:b] = near[(square[near] - 2 * (x @ exact[near].T)).argmin(axis=1)]
                self.asked += len(x) * len(near)
                single[a:b] = True
            else:
                stack += ((tree.left[ball], near), (tree.right[ball], near))
        if single.any():
            own, x = entry[single], self.points[single]
            by = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[by], prepend=-1))
            sums[own[by][cuts]] += np.add.reduceat(x[by], cuts, axis=0)
            counts += np.bincount(own, minlength=len(book))
        return entry, sums, counts

    def errors(self, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distance of each point to its entry; doubles or Python's integers."""
        kind = exact_kind(book.shape[1], max(self.largest, int(np.abs(book).max(initial=0))))
        apart = self.points.astype(kind) - book.astype(kind)[entry]
        return (apart * apart).sum(axis=1) if book.shape[1] else np.zeros(len(entry))
