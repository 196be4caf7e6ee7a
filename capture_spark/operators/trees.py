"""Orders of places that depend on every step before: k-d leaves with deletion, for the task that has a scene's centres."""

from __future__ import annotations

import math

import numpy as np


class Leaves:
    """Places cut at medians along their widest sides into leaves of about the square root of their number.

    A step looks at the boxes of all leaves and at the places of few, so n steps cost n times that root.
    """

    def __init__(self, places: np.ndarray):
        n = len(places)
        size, todo, done = max(16, math.isqrt(n)), [np.arange(n)], []
        while todo:
            rows = todo.pop()
            if len(rows) <= size:
                done.append(rows)
                continue
            own = places[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = np.argpartition(own[:, axis], len(rows) // 2)
            todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        done = [r for r in done if len(r)]
        self.order = np.concatenate(done) if done else np.zeros(0, np.int64)
        self.end = np.cumsum([len(r) for r in done], dtype=np.int64)
        self.start = self.end - [len(r) for r in done] if done else self.end
        self.places = places[self.order]
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        self.low = np.array([places[r].min(axis=0) for r in done])
        self.high = np.array([places[r].max(axis=0) for r in done])

    def bounds(self, place: np.ndarray) -> np.ndarray:
        """Squared distance of a place to each leaf's box, which no place in the leaf is nearer than."""
        gap = np.maximum(np.maximum(self.low - place, place - self.high), 0.0)
        return (gap**2).sum(axis=1)

    def distances(self, leaf: int, place: np.ndarray) -> np.ndarray:
        return ((self.places[self.start[leaf] : self.end[leaf]] - place) ** 2).sum(axis=1)


def nearest_walk(places: np.ndarray) -> np.ndarray:
    """Rows in order: from the first always on to the nearest not yet visited, ties to the earlier row.

    Rows at one place follow each other, so only different places are walked, numbered by their first row.
    """
    if not len(places):
        return np.zeros(0, np.int64)
    _, first, of = np.unique(places, axis=0, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    turn = np.empty(len(first), np.int64)
    turn[_walk(places[np.sort(first)])] = np.arange(len(first))
    return np.argsort(turn[number[of.ravel()]], kind="stable")


def _walk(places: np.ndarray) -> np.ndarray:
    """The walk over places of which no two are equal."""
    n, tree = len(places), Leaves(places)
    out = np.zeros(n, np.int64)
    left = tree.end - tree.start
    at = 0
    for k in range(n):
        out[k] = at
        slot = tree.slot[at]
        leaf = int(np.searchsorted(tree.end, slot, "right"))
        tree.places[slot] = np.inf  # visited: farther than any
        left[leaf] -= 1
        if k + 1 == n:
            break
        place = places[at]
        bound = tree.bounds(place)
        bound[left == 0] = np.inf
        best, row = np.inf, n
        for leaf in np.argsort(bound, kind="stable"):
            if bound[leaf] > best or bound[leaf] == np.inf:
                break
            d = tree.distances(leaf, place)
            least = d.min()
            if least <= best:
                first = int(tree.order[tree.start[leaf] + np.flatnonzero(d == least)].min())
                row = first if least < best else min(row, first)
                best = least
        at = row
    return out


def farthest_walk(places: np.ndarray, k: int) -> np.ndarray:
    """The first row and then k - 1 more, each the farthest from its nearest one before, ties to the earlier row."""
    n = len(places)
    if not n:
        return np.zeros(0, np.int64)
    tree = Leaves(places)
    near, most = np.full(n, np.inf), np.full(len(tree.end), np.inf)
    out = []
    at = 0
    for _ in range(min(k, n)):
        out.append(at)
        place = places[at]
        for leaf in np.flatnonzero((tree.bounds(place) < most) | (most == np.inf)):
            s, e = tree.start[leaf], tree.end[leaf]
            near[s:e] = np.minimum(near[s:e], tree.distances(leaf, place))
            most[leaf] = near[s:e].max()
        slot = tree.slot[at]
        near[slot] = -1.0
        leaf = int(np.searchsorted(tree.end, slot, "right"))
        most[leaf] = near[tree.start[leaf] : tree.end[leaf]].max()
        top = most.max()
        at = int(min(tree.order[tree.start[leaf] + np.flatnonzero(near[tree.start[leaf] : tree.end[leaf]] == top)].min() for leaf in np.flatnonzero(most == top)))
    return np.array(out)
