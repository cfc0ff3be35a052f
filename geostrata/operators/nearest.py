"""Nearest points of two sets in the plane, exactly: strips along the wider axis, sorted along the other.

A set's points are cut along the axis on which they spread more into about as many strips as each strip has points, and
points with one place on it stay together. Within a strip they are sorted along the other axis. A search looks up its place
in its own strip and goes outwards until the step along that axis alone is as far as the best so far, then does the same in
the strips on both sides whose boxes are nearer than that. Few steps are left however many points a line has. Small sets
are compared whole, block by block, which takes less than going through strips.
"""

from __future__ import annotations

import numpy as np

#: Searches of a closest pair that are made at once, before the best of them bounds the next.
CHUNK = 4096
#: Searches of nearest points that are made at once, so that what they take stays in the processor's cache.
SEARCHES = 8192
#: Distances between two small sets, at most, that are all taken, and as many of them at once as stay in the cache.
SMALL, BLOCK = 2**20, 2**15


class Strips:
    """The points (u, v), at least one, to be searched."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.swapped = bool(np.ptp(v) > np.ptp(u))
        if self.swapped:
            u, v = v, u
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]  # copies of a point would all be gone through
        u, v, size = u[new], v[new], max(1, int(np.sqrt(new.sum())))
        runs = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        self.begin = runs[np.r_[True, runs[1:] // size != runs[:-1] // size]]
        self.end = np.r_[self.begin[1:], len(u)]
        self.low, self.high = u[self.begin], u[self.end - 1]
        strip = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        order = np.lexsort((v, strip))
        self.u, self.v = u[order], v[order]
        self.bottom, self.top = self.v[self.begin], self.v[self.end - 1]
        self.values = np.unique(v)
        self.places = strip * (len(self.values) + 1) + np.searchsorted(self.values, self.v)

    def nearest_squared(self, x: np.ndarray, z: np.ndarray, limit: float = np.inf) -> np.ndarray:
        """For each point (x, z) the squared distance to the nearest point, or the limit if that is no larger."""
        if self.swapped:
            x, z = z, x
        best, rank = np.full(len(x), limit), np.searchsorted(self.values, z)
        every, own = np.arange(len(x)), np.clip(np.searchsorted(self.low, x, "right") - 1, 0, len(self.low) - 1)
        self._search(x, z, rank, best, every, own)
        for side in (1, -1):
            left, strip = every, own + side
            while left.size:
                inside = (strip >= 0) & (strip < len(self.low))
                left, strip = left[inside], strip[inside]
                along = np.maximum(0, np.maximum(self.low[strip] - x[left], x[left] - self.high[strip])) ** 2
                nearer = along < best[left]
                left, strip, along = left[nearer], strip[nearer], along[nearer]
                across = np.maximum(0, np.maximum(self.bottom[strip] - z[left], z[left] - self.top[strip])) ** 2
                near = along + across < best[left]
                self._search(x, z, rank, best, left[near], strip[near])
                strip = strip + side
        return best

    def _search(self, x: np.ndarray, z: np.ndarray, rank: np.ndarray, best: np.ndarray, which: np.ndarray, strip: np.ndarray) -> None:
        """Improves best of some points by one strip each."""
        at = np.searchsorted(self.places, strip * (len(self.values) + 1) + rank[which])
        for side, first in ((1, at), (-1, at - 1)):
            left, place, begin, end = which, first, self.begin[strip], self.end[strip]
            while left.size:
                inside = (place >= begin) & (place < end)
                left, place, begin, end = left[inside], place[inside], begin[inside], end[inside]
                across = (self.v[place] - z[left]) ** 2
                nearer = across < best[left]
                left, place, begin, end, across = left[nearer], place[nearer], begin[nearer], end[nearer], across[nearer]
                best[left] = np.minimum(best[left], across + (self.u[place] - x[left]) ** 2)
                place = place + side


def nearest_squared(x: np.ndarray, z: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each point (x, z) the squared distance to the nearest point (u, v)."""
    strips = Strips(u, v)
    return np.concatenate([strips.nearest_squared(x[at : at + SEARCHES], z[at : at + SEARCHES]) for at in range(0, len(x), SEARCHES)])


def mutual_squared(x: np.ndarray, z: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest_squared of (x, z) to (u, v), and of (u, v) to (x, z)."""
    if len(x) * len(u) > SMALL:
        return nearest_squared(x, z, u, v), nearest_squared(u, v, x, z)
    there, back, rows = np.empty(len(x)), np.full(len(u), np.inf), max(1, BLOCK // len(u))
    for at in range(0, len(x), rows):
        d = (x[at : at + rows, None] - u) ** 2
        d += (z[at : at + rows, None] - v) ** 2
        there[at : at + rows] = d.min(1)
        np.minimum(back, d.min(0), out=back)
    return there, back


def closest_squared(x: np.ndarray, z: np.ndarray, u: np.ndarray, v: np.ndarray) -> float:
    """The squared distance of the closest points (x, z) and (u, v); what some points have found bounds the search of the others."""
    strips, best = Strips(u, v), np.inf
    for at in range(0, len(x), CHUNK):
        best = float(strips.nearest_squared(x[at : at + CHUNK], z[at : at + CHUNK], best).min())
    return best
