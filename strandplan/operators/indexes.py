"""Indexes over the places of one design, for algorithms that change their sites as they go.

Both give exactly what a scan over all sites gives, ties included, and take memory in proportion to the sites.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np

#: Metres of a degree of latitude, rounded down.
METRES_PER_DEGREE = 111_000.0


class FreePlaces:
    """A k-d tree of places (planar) from which places are taken away.

    A node knows the box of its places and the smallest number among those left, so branches without places are not
    entered, and of many equally near places only those of small numbers are looked at.
    """

    def __init__(self, places: np.ndarray, leaf: int = 32) -> None:
        self.places, self.free = np.asarray(places, float), np.ones(len(places), bool)
        self.depth = max(0, math.ceil(math.log2(max(1, len(places)) / leaf)))
        self.first_leaf = 1 << self.depth
        self.leaf_of = np.zeros(len(places), np.int64)
        self.members: list[np.ndarray] = [np.zeros(0, np.int64)] * self.first_leaf
        self.box: list[tuple[float, float, float, float] | None] = [None] * (2 * self.first_leaf)
        self.least: list[int] = [len(places)] * (2 * self.first_leaf)
        self._split(1, np.arange(len(places)))

    def _split(self, node: int, own: np.ndarray) -> None:
        stack = [(node, own)]
        while stack:
            node, own = stack.pop()
            if len(own):
                low, high = self.places[own].min(axis=0), self.places[own].max(axis=0)
                self.box[node] = (float(low[0]), float(low[1]), float(high[0]), float(high[1]))
                self.least[node] = int(own.min())
            if node >= self.first_leaf:
                self.members[node - self.first_leaf] = np.sort(own)
                self.leaf_of[own] = node
                continue
            if len(own):
                axis = int(np.argmax(high - low))
                own = own[np.lexsort((own, self.places[own, axis]))]
            half = len(own) // 2
            stack += [(2 * node, own[:half]), (2 * node + 1, own[half:])]

    def _away(self, node: int, y: float, x: float) -> float:
        a, b, c, d = self.box[node]
        dy = a - y if y < a else y - c if y > c else 0.0
        dx = b - x if x < b else x - d if x > d else 0.0
        return math.sqrt(dy * dy + dx * dx)

    def nearest(self, place: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` nearest places left (all, if fewer), nearest first; of equally near ones the smaller number first."""
        y, x = float(place[0]), float(place[1])
        found_d, found_n = np.zeros(0), np.zeros(0, np.int64)
        last = (math.inf, len(self.places))
        queue = [(self._away(1, y, x), self.least[1], 1)] if self.least[1] < len(self.places) else []
        while queue and queue[0][:2] <= last:
            _, _, node = heapq.heappop(queue)
            if node < self.first_leaf:
                for child in (2 * node, 2 * node + 1):
                    if self.least[child] < len(self.places):
                        entry = (self._away(child, y, x), self.least[child], child)
                        if entry[:2] <= last:
                            heapq.heappush(queue, entry)
                continue
            own = self.members[node - self.first_leaf]
            away = self.places[own] - (y, x)
            found_d = np.concatenate([found_d, np.sqrt((away * away).sum(axis=1))])
            found_n = np.concatenate([found_n, own])
            order = np.lexsort((found_n, found_d))[:k]
            found_d, found_n = found_d[order], found_n[order]
            if len(order) == k:
                last = (float(found_d[-1]), int(found_n[-1]))
        return found_n

    def take(self, numbers: np.ndarray) -> None:
        """These places are no longer free."""
        self.free[numbers] = False
        for node in set(self.leaf_of[numbers].tolist()):
            own = self.members[node - self.first_leaf]
            own = self.members[node - self.first_leaf] = own[self.free[own]]
            self.least[node] = int(own[0]) if len(own) else len(self.places)
            while node > 1:
                node //= 2
                least = min(self.least[2 * node], self.least[2 * node + 1])
                if least == self.least[node]:
                    break
                self.least[node] = least


class MovingSites:
    """Sites in cells as high and, at their latitude, as wide as ``metres`` at least, for sites that move."""

    def __init__(self, sites: np.ndarray, metres: float) -> None:
        self.sites, self.side = sites, max(metres, 1e-3) / METRES_PER_DEGREE
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.cell = [self._cell(lat, lon) for lat, lon in sites.tolist()]
        for n, cell in enumerate(self.cell):
            self.cells[cell].append(n)

    def _columns(self, row: int) -> int:
        """Cells around the earth in a row: none is narrower than ``metres`` in the row or the ones beside it."""
        widest = min(90.0, (max(abs(row), abs(row + 1)) + 1) * self.side)
        return max(1, int(360 / self.side * math.cos(math.radians(widest))))

    def _cell(self, lat: float, lon: float) -> tuple[int, int]:
        row = math.floor(lat / self.side)
        return row, math.floor(lon % 360 / 360 * self._columns(row))

    def move(self, n: int, lat: float, lon: float) -> None:
        self.sites[n] = lat, lon
        cell = self._cell(lat, lon)
        if cell != self.cell[n]:
            self.cells[self.cell[n]].remove(n)
            self.cells[cell].append(n)
            self.cell[n] = cell

    def beside(self, n: int) -> list[int]:
        """In order, the sites of larger numbers that may be nearer than ``metres``."""
        row, lon, out = self.cell[n][0], float(self.sites[n, 1]) % 360 / 360, []
        for r in (row - 1, row, row + 1):
            columns = self._columns(r)
            at = math.floor(lon * columns)
            for c in {(at - 1) % columns, at % columns, (at + 1) % columns}:
                out += [m for m in self.cells.get((r, c), ()) if m > n]
        return sorted(out)


class Tour:
    """A closed tour as an array, of which stretches are reversed; the shorter side of a stretch is what is rewritten."""

    def __init__(self, order: np.ndarray) -> None:
        self.order = np.asarray(order, np.int64).copy()
        self.at = np.empty(len(self.order), np.int64)
        self.at[self.order] = np.arange(len(self.order))

    def after(self, n: int) -> int:
        return int(self.order[(self.at[n] + 1) % len(self.order)])

    def before(self, n: int) -> int:
        return int(self.order[self.at[n] - 1])

    def reverse(self, first: int, last: int) -> None:
        """Turn the stretch from ``first`` on to ``last`` round."""
        size, i, j = len(self.order), int(self.at[first]), int(self.at[last])
        inner = (j - i) % size + 1
        if 2 * inner > size:
            i, inner = (j + 1) % size, size - inner
        places = (i + np.arange(inner)) % size
        self.order[places] = self.order[places[::-1]]
        self.at[self.order[places]] = places
