"""Cables along roads: from one place to another over the nearest road segments of a design's graph."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.operators.clusters import by_design, metres
from strandplan.operators.roads import joined_up, noisy
from strandplan.operators.searches import Ways, runs

Place = tuple[float, float]


#: Nodes of searches that are kept to go on from where they stopped: of one of a net's nodes each search takes 13 bytes.
SEARCHED = 1 << 21

#: Nodes that searches side by side may have in all, each of 13 bytes; and how many searches at most.
SIDE_BY_SIDE, MOST_SEARCHES = 1 << 23, 64

#: Rings of cells that many places look into together; those that find nothing so near are looked up one by one.
RINGS = 4


def compact(values: np.ndarray, kind: str) -> array:
    """The values as an array of the standard library, of which single ones are read faster."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, kind).view(np.uint8).data)
    return out


class Search:
    """Shortest ways from a node over the ways ``to`` and ``size`` at each node, found as far as they are asked for."""

    def __init__(self, first: array, to: array, size: array, source: int) -> None:
        self.first, self.to, self.size, self.source = first, to, size, source
        nodes = len(first) - 1
        self.best, self.via, self.found = array("d", [math.inf]) * nodes, array("i", [-1]) * nodes, bytearray(nodes)
        self.best[source] = 0.0
        self.queue = [(0.0, -1, source)]

    def reach(self, target: int) -> float | None:
        first, to, size, best, via, found, queue = self.first, self.to, self.size, self.best, self.via, self.found, self.queue
        while not found[target] and queue:
            d, _, node = heapq.heappop(queue)
            if found[node]:
                continue
            found[node] = 1
            for e in range(first[node], first[node + 1]):
                v, total = to[e], d + size[e]
                if not found[v] and (total < best[v] or total == best[v] and node < via[v]):
                    best[v], via[v] = total, node
                    heapq.heappush(queue, (total, node, v))
        return best[target] if found[target] else None

    def way(self, target: int) -> list[int]:
        """Nodes from the source to a target that was reached."""
        out = [target]
        while out[-1] != self.source:
            out.append(self.via[out[-1]])
        return out[::-1]


class SegmentCells:
    """Segments by the cells of a grid that they come through, to find the nearest to a place (planar)."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> None:
        self.starts, self.ends = starts, ends
        if not (size := len(starts)):
            return
        low, high = np.minimum(starts.min(axis=0), ends.min(axis=0)), np.maximum(starts.max(axis=0), ends.max(axis=0))
        legs = np.abs(ends - starts).max(axis=1)
        self.side = max(float((high - low).max()) / math.sqrt(size), float(np.median(legs)), 1e-9)
        self.low, self.high = (np.floor(x / self.side).astype(np.int64).tolist() for x in (low, high))
        self.wide = self.high[1] - self.low[1] + 1
        held = np.concatenate([self._held(k, legs[k : k + step]) for k in range(0, size, step)])
        held.sort()
        self.segments = (held % size).astype(np.int32)
        held //= size
        self.first = np.append(np.flatnonzero(np.append(True, held[1:] != held[:-1])), len(held)).astype(np.int32)
        self.cells = held[self.first[:-1]]

    def _held(self, k: int, legs: np.ndarray) -> np.ndarray:
        """Cells and segments in one number, for the segments from k on."""
        a, b = self.starts[k : k + len(legs)], self.ends[k : k + len(legs)]
        pieces = np.maximum(1, np.ceil(legs / self.side)).astype(np.int64)
        of, nth = runs(pieces)
        p, q = (np.floor((a[of] + (b[of] - a[of]) * (nth + m)[:, None] / pieces[of, None]) / self.side).astype(np.int64) for m in (0, 1))
        # The last piece ends where the segment ends, but for rounding, which may go beyond the outermost cell.
        p, q = (np.clip(x, self.low, self.high) for x in (np.minimum(p, q), np.maximum(p, q)))
        tall, wide = (q - p + 1).T
        piece, nth = runs(tall * wide)
        y, x = p[piece, 0] + nth // wide[piece] - self.low[0], p[piece, 1] + nth % wide[piece] - self.low[1]
        return np.unique((y * self.wide + x) * len(self.starts) + k + of[piece])

    def _in(self, y: int, x0: int, x1: int) -> list[int]:
        """Segments in the cells of a row."""
        row = (y - self.low[0]) * self.wide - self.low[1]
        a, b = np.searchsorted(self.cells, (row + x0, row + x1 + 1))
        return self.segments[self.first[a] : self.first[b]].tolist()

    def _off(self, k: np.ndarray, places: np.ndarray, rooted: bool) -> tuple[np.ndarray, np.ndarray]:
        """How far segments are from places, squared unless rooted, and the nearest places on them."""
        start = self.starts[k]
        leg = self.ends[k] - start
        square = (leg**2).sum(axis=1)
        share = np.clip(((places - start) * leg).sum(axis=1) / np.where(square == 0, 1, square), 0, 1)
        found = start + share[:, None] * leg
        off = ((found - places) ** 2).sum(axis=1)
        return np.sqrt(off) if rooted else off, found

    def nearest_of_all(self, places: np.ndarray, rooted: bool = False, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`nearest` of many places: the segments, how far they are off, and the places on them."""
        out = np.full(len(places), -1, np.int64), np.full(len(places), np.inf), places.astype(float)
        for k in range(0, len(places), step):
            self._nearest_of(places[k : k + step], rooted, *(x[k : k + step] for x in out))
        return out

    def _nearest_of(self, places: np.ndarray, rooted: bool, segment: np.ndarray, off: np.ndarray, on: np.ndarray) -> None:
        cell = np.floor(places / self.side).astype(np.int64)
        inside = ((cell >= self.low) & (cell <= self.high)).all(axis=1)
        left = np.flatnonzero(inside)
        for ring in range(RINGS):
            of, k = self._ring(cell[left], ring)
            of = left[of]
            d, found = self._off(k, places[of], rooted)
            of, k, d, found = (np.concatenate(x) for x in ((left, of), (segment[left], k), (off[left], d), (on[left], found)))
            order = np.lexsort((k, d, of))
            first = order[np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))] if len(order) else order
            segment[of[first]], off[of[first]], on[of[first]] = k[first], d[first], found[first]
            safe = ring * self.side * (1 - 1e-9)
            left = left[off[left] >= (safe if rooted else safe**2)]
        for n in [*np.flatnonzero(~inside).tolist(), *left.tolist()]:
            segment[n], on[n] = self.nearest(tuple(places[n].tolist()), rooted)
            off[n] = self._off(segment[n : n + 1], places[n : n + 1], rooted)[0][0]

    def _ring(self, cell: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments in the cells of a ring around each of the cells, and of which."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for dy in range(-ring, ring + 1):
            y = cell[:, 0] + dy
            for x0, x1 in [(-ring, ring)] if abs(dy) == ring else [(-ring, -ring), (ring, ring)]:
                x0, x1 = np.maximum(cell[:, 1] + x0, self.low[1]), np.minimum(cell[:, 1] + x1, self.high[1])
                of = np.flatnonzero((y >= self.low[0]) & (y <= self.high[0]) & (x0 <= x1))
                row = (y[of] - self.low[0]) * self.wide - self.low[1]
                a, b = self.first[np.searchsorted(self.cells, row + x0[of])], self.first[np.searchsorted(self.cells, row + x1[of] + 1)]
                which, nth = runs(b - a)
                parts.append((of[which], self.segments[a[which] + nth].astype(np.int64)))
        of, k = (np.concatenate(x) for x in zip(*parts))
        return of, k

    def nearest(self, place: Place, rooted: bool = False) -> tuple[int, Place]:
        """The first of the nearest segments, and the place on it; rooted, those count as equally near whose distance is rounded to the same."""
        y, x = math.floor(place[0] / self.side), math.floor(place[1] / self.side)
        ring = max(0, *(l - c for l, c in zip(self.low, (y, x))), *(c - h for h, c in zip(self.high, (y, x))))
        seen: set[int] = set()
        best: tuple[float, int, Place] | None = None
        while True:
            new: set[int] = set()
            for i in range(max(y - ring, self.low[0]), min(y + ring, self.high[0]) + 1):
                spans = [(x - ring, x + ring)] if i in (y - ring, y + ring) or not ring else [(x - ring, x - ring), (x + ring, x + ring)]
                for x0, x1 in spans:
                    x0, x1 = max(x0, self.low[1]), min(x1, self.high[1])
                    if x0 <= x1:
                        new.update(self._in(i, x0, x1))
            if new := new - seen:
                seen |= new
                k = np.array(sorted(new))
                off, found = self._off(k, np.array(place), rooted)
                n = int(off.argmin())
                best = min(best or (math.inf, 0, place), (float(off[n]), int(k[n]), (float(found[n, 0]), float(found[n, 1]))))
            safe = ring * self.side * (1 - 1e-9)
            if best and best[0] < (safe if rooted else safe**2) or len(seen) == len(self.starts):
                return best[1], best[2]
            ring += 1


class RoadNet:
    """A design's roads: edges(u, v, length_m, line of struct<lon, lat> from u to v), of parallel ones the shortest.

    All is held in arrays.  Nodes are numbered in the order of their ids, edges in that of their ends,
    the smaller first, and lines go that way by ``first``, ``counts`` and ``turn``.
    """

    def __init__(self, edges: pa.Table, step: int = 1 << 16) -> None:
        u, v = (edges.column(c).to_numpy() for c in ("u", "v"))
        ids = np.unique(np.concatenate([np.unique(u), np.unique(v)]))
        u, v = (np.searchsorted(ids, x).astype(np.int32) for x in (u, v))
        counts = pc.fill_null(pc.list_value_length(edges.column("line")), 0).to_numpy().astype(np.int32)
        if len(u) and not counts.min():
            raise ValueError("an edge needs a line of one point at least")
        self.points = self._points(edges.column("line"), int(counts.sum()))
        first = np.cumsum(counts, dtype=np.int32) - counts
        self.place = np.empty((len(ids), 2))
        for k in range(0, len(u), step):  # of different places of a node the last edge's counts
            part = slice(k, k + step)
            at = np.column_stack([first[part], first[part] + counts[part] - 1]).ravel()
            self.place[np.column_stack([u[part], v[part]]).ravel()] = self.points[at]
        size = pc.fill_null(edges.column("length_m").cast(pa.float64()), math.inf).to_numpy()
        size = np.where(np.isnan(size), math.inf, size)
        back = u >= v  # a loop's line goes backwards too
        order = np.lexsort((size, np.maximum(u, v), np.minimum(u, v)))
        low, high = np.minimum(u, v)[order], np.maximum(u, v)[order]
        kept = np.ones(len(order), bool)
        kept[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        order, self.u, self.v = order[kept], low[kept], high[kept]
        size, self.counts, self.turn = size[order], counts[order], np.where(back, -1, 1).astype(np.int32)[order]
        self.first = np.where(back, first + counts - 1, first)[order]
        self.owner, self.nth = runs(self.counts - 1)
        begins = self.first[self.owner] + self.turn[self.owner] * self.nth
        self.cells = SegmentCells(self.points[begins], self.points[begins + self.turn[self.owner]])
        led = np.flatnonzero((self.u != self.v) & (size < math.inf))
        self.part = self._parts(self.u[led], self.v[led])
        self._ways(led, size[led])
        self.searches: OrderedDict[int, Search] = OrderedDict()

    @staticmethod
    def _points(lines: pa.ChunkedArray, many: int) -> np.ndarray:
        """The places of all lines, one after another."""
        out, n = np.empty((many, 2)), 0
        for chunk in lines.chunks:
            flat = chunk.flatten()
            own = dict(zip((f.name for f in flat.type), flat.flatten()))
            for k, c in enumerate(("lat", "lon")):
                out[n : n + len(flat), k] = own[c].to_numpy(zero_copy_only=False)
            n += len(flat)
        return out

    def _parts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For each node, the smallest node of its connected part."""
        part = np.arange(len(self.place), dtype=np.int32)
        if len(u):
            moved = joined_up(pa.table({"u": u, "v": v}))
            part[moved.column("node").to_numpy()] = moved.column("root").to_numpy()
        return part

    def _ways(self, led: np.ndarray, size: np.ndarray) -> None:
        """The nodes and lengths at each node, and the edges they are of."""
        ends = np.concatenate([self.u[led], self.v[led]])
        order = np.argsort(ends, kind="stable")
        self.at = compact(np.append(0, np.cumsum(np.bincount(ends, minlength=len(self.place)))), "i")
        self.to = compact(np.concatenate([self.v[led], self.u[led]])[order], "i")
        self.size, self.edge = compact(np.tile(size, 2)[order], "d"), compact(np.tile(led, 2)[order], "i")

    def ways(self) -> Ways:
        """The same as arrays for searches side by side."""
        first, to = (np.frombuffer(x, np.int32).astype(np.int64) for x in (self.at, self.to))
        searches = min(MOST_SEARCHES, max(2, SIDE_BY_SIDE // len(self.place)))
        return Ways(first, to, np.frombuffer(self.size), searches)

    def distance(self, source: int, target: int) -> float | None:
        """Along the roads, None if they don't lead there; a search goes no further than it must."""
        if self.part[source] != self.part[target]:
            return None
        if source not in self.searches:
            while len(self.searches) > 1 and (len(self.searches) + 1) * len(self.place) > SEARCHED:
                self.searches.popitem(last=False)
            self.searches[source] = Search(self.at, self.to, self.size, source)
        self.searches.move_to_end(source)
        return self.searches[source].reach(target)

    def own(self, edge: int) -> list[Place]:
        """The places of an edge's line, from its smaller end."""
        at = self.first[edge] + self.turn[edge] * np.arange(self.counts[edge])
        return list(map(tuple, self.points[at].tolist()))

    def between(self, u: int, v: int) -> list[Place]:
        """The places of the line from a node to a neighbour."""
        own = self.own(next(self.edge[e] for e in range(self.at[u], self.at[u + 1]) if self.to[e] == v))
        return own if u < v else own[::-1]

    def along(self, edge: int, segment: int, place: Place, node: int) -> list[Place]:
        """Vertices from a place on an edge to one of its nodes."""
        own = self.own(edge)
        return [place, *own[segment + 1 :]] if node == self.v[edge] and self.u[edge] != self.v[edge] else [place, *own[segment::-1]]

    def snap(self, place: Place) -> tuple[Place, int, int]:
        """The nearest place on a road (planar), its edge and the segment of the edge's line."""
        k, found = self.cells.nearest(place)
        return found, int(self.owner[k]), int(self.nth[k])

    def route(self, a: Place, b: Place, start: tuple[Place, int, int] | None = None) -> list[Place] | None:
        """From a over the roads to b: the shortest of the ways that leave and enter at either end of the edges.

        Places on one edge are joined along it.  None if the roads don't connect them.  ``start`` is where a snaps to, if known.
        """
        if not len(self.owner):
            return None
        (p, edge, k), (q, other, j) = start or self.snap(a), self.snap(b)
        if edge == other:
            own = self.own(edge)
            inner = own[k + 1 : j + 1] if (k, math.dist(own[k], p)) <= (j, math.dist(own[j], q)) else own[k:j:-1]
            return without_repeats([a, p, *inner, q, b])
        best: tuple[float, int, int] | None = None
        for s in dict.fromkeys((int(self.u[edge]), int(self.v[edge]))):
            for e in dict.fromkeys((int(self.u[other]), int(self.v[other]))):
                if (inner := self.distance(s, e)) is not None:
                    total = float(metres(*p, *self.place[s].tolist())) + inner + float(metres(*q, *self.place[e].tolist()))
                    if best is None or total < best[0]:
                        best = (total, s, e)
        if best is None:
            return None
        _, s, e = best
        way = self.searches[s].way(e)
        path = [a, *self.along(edge, k, p, s)]
        for u, v in zip(way, way[1:]):
            path += self.between(u, v)
        return without_repeats([*path, *reversed(self.along(other, j, q, e)), b])


def without_repeats(path: list[Place]) -> list[Place]:
    return [p for k, p in enumerate(path) if not k or p != path[k - 1]]


class Pieces:
    """Lines put together of stretches of a net's points, and of places of their own."""

    def __init__(self, net: RoadNet) -> None:
        self.net = net
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.own: list[np.ndarray] = []
        self.many = 0

    def add(self, of: np.ndarray, rank: int, start: np.ndarray, step: np.ndarray, count: np.ndarray, nth: np.ndarray | None = None) -> None:
        """For lines ``of`` the points from ``start`` on by ``step``; a line's pieces come by rank, then ``nth``."""
        self.parts.append((of, np.full(len(of), rank), np.zeros(len(of), np.int64) if nth is None else nth, start.astype(np.int64), step.astype(np.int64), count.astype(np.int64)))

    def place(self, of: np.ndarray, rank: int, places: np.ndarray) -> None:
        self.add(of, rank, -1 - self.many - np.arange(len(of)), np.ones(len(of), np.int64), np.ones(len(of), np.int64))
        self.own.append(places)
        self.many += len(of)

    def edge(self, of: np.ndarray, rank: int, edge: np.ndarray, begin: np.ndarray, end: np.ndarray, nth: np.ndarray | None = None) -> None:
        """Of the edges' lines, each from its smaller end, the points from ``begin`` to ``end``, which is in it, either way."""
        first, turn = self.net.first[edge].astype(np.int64), self.net.turn[edge].astype(np.int64)
        self.add(of, rank, first + turn * begin, np.where(end >= begin, turn, -turn), np.abs(end - begin) + 1, nth)

    def lines(self, many: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and places of so many lines, without those that repeat the place before; lines in ``whole`` keep them."""
        of, rank, nth, start, step, count = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((nth, rank, of))
        of, start, step, count = (x[order] for x in (of, start, step, count))
        piece, nth = runs(count)
        line, at = of[piece], start[piece] + step[piece] * nth
        out, own = np.empty((len(at), 2)), at < 0
        out[~own] = self.net.points[at[~own]]
        out[own] = np.concatenate(self.own)[-1 - at[own]]
        kept = np.ones(len(out), bool)
        kept[1:] = (line[1:] != line[:-1]) | (out[1:] != out[:-1]).any(axis=1) | whole[line[1:]]
        return np.bincount(line[kept], minlength=many), out[kept]


def laid(net: RoadNet, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Routes of ends(lat1, lon1, lat2, lon2), some at a time: which of them, whether by road, counts and places of their lines.

    They are those of :meth:`RoadNet.route`.  All that start at the same edges are searched for side by side.
    """
    placed = ~np.isnan(ends).any(axis=1) if len(net.owner) else np.zeros(len(ends), bool)
    known = np.flatnonzero(placed)
    edge, part, at = np.full((len(ends), 2), -1, np.int64), np.zeros((len(ends), 2), np.int64), np.full((len(ends), 2, 2), np.nan)
    for side in (0, 1):
        places, which = np.unique(ends[known][:, 2 * side : 2 * side + 2], axis=0, return_inverse=True) if len(known) else (ends[:0, :2], known)
        k, _, on = net.cells.nearest_of_all(places) if len(known) else (known, None, ends[:0, :2])
        edge[known, side], part[known, side], at[known, side] = net.owner[k[which]], net.nth[k[which]], on[which]
    order = np.lexsort((np.arange(len(ends)), edge[:, 0]))
    ways = net.ways() if len(known) else None
    nodes = len(net.place)
    beside = len(ways.dist) // nodes if ways else 1
    # Sets of cables: those of start edges that have so many nodes together.
    begins = np.flatnonzero(np.append(True, edge[order[1:], 0] != edge[order[:-1], 0])) if len(order) else order
    size = max(1, beside // 2)
    for b in range(0, len(begins), size):
        mine = order[begins[b] : begins[b + size] if b + size < len(begins) else len(order)]
        for chunk in range(0, len(mine), 1 << 14):
            yield _laid(net, ways, ends, edge, part, at, mine[chunk : chunk + (1 << 14)])


def _laid(net: RoadNet, ways: Ways | None, ends: np.ndarray, edge: np.ndarray, part: np.ndarray, at: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pieces, by_road = Pieces(net), edge[mine, 0] >= 0
    edge, part, at, ends = edge[mine], part[mine], at[mine], ends[mine]
    same = np.flatnonzero(by_road & (edge[:, 0] == edge[:, 1]))
    k, j = part[same, 0], part[same, 1]
    inner = k != j
    pieces.edge(same[inner], 2, edge[same[inner], 0], np.where(k < j, k + 1, k)[inner], np.where(k < j, j, j + 1)[inner])
    far = np.flatnonzero(by_road & (edge[:, 0] != edge[:, 1]))
    if len(far):
        # The nodes at either end: of each cable the starts and the targets of its four ways.
        s, e = (np.stack([net.u[edge[far, n]], net.v[edge[far, n]]], axis=1).astype(np.int64) for n in (0, 1))
        sources, search = np.unique(s, return_inverse=True)
        search = search.reshape(s.shape)
        s4, e4, search4 = s[:, [0, 0, 1, 1]], e[:, [0, 1, 0, 1]], search[:, [0, 0, 1, 1]]
        joined = net.part[s4] == net.part[e4]
        numbers = search4 * ways.nodes + e4
        starts = np.arange(len(sources)) * ways.nodes + sources
        ways.dist[starts] = 0.0
        of, asked = search4[joined], numbers[joined]
        grouped = np.argsort(of, kind="stable")
        of, asked = of[grouped], asked[grouped]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of

        def limits() -> np.ndarray:
            out = np.full(len(sources), -1.0)
            if len(of):
                out[of[first]] = np.maximum.reduceat(ways.dist[asked], first)
            return out

        reached = ways.spread(starts, limits)
        within, sound = np.where(joined, ways.dist[numbers], np.inf), ways.sound(reached)
        total = metres(at[far, 0, 0, None], at[far, 0, 1, None], *np.moveaxis(net.place[s4], 2, 0)) + within + metres(at[far, 1, 0, None], at[far, 1, 1, None], *np.moveaxis(net.place[e4], 2, 0))
        best = total.argmin(axis=1)
        row = np.arange(len(far))
        led = total[row, best] < np.inf
        by_road[far[~led]] = False
        row, best, far = row[led], best[led], far[led]
        if sound:
            which, way = ways.back(numbers[row, best])
            ways.clear(reached)
            walked = np.frombuffer(net.edge, np.int32)[way]
            # A way is listed at the node that it is walked to.
            forth = ways.to[way] == net.u[walked]
            last = net.counts[walked] - 1
            pieces.edge(far[which], 3, walked, np.where(forth, 0, last), np.where(forth, last, 0), np.arange(len(which)))
        else:
            ways.clear(reached)
            for n, a, b in zip(far.tolist(), s4[row, best].tolist(), e4[row, best].tolist()):
                if net.distance(a, b) is None:
                    raise ValueError("ends of one part of the roads lead to each other")
                path = net.searches[a].way(b)
                line = np.array([x for u, v in zip(path, path[1:]) for x in net.between(u, v)]).reshape(-1, 2)
                for m in range(len(line)):
                    pieces.place(np.array([n]), 3, line[m : m + 1])
                    pieces.parts[-1][2][:] = m
        a, b, k, j = edge[far, 0], edge[far, 1], part[far, 0], part[far, 1]
        out, back = s4[row, best], e4[row, best]
        end = np.where((out == net.v[a]) & (net.u[a] != net.v[a]), net.counts[a] - 1, 0)
        pieces.edge(far, 2, a, np.where(end > 0, k + 1, k), end)
        end = np.where((back == net.v[b]) & (net.u[b] != net.v[b]), net.counts[b] - 1, 0)
        pieces.edge(far, 4, b, end, np.where(end > 0, j + 1, j))
    every, on_roads = np.arange(len(mine)), np.flatnonzero(by_road)
    pieces.place(every, 0, ends[:, :2])
    pieces.place(on_roads, 1, at[on_roads, 0])
    pieces.place(on_roads, 5, at[on_roads, 1])
    pieces.place(every, 6, ends[:, 2:])
    return mine, by_road, *pieces.lines(len(mine), ~by_road)


def routed(cables: DataFrame, edges: DataFrame, design: str) -> DataFrame:
    """``cables``(design, lat1, lon1, lat2, lon2, ...) with coords (array of struct<lon, lat>) and by_road.

    edges(design, u, v, length_m, line); where the roads don't lead from end to end a cable is a straight line.  A
    design's cables and roads are one grouped task, which holds them in arrays: ends are looked up in a grid of the road
    segments, many at a time, and cables are taken in the order of the edges they start at, with searches from several
    nodes side by side that stop at their targets.
    """
    shown = ["lat1", "lon1", "lat2", "lon2"]
    schema = f"{cables.schema.simpleString()[7:-1]}, coords array<struct<lon: double, lat: double>>, by_road boolean"
    names, roads = cables.columns, edges.select(design, "u", "v", "length_m", "line")

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        net = RoadNet(own if rows.num_rows else own.slice(0, 0))
        del own
        ends = np.column_stack([rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(float) for c in shown])
        found = list(laid(net, ends))
        order, by_road, counts, places = (np.concatenate(x) if x else np.empty(0) for x in (zip(*found) if found else [()] * 4))
        places = places.reshape(-1, 2)
        values = pa.StructArray.from_arrays([pa.array(places[:, c], from_pandas=True) for c in (1, 0)], ["lon", "lat"])
        coords = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)
        out = rows.select(names).take(pa.array(order, pa.int64()))
        return out.append_column("coords", coords).append_column("by_road", pa.array(by_road.astype(bool), pa.bool_()))

    return by_design(cables, design).cogroup(by_design(roads, design)).applyInArrow(run, schema)


def on_roads(sites: DataFrame, edges: DataFrame, design: str, widest: float = 1.0) -> DataFrame:
    """``sites``(design, lat, lon, ...) moved to the nearest place on a road of their design, and on_road.

    edges(design, u, v, key, line).  Nearest is planar, of equally near segments the first of :func:`roads.segments`;
    sites without a road within ``widest`` degrees, or without coordinates, stay.  These are the places that
    :func:`spatial.nearest_on_roads` finds, looked up by design: a design's sites and roads are one grouped task.
    """
    names, lines = sites.columns, edges.select(design, "u", "v", "key", "line")

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        places = np.column_stack([rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon")])
        known, moved = np.flatnonzero(~np.isnan(places).any(axis=1)), np.zeros(len(places), bool)
        if len(known) and len((cells := segment_cells(own)).starts):
            _, off, on = cells.nearest_of_all(places[known], rooted=True)
            within = off <= widest
            places[known[within]], moved[known[within]] = on[within], True
        out = {c: rows.column(c) for c in names}
        out |= {c: pa.array(places[:, n], from_pandas=True) for n, c in enumerate(("lat", "lon"))}
        return pa.table(out | {"on_road": pa.array(moved)})

    return by_design(sites, design).cogroup(by_design(lines, design)).applyInArrow(run, f"{sites.schema.simpleString()[7:-1]}, on_road boolean")


def segment_cells(edges: pa.Table) -> SegmentCells:
    """The straight parts of the lines of edges(u, v, key, line) in the order of their ends, keys and places, each from its smaller end."""
    u, v, key = (pc.fill_null(edges.column(c).cast(pa.int64()), -1).to_numpy() for c in ("u", "v", "key"))
    counts = pc.fill_null(pc.list_value_length(edges.column("line")), 0).to_numpy().astype(np.int64)
    points = RoadNet._points(edges.column("line"), int(counts.sum()))
    order = np.lexsort((key, np.maximum(u, v), np.minimum(u, v)))
    back, first = u > v, np.cumsum(counts) - counts
    first, turn = np.where(back, first + counts - 1, first)[order], np.where(back, -1, 1)[order]
    owner, nth = runs(np.maximum(counts - 1, 0)[order])
    begins = first[owner] + turn[owner] * nth
    return SegmentCells(points[begins], points[begins + turn[owner]])


def regenerated(segments: DataFrame, edges: DataFrame, design: str, seed: int) -> DataFrame:
    """Feeder segments(design, i, from_label, to_label, coords) of kept order, routed anew over noisy lengths."""
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    ends = segments.select(design, "i", "from_label", "to_label", first.lat.alias("lat1"), first.lon.alias("lon1"), last.lat.alias("lat2"), last.lon.alias("lon2"))
    return routed(ends, noisy(edges, seed), design).drop("lat1", "lon1", "lat2", "lon2")
