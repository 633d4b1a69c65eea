"""Shortest ways over roads that are held in arrays, many nodes and many searches at a time.

``first``, ``to`` and ``size`` are the ways at each node: node n has those from first[n] to first[n + 1].  Of several searches
side by side node n of search s is number s * nodes + n.  Distances are sums along the way from the start, so they are
those that a search node by node finds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of so many elements: which run each element is of, and its place in the run."""
    of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return of, np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)


class Ways:
    """The ways at each node, and room for so many searches side by side."""

    def __init__(self, first: np.ndarray, to: np.ndarray, size: np.ndarray, searches: int = 1) -> None:
        self.first, self.to, self.size = first, to, size
        self.nodes, self.count = len(first) - 1, np.diff(first)
        self.least = float(size.min()) if len(size) else np.inf
        self.stride = max(self.least, float(size.mean()) / 2) if len(size) else 1.0
        self.dist = np.full(searches * self.nodes, np.inf)
        self.waiting = np.zeros(searches * self.nodes, bool)
        self.mark = np.empty(searches * self.nodes, np.int32)

    def _at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ways of each node, one after another: how many, which, and the numbers of the nodes they lead to."""
        node = numbers % self.nodes
        begin, count = self.first.take(node), self.count.take(node)
        ends = np.cumsum(count)
        way = np.repeat(begin - ends + count, count)
        way += np.arange(len(way))
        to = self.to.take(way)
        to += np.repeat(numbers - node, count)
        return count, way, to

    def spread(self, starts: np.ndarray, limits: Callable[[], np.ndarray] | None = None, every: int = 8) -> np.ndarray:
        """Fills ``dist`` from the starts, whose own is set, and returns all numbers that were reached.

        All nodes less than a stride beyond the nearest waiting one are taken at once; a node that gets nearer later waits
        again, so the stride changes no result.  Now and then ``limits`` is asked how far each search has to go;
        distances up to there are final.
        """
        dist, waiting, mark = self.dist, self.waiting, self.mark
        reached, front, turn = [starts], starts, 0
        waiting[front] = True
        while len(front):
            if limits is not None and turn % every == 0:
                kept = dist[front] <= limits()[front // self.nodes]
                waiting[front[~kept]] = False
                front = front[kept]
                if not len(front):
                    break
            turn += 1
            away = dist.take(front)
            near = away <= away.min() + self.stride
            now, away, front = front[near], away[near], front[~near]
            waiting[now] = False
            count, way, nodes = self._at(now)
            total = self.size.take(way)
            total += np.repeat(away, count)
            better = np.flatnonzero(total < dist.take(nodes))
            nodes, total = nodes.take(better), total.take(better)
            np.minimum.at(dist, nodes, total)
            nodes = nodes[~waiting.take(nodes)]
            mark[nodes] = order = np.arange(len(nodes), dtype=np.int32)
            nodes = nodes[mark.take(nodes) == order]
            waiting[nodes] = True
            reached.append(nodes)
            front = np.concatenate([front, nodes])
        return np.concatenate(reached)

    def sound(self, reached: np.ndarray) -> bool:
        """Whether every way is longer than rounding loses, so that the node before is nearer than the node."""
        return self.least > float(self.dist[reached].max(initial=0.0)) * 1e-15

    def back(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ways from the starts to the numbers: of which of them, and the way as it is listed at the node it leads to.

        Of several nodes before one the smallest is taken.  Ways of one number are in their order.
        """
        of, at = np.arange(len(numbers)), numbers
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            count, way, nodes = self._at(at)
            has = count > 0
            of, at, count = of[has], at[has], count[has]
            tight = self.dist[nodes] + self.size[way] == np.repeat(self.dist[at], count)
            before = np.where(tight, nodes, np.iinfo(np.int64).max)
            if len(at):
                least = np.minimum.reduceat(before, np.cumsum(count) - count)
                chosen = np.flatnonzero(tight & (before == np.repeat(least, count)))
                going = least < np.iinfo(np.int64).max
                of, at = of[going], least[going]
                found.append((of, way[chosen]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whose, ways = (np.concatenate(x[::-1]) for x in zip(*found))
        order = np.argsort(whose, kind="stable")
        return whose[order], ways[order]

    def clear(self, reached: np.ndarray) -> None:
        self.dist[reached] = np.inf
