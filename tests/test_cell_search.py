"""Searches within a cell take many nodes at a time, and find what a search node by node finds."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from strandplan.operators import regions, roads


def cell_of(seed, lengths, wide=12):
    """A cell's edges as they are packed: its own number is 3, some ways lead out to cells 4 and 5."""
    rng = random.Random(seed)
    rows = []
    for n in range(wide * wide):
        rows += [(3, n * 10, m * 10, rng.choice(lengths), 3) for m in [n + 1] * (n % wide < wide - 1) + [n + wide] * (n < wide * (wide - 1)) if rng.random() < 0.8]
        rows += [(3, n * 10, 7000 + rng.randrange(15), rng.choice(lengths), rng.choice([4, 5])) for _ in range(rng.random() < 0.2)]
    rows = [(c, u, v, float(d), 4 + v % 2 if to != 3 else 3) for c, u, v, d, to in rows]
    return rows, pa.table([pa.array(x) for x in zip(*rows)], ["cell", "u", "v", "length_m", "to_cell"])


def plain(rows, starts):
    around = {}
    for _, u, v, d, to in rows:
        around.setdefault(u, []).append((v, d, to))
        if to == 3:
            around.setdefault(v, []).append((u, d, to))
    best, out, queue = {}, {}, list(starts)
    heapq.heapify(queue)
    while queue:
        d, via, n = heapq.heappop(queue)
        if n in best:
            continue
        best[n] = (d, via)
        for v, size, to in around.get(n, ()):
            if to == 3:
                if v not in best:
                    heapq.heappush(queue, (d + size, n, v))
            elif v not in out or (d + size, n) < out[v][:2]:
                out[v] = (d + size, n, to)
    return best, out


@pytest.mark.parametrize("seed, lengths, fast", [(1, (50, 75, 100), True), (2, (50, 50, 51), True), (3, (0.1, 0.2, 0.7, 1300.0), True), (4, (0, 0, 50), False)])
def test_a_cell_equals_a_plain_search(seed, lengths, fast, monkeypatch):
    if fast:
        monkeypatch.setattr(roads, "_node_by_node", None)
    rows, table = cell_of(seed, lengths)
    packed = roads._packed(table)
    assert packed.num_rows == 1 and packed.column("cell").to_pylist() == [3]
    own = {c: np.frombuffer(packed.column(c)[0].as_buffer(), kind) for c, kind in roads.PACKED.items()}
    starts = [(0.0, -1, 0), (100.0, 7001, 500), (100.0, 5, 510), (40.0, 7003, 99999), (1e6, 2, 20)]
    node, dist, via, lone = roads._from_starts(*(np.array(x) for x in zip(*starts)), own)
    best, out = plain(rows, starts)
    assert [x.tolist() for x in lone] == [[99999], [40.0], [7003]]
    del best[99999]
    assert {int(n): (d, v) for n, d, v in zip(node, dist, via) if d < np.inf} == best
    assert {n: (d, v, c) for c, n, d, v in zip(*(x.tolist() for x in roads._leaving(dist, own)))} == out and out


def test_levels_below_the_first_count(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(n, rng.random() if n % 3 else 0.5 + rng.random() / 5000, rng.random() if n % 3 else 0.5 + rng.random() / 5000) for n in range(3000)] + [(5000 + n, 0.1, 0.1) for n in range(40)]
    coded = regions.placed(spark.createDataFrame(rows, "node long, lat double, lon double"), 0.0, 0.0, 1.0, 1.0)
    tree = {(r.level, r.prefix): r.nodes for r in regions.quadtree(coded, 20).collect()}
    codes, wanted = [r.code for r in coded.collect()], {}

    def cut(level, inside):
        if len(inside) <= 20 or level == regions.DEEPEST:
            wanted[level, inside[0] >> 2 * (regions.DEEPEST - level)] = len(inside)
            return
        parts = {}
        for c in inside:
            parts.setdefault(c >> 2 * (regions.DEEPEST - level - 1), []).append(c)
        for part in parts.values():
            cut(level + 1, part)

    cut(0, codes)
    assert tree == wanted and max(level for level, _ in tree) == regions.DEEPEST and any(level < regions.HALFWAY for level, _ in tree)
