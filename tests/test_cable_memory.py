"""A design's roads are held in arrays, so that many designs' nets fit beside each other."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strandplan.operators import cables


def lattice(w):
    at = np.arange(w * w)
    right, up = at[at % w < w - 1], at[at < w * (w - 1)]
    ends = [(int(u), int(v)) for u, v in zip(np.concatenate([right, up]), np.concatenate([right + 1, up + w]))]
    lines = [[{"lon": float(n % w), "lat": float(n // w)} for n in e] for e in ends]
    kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    return pa.table({"u": [u for u, _ in ends], "v": [v for _, v in ends], "length_m": [1.0] * len(ends), "line": pa.array(lines, kind)})


def test_net_is_small():
    edges = lattice(150)
    tracemalloc.start()
    net = cables.RoadNet(edges)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 300 * edges.num_rows and peak < 700 * edges.num_rows
    path = net.route((0.2, 0.0), (3.0, 2.8))
    assert len(path) == 7 + 2 and path[0] == (0.2, 0.0) and path[-1] == (3.0, 2.8)


def test_few_searches_are_kept(monkeypatch):
    monkeypatch.setattr(cables, "SEARCHED", 3 * 400)
    net = cables.RoadNet(lattice(20))
    for n in range(0, 400, 7):
        assert net.distance(n, 399) == (19 - n % 20) + (19 - n // 20)
        assert len(net.searches) <= 3


def test_turned_and_parallel_edges():
    kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    lines = [[(0, 0), (1, 1), (2, 0)], [(2, 0), (1, -1), (0, 0)], [(2, 0), (2, 2)]]
    placed = pa.array([[{"lon": float(x), "lat": float(y)} for x, y in line] for line in lines], kind)
    net = cables.RoadNet(pa.table({"u": [1, 2, 2], "v": [2, 1, 3], "length_m": [5.0, 4.0, 1.0], "line": placed}))
    assert net.own(0) == [(0.0, 0.0), (-1.0, 1.0), (0.0, 2.0)] and len(net.u) == 2
    assert net.route((-0.5, 0.5), (1.0, 2.0)) == [(-0.5, 0.5), (0.0, 0.0), (-1.0, 1.0), (0.0, 2.0), (1.0, 2.0)]
