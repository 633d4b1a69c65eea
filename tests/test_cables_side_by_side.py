"""Cables of a design are searched for many at a time, and are those that are found one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandplan.operators import cables

KIND = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))


def net_of(seed, wide=14, lengths=(50.0, 50.0, 75.0, 100.0, None)):
    """A lattice of few different lengths, so that many ways are equally long; with bends, loops, parallel edges and gaps."""
    rng = random.Random(seed)
    rows = []
    for u in range(wide * wide):
        for v in [u + 1] * (u % wide < wide - 1) + [u + wide] * (u < wide * (wide - 1)) + [u] * (rng.random() < 0.05):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                a, b = (float(u // wide), float(u % wide)), (float(v // wide), float(v % wide))
                line = [a, *[(a[0] + rng.random(), a[1] + rng.random()) for _ in range(rng.choice([0, 0, 2]) + 2 * (u == v))], b]
                turned = rng.random() < 0.5
                rows.append((v if turned else u, u if turned else v, rng.choice(lengths), line[::-1] if turned else line))
    lines = pa.array([[{"lon": x, "lat": y} for y, x in line] for *_, line in rows], KIND)
    table = pa.table({"u": [r[0] for r in rows], "v": [r[1] for r in rows], "length_m": pa.array([r[2] for r in rows], pa.float64()), "line": lines})
    ends = np.array([[rng.uniform(-2, wide + 1) for _ in range(4)] for _ in range(150)])
    ends[100:, 2:] = ends[100:, :2] + 0.1  # short ones, some along one edge
    ends[120:130, :2] = ends[120, :2]
    ends[0, 0] = np.nan
    return table, ends


def found(net, ends):
    out = {}
    for which, by_road, counts, places in cables.laid(net, ends):
        for n, road, line in zip(which.tolist(), by_road.tolist(), np.split(places, np.cumsum(counts)[:-1])):
            out[n] = (road, [tuple(p) for p in line.tolist()])
    return out


def expected(net, ends):
    out = {}
    for n, (y, x, q, p) in enumerate(ends.tolist()):
        path = None if n == 0 else net.route((y, x), (q, p))
        out[n] = (path is not None, path or [(y, x), (q, p)])
    return out


@pytest.mark.parametrize("seed, room", [(1, 1 << 22), (2, 1), (3, 2000)])
def test_equal_to_one_by_one(seed, room, monkeypatch):
    monkeypatch.setattr(cables, "SIDE_BY_SIDE", room)
    table, ends = net_of(seed)
    wanted = expected(cables.RoadNet(table), ends)
    monkeypatch.setattr(cables, "Search", None)  # no search node by node
    got = found(cables.RoadNet(table), ends)
    assert repr(got[0]) == repr(wanted[0]) and {n: got[n] for n in range(1, len(ends))} == {n: wanted[n] for n in range(1, len(ends))}
    assert sum(road for road, _ in got.values()) > 100


def test_lengths_of_nothing_go_node_by_node():
    table, ends = net_of(4, lengths=(0.0, 0.0, 50.0))
    got, wanted = (f(cables.RoadNet(table), ends) for f in (found, expected))
    assert {n: got[n] for n in range(1, len(ends))} == {n: wanted[n] for n in range(1, len(ends))}


def test_no_roads_and_no_cables():
    table, ends = net_of(5)
    straight = found(cables.RoadNet(table.slice(0, 0)), ends[1:3])
    assert [r for r, _ in straight.values()] == [False, False] and straight[0][1] == [tuple(ends[1, :2]), tuple(ends[1, 2:])]
    assert not list(cables.laid(cables.RoadNet(table), ends[:0]))


@pytest.mark.parametrize("rooted", [False, True])
def test_ends_are_looked_up_together(rooted):
    table, ends = net_of(6)
    cells = cables.RoadNet(table).cells
    places = np.vstack([ends[1:, :2], ends[1:, 2:], np.round(ends[1:60, :2]), [[-400.0, 3.0], [5.0, 900.0], [0.0, 0.0]]])
    segment, off, on = cells.nearest_of_all(places, rooted, step=70)
    for n, place in enumerate(places.tolist()):
        k, found = cells.nearest(tuple(place), rooted)
        leg = cells.ends - cells.starts
        share = np.clip(((place - cells.starts) * leg).sum(axis=1) / np.maximum((leg**2).sum(axis=1), 1e-300), 0, 1)
        assert (k, found) == (segment[n], tuple(on[n]))
        least = float(((cells.starts + share[:, None] * leg - place) ** 2).sum(axis=1).min())
        assert (off[n] ** 2 if rooted else off[n]) == pytest.approx(least)
