"""Indexes of clusters, separation and chains against scans over all sites."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from strandplan.operators import clusters, indexes


def scanned_groups(points, capacity):
    left = list(range(len(points)))
    if len(left) <= capacity:
        return [left] if left else []
    seed, out = random.Random(42).randint(0, len(left) - 1), []
    while left:
        here = points[seed] if not out else points[left[int(np.argmin(np.linalg.norm(points[left] - points[out[-1]].mean(axis=0), axis=1)))]]
        order = np.argsort(np.linalg.norm(points[left] - here, axis=1), kind="stable")[:capacity]
        out.append([left[k] for k in order])
        left = [k for k in left if k not in set(out[-1])]
    return out


def scanned_apart(sites, least, passes=20):
    out = sites.copy()
    for _ in range(passes):
        still = True
        for i, j in itertools.combinations(range(len(out)), 2):
            d = float(clusters.metres(*out[i], *out[j]))
            if d < least:
                out[j] = clusters._moved(*out[i], least, 137.5 * j % 360 if d < 1e-6 else clusters._bearing(*out[i], *out[j]))
                still = False
        if still:
            break
    return out


def every_reversal(start, sites):
    left, order, here = list(range(len(sites))), [], start
    while left:
        order.append(min(left, key=lambda s: math.dist(here, sites[s])))
        left.remove(order[-1])
        here = sites[order[-1]]
    better = len(order) > 2
    while better:
        better = False
        for i in range(len(order) - 1):
            for j in range(i + 1, len(order)):
                other = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if length(start, sites, other) < length(start, sites, order) - 1e-6:
                    order, better = other, True
    return order


def length(start, sites, order):
    path = np.vstack([np.array(start)[None], sites[order]])
    return float(clusters.metres(path[:-1, 0], path[:-1, 1], path[1:, 0], path[1:, 1]).sum())


def places(n, kind, seed=0):
    rng = np.random.default_rng(seed + n)
    out = rng.normal(size=(n, 2)) * 0.003 + (-7.25, 112.75)
    return {"apart": out, "ties": np.round(out, 3), "same": out[:1].repeat(n, axis=0)}[kind]


@pytest.mark.parametrize("kind", ["apart", "ties", "same"])
def test_groups(kind):
    for n, capacity in ((0, 8), (1, 8), (8, 8), (9, 8), (500, 8), (700, 3), (300, 1)):
        p = places(n, kind) if n else np.zeros((0, 2))
        assert [g.tolist() for g in clusters.group_by_capacity(p, capacity)] == scanned_groups(p, capacity)


@pytest.mark.parametrize("kind", ["apart", "ties", "same"])
def test_separation(kind):
    for n, least in ((1, 40.0), (60, 40.0), (120, 5.0), (40, 400.0)):
        assert (clusters.push_apart(places(n, kind), least) == scanned_apart(places(n, kind), least)).all()


@pytest.mark.parametrize("around", [(80.0, 179.9999), (-89.99, 0.0), (0.0, -180.0), (89.9995, 10.0)])
def test_separation_across_the_date_line_and_near_poles(around):
    p = np.random.default_rng(5).normal(size=(40, 2)) * (2e-4, 4e-4) + around
    p[::2, 1] += 360
    assert (clusters.push_apart(p, 40.0, 3) == scanned_apart(p, 40.0, 3)).all()


def test_small_chains_try_every_reversal():
    for n in (1, 2, 3, 10, 25):
        for kind in ("apart", "ties"):
            assert clusters.chain((-7.25, 112.75), places(n, kind)) == every_reversal((-7.25, 112.75), places(n, kind))


def test_long_chains_are_about_as_short_and_visit_all():
    for seed in range(3):
        p, start = places(400, "apart", seed), (-7.26, 112.74)
        near = clusters.chain(start, p, all_pairs=0)
        assert sorted(near) == list(range(400))
        assert length(start, p, near) < 1.05 * length(start, p, clusters.chain(start, p))
    p = places(150, "same")
    assert sorted(clusters.chain((-7.25, 112.75), p, all_pairs=0)) == list(range(150))


def test_tour_reversals():
    rng = random.Random(1)
    tour, plain = indexes.Tour(np.arange(11)), list(range(11))
    for _ in range(300):
        i, j = rng.randrange(11), rng.randrange(11)
        first, last = plain[i], plain[j]
        turned = plain[i:] + plain[:i]
        size = turned.index(last) + 1
        plain = turned[:size][::-1] + turned[size:]
        tour.reverse(first, last)
        at = tour.order.tolist().index(plain[0])
        round_ = tour.order.tolist()[at:] + tour.order.tolist()[:at]
        assert round_ == plain or round_ == plain[:1] + plain[:0:-1]
        if round_ != plain:
            plain = round_
        assert all(tour.after(plain[k - 1]) == plain[k] and tour.before(plain[k]) == plain[k - 1] for k in range(11))


def test_a_large_design_takes_seconds():
    rng = np.random.default_rng(2)
    p = rng.random((60_000, 2)) * 0.2 + (-7.25, 112.75)
    began = time.perf_counter()
    assert sum(map(len, clusters.group_by_capacity(p, 8))) == len(p)
    assert sorted(clusters.chain((-7.25, 112.75), p[:10_000])) == list(range(10_000))
    clusters.push_apart(p[:10_000], 40.0)
    assert time.perf_counter() - began < 60
