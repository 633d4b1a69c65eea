"""Whole designs over roads against a plain restatement: lists, scans over all sites and segments, whole searches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandplan.operators import cables, design, roads, spatial

POP = ("POP/OLT", -7.25, 112.75)
RADIUS = 6371000.0


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(h))


def mean(places):
    return tuple(sum(p[k] for p in places) / len(places) for k in (0, 1))


def grouped(points, capacity):
    left = list(range(len(points)))
    if len(left) <= capacity:
        return [left] if left else []
    seed, out = random.Random(42).randint(0, len(left) - 1), []
    while left:
        if out:
            seed = min(left, key=lambda i: math.dist(points[i], mean([points[j] for j in out[-1]])))
        out.append(sorted(left, key=lambda i: math.dist(points[i], points[seed]))[:capacity])
        left = [i for i in left if i not in out[-1]]
    return out


def on_segment(p, a, b):
    leg = (b[0] - a[0], b[1] - a[1])
    square = leg[0] ** 2 + leg[1] ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * leg[0] + (p[1] - a[1]) * leg[1]) / square)) if square else 0.0
    return (a[0] + t * leg[0], a[1] + t * leg[1])


def snapped(p, edges):
    """(place, edge, part) of the nearest part of any edge; edges: {(u, v): (length, line)} with u < v."""
    found = [(math.dist(p, on_segment(p, a, b)), e, k, on_segment(p, a, b)) for e, (_, line) in sorted(edges.items()) for k, (a, b) in enumerate(zip(line, line[1:]))]
    _, e, k, place = min(found)
    return place, e, k


def apart(sites, least=40.0):
    sites = list(sites)
    for _ in range(20):
        moved = False
        for i in range(len(sites)):
            for j in range(i + 1, len(sites)):
                d = metres(sites[i], sites[j])
                if d < least:
                    (lat1, lon1), (lat2, lon2) = (tuple(map(math.radians, s)) for s in (sites[i], sites[j]))
                    towards = math.atan2(math.sin(lon2 - lon1) * math.cos(lat2), math.cos(lat1) * math.sin(lat2) - math.sin(lat1) * math.cos(lat2) * math.cos(lon2 - lon1))
                    towards = math.radians(137.5 * j % 360) if d < 1e-6 else towards
                    arc = least / RADIUS
                    lat = math.asin(math.sin(lat1) * math.cos(arc) + math.cos(lat1) * math.sin(arc) * math.cos(towards))
                    lon = lon1 + math.atan2(math.sin(towards) * math.sin(arc) * math.cos(lat1), math.cos(arc) - math.sin(lat1) * math.sin(lat))
                    sites[j], moved = (math.degrees(lat), math.degrees(lon)), True
        if not moved:
            break
    return sites


def chained(start, sites):
    left, order, here = list(range(len(sites))), [], start
    while left:
        here_to = min(left, key=lambda i: math.dist(here, sites[i]))
        order.append(here_to)
        left.remove(here_to)
        here = sites[here_to]

    def length(o):
        path = [start, *(sites[i] for i in o)]
        return sum(map(metres, path, path[1:]))

    better = len(order) > 2
    while better:
        better = False
        for i in range(len(order) - 1):
            for j in range(i + 1, len(order)):
                other = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if length(other) < length(order) - 1e-6:
                    order, better = other, True
    return order


def road_metres(a, b, edges):
    """Length of the cable from a to b over the roads, None if they don't lead there."""
    (p, e, k), (q, f, m) = snapped(a, edges), snapped(b, edges)
    if e == f:
        line = edges[e][1]
        inner = line[k + 1 : m + 1] if k <= m else line[m + 1 : k + 1][::-1]
        path = [a, p, *inner, q, b]
        return sum(map(metres, path, path[1:]))
    nodes = {n: line[0 if n == u else -1] for (u, v), (_, line) in edges.items() for n in (u, v)}
    best = None
    for s in e:
        away, via = {s: 0.0}, {}
        for _ in range(len(nodes)):
            for (u, v), (size, _) in edges.items():
                for x, y in ((u, v), (v, u)):
                    if x in away and away[x] + size < away.get(y, math.inf):
                        away[y], via[y] = away[x] + size, x
        for t in f:
            if t in away and (best is None or metres(p, nodes[s]) + away[t] + metres(q, nodes[t]) < best[0]):
                way = [t]
                while way[-1] != s:
                    way.append(via[way[-1]])
                best = (metres(p, nodes[s]) + away[t] + metres(q, nodes[t]), s, t, way[::-1])
    if best is None:
        return None
    _, s, t, way = best

    def ends(edge, part, place, node):
        line = edges[edge][1]
        return [place, *(line[part + 1 :] if node == edge[1] else line[part::-1])]

    path = [a, *ends(e, k, p, s)]
    for x, y in zip(way, way[1:]):
        path += edges[min(x, y), max(x, y)][1][:: 1 if x < y else -1]
    path += [*ends(f, m, q, t)[::-1], b]
    return sum(map(metres, path, path[1:]))


def lattice(rng, wide, missing):
    """{(u, v): (length, line)} over the area, some edges bent, some missing."""
    def place(n):
        return (-7.26 + n // wide * 0.02 / (wide - 1), 112.74 + n % wide * 0.02 / (wide - 1))

    out = {}
    for u in range(wide * wide):
        for v in ([u + 1] if u % wide < wide - 1 else []) + ([u + wide] if u < wide * (wide - 1) else []):
            if rng.random() >= missing:
                a, b = place(u), place(v)
                bend = [((a[0] + b[0]) / 2 + rng.uniform(-4e-4, 4e-4), (a[1] + b[1]) / 2 + rng.uniform(-4e-4, 4e-4))] if rng.random() < 0.4 else []
                out[u, v] = (float(rng.randint(50, 600)), [a, *bend, b])
    return out


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(8)
    nets = {1: lattice(rng, 6, 0.15), 2: lattice(rng, 5, 0.35)}
    homes = {d: [(-7.26 + rng.random() * 0.02, 112.74 + rng.random() * 0.02) for _ in range(n)] for d, n in ((1, 150), (2, 61))}
    homes[2][5:12] = [homes[2][5]] * 7
    rows = [(d, *(e[::-1] if (e[0] + e[1]) % 2 else e), 0, n, [(x, y) for y, x in (line[::-1] if (e[0] + e[1]) % 2 else line)]) for d, net in nets.items() for e, (n, line) in net.items()]
    edges = spark.createDataFrame(rows, "d int, u long, v long, key int, length_m double, line array<struct<lon: double, lat: double>>")
    houses = spark.createDataFrame([(d, h, *p) for d, ps in homes.items() for h, p in enumerate(ps)], "d int, h long, lat double, lon double")
    made = design.full_design(houses, "d", "h", on=design.Roads(edges))
    return nets, homes, made


def test_designs_equal_the_restatement(two):
    nets, homes, made = two
    got = {n: {} for n in made}
    keys = {"odc": ("d", "i"), "odp": ("d", "i", "j"), "house": ("d", "i", "j", "k"), "feeder": ("d", "i"), "distribution": ("d", "i", "j"), "drop": ("d", "i", "j", "k")}
    for n, df in made.items():
        for r in df.collect():
            got[n][tuple(r[c] for c in keys[n])] = r

    def near(a, b):
        return math.dist(a, b) < 1e-9

    cabled, straight = 0, 0
    for d, net in nets.items():
        dealt = grouped(homes[d], 8)
        odps = [snapped(mean([homes[d][h] for h in own]), net)[0] for own in dealt]
        over = grouped(odps, 4)
        odcs = apart([snapped(mean([odps[o] for o in own]), net)[0] for own in over])
        before = POP[1:]
        for i, c in enumerate(chained(POP[1:], odcs), 1):
            r = got["odc"].pop((d, i))
            assert near((r.lat, r.lon), odcs[c]) and r.odps == len(over[c])
            wanted = [(got["feeder"].pop((d, i)), before, odcs[c])]
            for j, o in enumerate(over[c], 1):
                r = got["odp"].pop((d, i, j))
                assert near((r.lat, r.lon), odps[o]) and r.houses == len(dealt[o])
                wanted.append((got["distribution"].pop((d, i, j)), odcs[c], odps[o]))
                for k, h in enumerate(dealt[o], 1):
                    r = got["house"].pop((d, i, j, k))
                    assert (r.lat, r.lon) == homes[d][h]
                    wanted.append((got["drop"].pop((d, i, j, k)), odps[o], homes[d][h]))
            for r, a, b in wanted:
                long = road_metres(a, b, net)
                path = [(p.lat, p.lon) for p in r.coords]
                assert near(path[0], a) and near(path[-1], b) and r.by_road == (long is not None)
                assert sum(map(metres, path, path[1:])) == pytest.approx(metres(a, b) if long is None else long, abs=1e-4)
                cabled, straight = cabled + r.by_road, straight + (not r.by_road)
            before = odcs[c]
    assert not any(got.values()) and cabled > 200


def test_bill_and_map_follow_the_roads(two):
    _, _, made = two
    bill = {(r.d, r.i): r.quantity for r in design.bill_of_materials(made, "d").where("type = 'Kabel Feeder'").collect()}
    for r in made["feeder"].collect():
        path = [(p.lat, p.lon) for p in r.coords]
        assert bill[r.d, r.i] == pytest.approx(sum(map(metres, path, path[1:])), abs=1e-6)
    marks = design.placemarks(made, "d").where("geom_type = 'LineString'")
    lines = made["feeder"].count() + made["distribution"].count() + made["drop"].count()
    assert marks.count() == lines and marks.where(F.size("coords") > 2).count() > lines / 2


def test_nodes_where_no_road_is_in_reach(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0, 5.0, [(0.0, 0.0), (0.0, 0.1)])], "d int, u long, v long, key int, length_m double, line array<struct<lon: double, lat: double>>")
    nodes = spark.createDataFrame([(1, 7, 5.0, 5.0), (2, 8, 3.0, 3.0), (2, 9, 3.0, 3.2)], "d int, node long, lat double, lon double")
    points = spark.createDataFrame([(1, 1, 0.05, 0.002), (1, 2, 0.05, 0.3), (1, 3, 4.0, 4.0), (2, 1, 3.0, 3.11), (3, 1, 1.0, 1.0), (1, 4, None, None)], "d int, p long, lat double, lon double")
    got = {(r.d, r.p): (r.lat, r.lon, r.segment_id and r.segment_id.place) for r in spatial.nearest_on_roads(points, roads.segments(edges, "d"), nodes, "p", ("d",), widest=0.5).collect()}
    assert got == {(1, 1): (0.05, 0.0, 0), (1, 2): (0.05, 0.0, 0), (1, 3): (5.0, 5.0, None), (2, 1): (3.0, 3.2, None), (3, 1): (1.0, 1.0, None), (1, 4): (None, None, None)}
    kept = {(r.d, r.p): r.lat for r in spatial.nearest_on_roads(points, roads.segments(edges, "d"), None, "p", ("d",), widest=0.5).collect()}
    assert kept[1, 3] == 4.0 and kept[2, 1] == 3.0


def test_long_segments_and_ties(spark):
    rng = random.Random(3)
    parts = [(k, (rng.uniform(0, 1), rng.uniform(0, 1)), (rng.uniform(0, 1), rng.uniform(0, 1))) for k in range(25)] + [(30, (0.2, 0.2), (0.2, 0.2)), (31, (0.5, 0.1), (0.6, 0.1)), (32, (0.5, 0.1), (0.4, 0.1))]
    places = [(n, rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1)) for n in range(150)] + [(200, 0.05, 0.5)]
    segments = spark.createDataFrame([(k, a, b) for k, a, b in parts], "segment_id long, a struct<lat: double, lon: double>, b struct<lat: double, lon: double>")
    points = spark.createDataFrame(places, "p long, lat double, lon double")
    cells = cables.SegmentCells(*(cables.np.array([x[n] for x in parts]) for n in (1, 2)))
    for r in spatial.nearest_on_roads(points, segments, None, "p", reach=0.01, widest=2.0).collect():
        (p,) = [(lat, lon) for n, lat, lon in places if n == r.p]
        d, k, place = min((math.dist(p, on_segment(p, a, b)), k, on_segment(p, a, b)) for k, a, b in parts)
        assert r.segment_id == k and math.dist((r.lat, r.lon), place) < 1e-9
        n, found = cells.nearest(p)
        assert parts[n][0] == k and math.dist(found, place) < 1e-9


def test_pop_too_far(spark):
    ring = "array(named_struct('lon', 112.74D, 'lat', -7.25D), named_struct('lon', 112.76D, 'lat', -7.25D), named_struct('lon', 112.75D, 'lat', -7.22D))"
    df = spark.range(2).select(F.col("id").alias("d"), F.expr(ring).alias("ring"))
    near, far = (design.pop_guard(df, "d", ("P", lat, 112.75)).first() for lat in (-7.25, -7.28))
    assert near.problem is None and near.distance_m == pytest.approx(metres((-7.24, 112.75), (-7.25, 112.75))) and far.problem == "POP too far"
