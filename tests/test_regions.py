"""Quadtree cuts, hulls, walks, tile store and covers against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandplan.operators import hulls, ordering, regions, roads, spatial
from strandplan.sources import tiles

BOX = (112.7, -7.3, 112.8, -7.2)


@pytest.fixture(scope="module")
def roads_table(spark):
    rng = random.Random(6)
    nodes = [(n, -7.25 + rng.gauss(0, 0.02 if n % 3 else 1e-5), 112.75 + rng.gauss(0, 0.02 if n % 3 else 1e-5), rng.choice([None, "a", "b"])) for n in range(600)]
    nodes += [(600 + n, -7.21, 112.71, None) for n in range(40)]
    edges = {(u, v, k): rng.uniform(1, 9) for u, v, k in ((rng.randrange(640), rng.randrange(640), rng.randrange(2)) for _ in range(1500))}
    return spark.createDataFrame(nodes, "node long, lat double, lon double, tag string"), spark.createDataFrame([(*e, n) for e, n in edges.items()], "u long, v long, key int, length_m double")


@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
def test_composition_equals_the_uncut_graph(roads_table, most):
    nodes, edges = roads_table
    coded = regions.placed(nodes, *BOX)
    tree = regions.quadtree(coded, most)
    cells = tree.collect()
    sizes = {r.cell: r["count"] for r in regions.cells_of(coded, tree).groupBy("cell").count().collect()}
    assert sum(sizes.values()) == nodes.count() and sizes == {r.cell: r.nodes for r in cells}
    assert all(r.nodes <= most or r.level == regions.DEEPEST for r in cells) and (len(cells) == 1) == (most == 10_000)
    part_nodes, part_edges = regions.cut(nodes, edges, most, BOX)
    assert sorted(regions.composed(part_edges, "u", "v", "key").select(*edges.columns).collect()) == sorted(edges.collect())
    assert sorted(map(str, regions.composed(part_nodes, "node").select(*nodes.columns).collect())) == sorted(map(str, nodes.collect()))
    assert most == 10_000 or part_edges.count() > edges.count()


def test_the_later_cell_wins_where_it_says_something(spark):
    parts = spark.createDataFrame([(1, 5, "x", 1.0), (1, 9, None, 2.0), (1, 7, "y", None), (2, 3, None, None)], "node long, cell long, tag string, n double")
    assert sorted(map(tuple, regions.composed(parts, "node").collect())) == [(1, "y", 2.0), (2, None, None)]


def brute_hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    keep = set()
    for a in points:
        for b in points:
            if a != b:
                cross = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in points]
                along = [(c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1]) for c in points]
                full = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                if min(cross) >= 0 and all(0 <= t <= full for t, x in zip(along, cross) if x == 0):
                    keep |= {a, b}
    return keep


def test_hulls_equal_brute_force(spark):
    rng = random.Random(2)
    groups = {0: [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(80)], 1: [(k, 2 * k) for k in range(9)] * 2, 2: [(3, 3)] * 5, 3: [(1, 1), (2, 5)], 4: [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(90)]}
    rows = [(g, float(x), float(y)) for g, ps in groups.items() for x, y in ps] + [(4, None, 1.0), (9, 1.0, None), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, lon double, lat double").repartition(6)
    got = {r.g: [tuple(p) for p in r.ring] for r in hulls.convex_hulls(df, "g").collect()}
    assert set(got) == {0, 1, 2, 3, 4, None}
    for g, ps in groups.items():
        assert set(got[g]) == brute_hull([(float(x), float(y)) for x, y in ps]) and len(got[g]) == len(set(got[g]))
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(got[g], got[g][1:] + got[g][:1]))
        assert area >= 0
    (one,) = hulls.convex_hulls(df.where("g = 0")).collect()
    assert [tuple(p) for p in one.ring] == got[0]
    assert hulls.convex_hulls(df.where("false"), "g").count() == 0


def test_hull_of_many_points_drops_only_inner_ones():
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(size=(3000, 2)), [(np.cos(t) * 5, np.sin(t) * 5) for t in np.linspace(0, 6, 40)]])
    assert set(map(tuple, hulls.hull(p).tolist())) == brute_hull(list(map(tuple, np.vstack([p[3000:], p[:200]]).tolist())))


def test_buffers(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    line = F.slice(ring, 1, 2)
    at = spark.createDataFrame([(2.0, 2.0), (4.5, 2.0), (4.4, 4.4), (-0.5, 0.0), (2.0, -0.6), (2.0, 0.3)], "lon double, lat double")
    assert [r[0] for r in at.select(hulls.buffered(ring, "lon", "lat", 0.5)).collect()] == [True, True, False, True, False, True]
    assert [r[0] for r in at.select(hulls.buffered(line, "lon", "lat", 0.5)).collect()] == [False, False, False, True, False, True]


def plain_walk(edges, start, hops=25):
    """edges: {(u, v, key): length}."""
    (u, v, k), at, direction, branch, left = start
    for _ in range(hops):
        length = edges[u, v, k]
        rest = length - at if direction > 0 else at
        if left <= rest:
            return (u, v, k, at + direction * left, False)
        left -= rest
        end = v if direction > 0 else u
        ways = sorted((b if a == end else a, key, a, b) for a, b, key in edges if end in (a, b) and (a, b, key) != (u, v, k))
        if not ways:
            return (u, v, k, length if direction > 0 else 0.0, True)
        _, key, a, b = ways[branch % len(ways)]
        u, v, k = a, b, key
        direction, at = (1, 0.0) if u == end else (-1, edges[u, v, k])
    return (None, None, None, None, None)


def test_walks_equal_plain_ones(spark):
    rng = random.Random(9)
    nets = {d: {(u, v, k): float(rng.randint(5, 60)) for u, v, k in {tuple([*rng.sample(range(n), 2), rng.randrange(2)]) for _ in range(int(n * 1.3))}} for d, n in ((1, 12), (2, 30))}
    nets[3] = {(0, 1, 0): 1.0, (1, 2, 0): 1.0, (2, 0, 0): 1.0}
    rows, want = [], {}
    for d, net in nets.items():
        for n, e in enumerate(sorted(net)):
            for direction in (1, -1):
                for branch in range(4):
                    walk, at, metres = n * 8 + branch * 2 + (direction > 0), round(net[e] * rng.random(), 3), rng.choice([3.0, 40.0, 150.0])
                    rows.append((d, walk, *e, at, direction, branch, metres))
                    want[d, walk] = plain_walk(net, (e, at, direction, branch, metres))
    edges = spark.createDataFrame([(d, *e, n) for d, net in nets.items() for e, n in net.items()], "d int, u long, v long, key int, length_m double")
    starts = spark.createDataFrame(rows, "d int, walk long, u long, v long, key int, at_m double, direction int, branch int, metres double")
    out = roads.walks(starts, edges, "d").collect()
    assert len(out) == len(want)
    for r in out:
        u, v, k, at, closed = want[r.d, r.walk]
        assert (r.u, r.v, r.key, r.closed) == (u, v, k, closed) and (at is None or math.isclose(r.at_m, at, abs_tol=1e-6))
    assert {None, True, False} == {r.closed for r in out}


def test_a_store_fetches_a_tile_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(n, 112.7 + rng.random() * 0.3, -7.3 + rng.random() * 0.3) for n in range(500)]
    world = spark.createDataFrame(rows, "id long, lon double, lat double")
    asked = []

    def source(wanted):
        asked.append({(r.tile_x, r.tile_y) for r in wanted.collect()})
        return world

    store = tiles.TileStore(spark, f"{tmp_path}/store", "id long")
    boxes = [(112.71, -7.29, 112.82, -7.18), (112.78, -7.22, 112.93, -7.12), (112.72, -7.28, 112.8, -7.2), (120.0, 1.0, 120.01, 1.01)]
    for box in boxes:
        fetched = store.fetch(source, *box)
        assert fetched == (len(asked[-1]) if fetched else 0)
        inside = sorted(n for n, lon, lat in rows if box[0] <= lon <= box[2] and box[1] <= lat <= box[3])
        assert sorted(r.id for r in store.read(*box).collect()) == inside
    assert len(asked) == 3 and not asked[0] & asked[1] and store.fetch(source, *boxes[3]) == 0
    held = {(r.tile_x, r.tile_y): r.features for r in store.held().collect()}
    assert set(held) == set.union(*asked) and held[tuple(asked[2])[0]] == 0
    n = tiles.geo.TILES_PER_DEGREE
    assert all(count == sum((math.floor(lon * n), math.floor(lat * n)) == t for _, lon, lat in rows) for t, count in held.items())


def strictly_inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        s = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if s == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        odd ^= (y1 <= y < y2 and s > 0) or (y2 <= y < y1 and s < 0)
    return odd


def test_covers_of_wide_and_ragged_rings(spark):
    rng = random.Random(7)

    def star(cx, cy, r, n):
        return [(cx + r * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * k / n), cy + r * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    rings = {1: star(0, 0, 60, 2000), 2: star(112.75, -7.25, 0.01, 300), 3: [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], 4: star(10, 5, 8, 40), 5: [(1.0, 1.0), (2.0, 2.0)], 6: [(-170.0, -80.0), (170.0, -80.0), (170.0, 80.0), (-170.0, 80.0)]}
    points = [(n, rng.uniform(-70, 70), rng.uniform(-70, 70)) for n in range(300)] + [(1000 + n, rng.uniform(112.74, 112.76), rng.uniform(-7.26, -7.24)) for n in range(300)]
    points += [(2000 + n, float(x), float(y)) for n, (x, y) in enumerate((x, y) for x in range(-1, 6) for y in range(-1, 6))] + [(3000, None, 1.0)]
    df = spark.createDataFrame(points, "p long, lon double, lat double")
    areas = spark.createDataFrame([(k, [tuple(c) for c in r]) for k, r in rings.items()], "region int, ring array<struct<lon: double, lat: double>>")
    got = sorted((r.p, r.region) for r in spatial.inside_any(df, areas, "region").collect())
    assert got == sorted((n, k) for n, x, y in points if x is not None for k, r in rings.items() if k != 5 and strictly_inside(r, x, y))
    cover = spatial.covers(areas, "region").groupBy("region", "__whole").count().collect()
    assert max(r["count"] for r in cover) < 2500 and {r.region for r in cover if r["__whole"]} == {1, 2, 3, 4, 6}
    assert spatial.inside_any(df, areas.where("region = 5"), "region").count() == 0


@pytest.mark.parametrize("most", [3, 25, 1000])
def test_distances_by_cell_equal_a_plain_search(spark, roads_table, most, monkeypatch):
    nodes, edges = roads_table
    best = {}
    for r in edges.collect():
        for a, b in ((r.u, r.v), (r.v, r.u)):
            best[a, b] = min(best.get((a, b), math.inf), r.length_m)
    starts = {0: [(5, 0.0), (17, 2.5)], 1: [(600, 1.0)], 2: [(9999, 0.0)], 3: [(5, 50.0), (5, 3.0), (18, 0.0)]}
    want = {}
    for q, own in starts.items():
        away = {n: min(d for m, d in own if m == n) for n, _ in own if n < 640}
        for _ in range(640):
            new = {}
            for (a, b), length in best.items():
                if a != b and a in away and away[a] + length < min(away.get(b, math.inf), new.get(b, math.inf)):
                    new[b] = away[a] + length
            if not new:
                break
            away |= new
        want |= {(q, n): d for n, d in away.items()}
    coded = regions.placed(nodes, *BOX)
    cells = regions.cells_of(coded, regions.quadtree(coded, most))
    rounds, searched = [], roads._searched
    monkeypatch.setattr(roads, "_searched", lambda *a, crossing: rounds.append(crossing) or searched(*a, crossing=crossing))
    sources = spark.createDataFrame([(q, n, d) for q, own in starts.items() for n, d in own], "query int, node long, dist_m double")
    got = {(r["query"], r.node): r for r in roads.distances_by_cell(edges, cells, sources).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k].dist_m, d, abs_tol=1e-9) for k, d in want.items())
    for (q, n), r in got.items():
        assert (r.via is None and (n, r.dist_m) in starts[q]) or math.isclose(want[q, r.via] + best[r.via, n], r.dist_m, abs_tol=1e-9)
    assert len(rounds) == 2 if most == 1000 else len(rounds) > 2
    few = roads.distances_by_cell(edges, cells, sources, spark.createDataFrame([(0, 100), (1, 600), (2, 5)], "query int, node long")).collect()
    assert {(r["query"], r.node) for r in few} == {k for k in want if k in {(0, 100), (1, 600), (2, 5)}}


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(k * 7919 % 1009, str(k)) for k in range(1009)], "a long, b string").repartition(7)
    got = ordering.numbered(df, "n", "a").collect()
    assert [r.n for r in sorted(got)] == list(range(1, 1010)) and all(r.n == r.a + 1 for r in got)
    assert ordering.numbered(df.where("false"), "n", "a").count() == 0


def test_sites_far_from_all_points(spark):
    def metres(a, b):
        p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
        return 12742000.0 * math.asin(math.sqrt(min(1, h)))

    rng = random.Random(11)
    for around, wide in (((40.0, 10.0), 0.5), ((0.0, 0.0), 80.0), ((-60.0, 179.0), 3.0)):
        sites = [(d, n, around[0] + rng.gauss(0, wide / 3), around[1] + rng.gauss(0, wide)) for d in (1, 2) for n in range(150)]
        points = [(d, 100 * d + n, rng.uniform(-85, 85), rng.uniform(-180, 180)) for d in (1, 2, 3) for n in range(30)]
        a = spark.createDataFrame(points, "d int, p long, lat double, lon double")
        b = spark.createDataFrame([(d, n, max(-89.0, min(89.0, lat)), lon) for d, n, lat, lon in sites], "d int, s long, lat double, lon double")
        kept = [tuple(r) for r in b.collect()]
        for by in ((), ("d",)):
            own = b if by else b.where("d = 1")
            got = {r.p: (r.s, r.distance_m) for r in spatial.nearest_site(a, own if by else own.drop("d"), "p", "s", by).collect()}
            for d, p, lat, lon in points:
                near = [(metres((lat, lon), (y, x)), n) for e, n, y, x in kept if (e == d if by else e == 1)]
                assert (p in got) == bool(near)
                if near:
                    assert math.isclose(got[p][1], min(near)[0], rel_tol=1e-9) and math.isclose(dict((n, m) for m, n in near)[got[p][0]], min(near)[0], rel_tol=1e-9)


def test_walks_that_leave_their_stretch(spark, monkeypatch):
    """Stretches of four ids, which most walks leave; and within one stretch a walk is sent on once, where each node was a round of two joins."""
    written, materialise = [], roads.materialise
    monkeypatch.setattr(roads, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    starts = spark.createDataFrame([(1, 7, 0, 1, 0, 0.5, 1, 0, 19.0)], "d int, walk long, u long, v long, key int, at_m double, direction int, branch int, metres double")
    chain = spark.range(60).selectExpr("1 AS d", "id AS u", "id + 1 AS v", "0 AS key", "1.0D AS length_m")
    assert roads.walks(starts, chain, "d").select("u", "v", "at_m", "closed").collect() == [(19, 20, 0.5, False)] and len(written) < 4
    monkeypatch.setattr(roads, "WALKED", 4)
    assert roads.walks(starts, chain, "d").select("u", "v", "at_m", "closed").collect() == [(19, 20, 0.5, False)]
    test_walks_equal_plain_ones(spark)


def test_components_over_few_rounds(spark, monkeypatch):
    """Of a ladder only what joins stretches of ids goes through the rounds, which took all edges before."""
    edges = spark.range(400).selectExpr("id AS u", "id + 1 AS v", "0 AS key").where("u % 100 <> 99").union(spark.createDataFrame([(399, 0, 0), (7, 7, 0)], "u long, v long, key int"))
    nodes = spark.range(405).withColumnRenamed("id", "node")
    spread, seen = roads._spread, []
    monkeypatch.setattr(roads, "_spread", lambda e, n: seen.append(e.count()) or spread(e, n))
    for together, left in ((1 << 16, 0), (30, 13)):
        monkeypatch.setattr(roads, "TOGETHER", together)
        got = dict(map(tuple, roads.components(edges, nodes).collect()))
        want = {n: n // 100 * 100 if n < 300 else 0 if n < 400 else n for n in range(405)}
        assert got == want and seen.pop() == left
    assert sorted(r.node for r in roads.largest_component(edges, nodes).collect()) == [*range(100), *range(300, 400)]
