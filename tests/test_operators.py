import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandplan.functions import geo, labels
from strandplan.operators import clusters, design, projects, roads, spatial


def metres(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    x = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 12742000.0 * math.asin(math.sqrt(x))


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_strict_containment(spark):
    ring = geo.ring_of([(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)])
    points = {"in": (1, 1), "edge": (2, 0), "vertex": (4, 4), "notch": (2, 3), "tip": (2, 2), "left": (-1, 2), "level": (5, 2), "arm": (0.5, 3)}
    got = one(spark, **{n: geo.contains(ring, float(x), float(y)) for n, (x, y) in points.items()})
    assert {n for n in points if got[n]} == {"in", "arm"}


def test_bearing_and_destination_are_inverse(spark):
    lat, lon = geo.destination(-7.25, 112.75, 500.0, 77.0)
    there = one(spark, lat=lat, lon=lon)
    back = one(spark, d=geo.haversine(-7.25, 112.75, there.lat, there.lon), e=geo.haversine_atan2(there.lat, there.lon, -7.25, 112.75), b=geo.bearing(-7.25, 112.75, there.lat, there.lon))
    assert math.isclose(back.d, 500, abs_tol=1e-6) and math.isclose(back.e, 500, abs_tol=1e-6) and math.isclose(back.b, 77, abs_tol=1e-6)
    assert one(spark, n=geo.haversine(1.0, 2.0, 1.0, 2.0), b=geo.bearing(0.0, 0.0, 0.0, -1.0)) == (0.0, 270.0)


def test_lines(spark):
    got = one(spark, p=geo.parse_coordinates(F.lit(" 1,2,3\n4,5 bad 6,x ")), empty=geo.parse_coordinates(F.lit("  ")), pad=geo.padded(geo.ring_of([(1, 2)])), same=geo.without_repeats(geo.ring_of([(1, 2), (1, 2), (3, 4), (1, 2)])), none=geo.line_length(geo.ring_of([(1, 2)])))
    assert [tuple(x) for x in got.p] == [(1, 2), (4, 5)] and got.empty == [] and len(got.same) == 3 and got.none == 0
    assert [tuple(x) for x in got.pad] == [(1, 2), (1 + 1e-5, 2 + 1e-5)]
    c = one(spark, c=geo.centroid(geo.ring_of([(0, 0), (6, 0), (0, 6), (0, 0)])), flat=geo.centroid(geo.ring_of([(0, 0), (2, 2)])))
    assert tuple(c.c) == pytest.approx((2, 2)) and tuple(c.flat) == (1, 1)


def test_labels_and_kinds(spark):
    got = one(spark, a=labels.odp_label(F.lit(1), F.lit(102)), k=labels.mapping_kind(F.lit(" Rumah odc")), n=labels.mapping_kind(F.lit("x")), d=labels.name_or(F.lit("  "), "POP"), s=labels.splitter(F.lit(8)))
    assert tuple(got) == ("01/102", "odc", None, "POP", "1:8")


def test_nearest_site_is_exact(spark):
    rng = random.Random(3)
    sites = [(k, rng.gauss(0, 0.02), rng.gauss(50, 0.02)) for k in range(60)] + [(60, 1.0, 51.0), (61, *(0.5, 50.5)), (62, 0.5, 50.5), (63, None, 1.0)]
    points = [(k, rng.gauss(0, 0.05), rng.gauss(50, 0.05)) for k in range(200)] + [(900, 3.0, 53.0), (901, -2.0, 48.0), (902, 0.5, 50.5), (903, None, None)]
    got = spatial.nearest_site(spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(sites, "s long, lat double, lon double"), "p", "s").collect()
    assert len(got) == len(points) - 1
    for r in got:
        d, s = min((metres((r.lat, r.lon), x[1:]), x[0]) for x in sites if x[1] is not None)
        assert r.s == s and math.isclose(r.distance_m, d, abs_tol=1e-6)
    none = spark.createDataFrame([], "s long, lat double, lon double")
    assert spatial.nearest_site(spark.createDataFrame(points, "p long, lat double, lon double"), none, "p", "s").count() == 0


def test_close_pairs(spark):
    rng = random.Random(8)
    sites = [(k, 60 + rng.random() / 100, 10 + rng.random() / 50) for k in range(120)]
    df = spark.createDataFrame(sites, "s long, lat double, lon double")
    want = {(a[0], b[0]) for a, b in itertools.combinations(sites, 2) if metres(a[1:], b[1:]) < 60}
    assert {(r.a, r.b) for r in spatial.close_pairs(df, "s", 60.0).collect()} == want and want
    assert {r.s for r in spatial.standing_apart(df, "s", 60.0).collect()} == {s[0] for s in sites} - {x for p in want for x in p}


def restated_clusters(points, capacity):
    if len(points) <= capacity:
        return [list(range(len(points)))] if points else []
    free, out, seed = list(range(len(points))), [], random.Random(42).randint(0, len(points) - 1)
    while free:
        if out:
            centre = np.mean([points[k] for k in out[-1]], axis=0)
            seed = min(free, key=lambda k: math.dist(points[k], centre))
        chosen = sorted(free, key=lambda k: math.dist(points[k], points[seed]))[:capacity]
        out.append(chosen)
        free = [k for k in free if k not in chosen]
    return out


@pytest.mark.parametrize("n", [0, 1, 8, 9, 50])
def test_clusters(n):
    rng = random.Random(n)
    points = [(rng.random(), rng.random()) for _ in range(n)]
    got = [c.tolist() for c in clusters.group_by_capacity(np.array(points).reshape(-1, 2), 8)]
    assert got == restated_clusters(points, 8)
    assert sorted(k for c in got for k in c) == list(range(n)) and len(got) == -(-n // 8)


def test_duplicate_points_cluster():
    assert [len(c) for c in clusters.group_by_capacity(np.zeros((20, 2)), 8)] == [8, 8, 4]


def test_push_apart():
    sites = np.array([(0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 1.0 + 39.9 / 111194.9)])
    out = clusters.push_apart(sites, 40.0)
    assert all(metres(a, b) > 39.999 for a, b in itertools.combinations(out.tolist(), 2)) and (out[0] == 0).all() and (out[2] == sites[2]).all()


def test_chain():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 9):
        sites = np.array([(rng.random() / 100, rng.random() / 100) for _ in range(n)]).reshape(-1, 2)
        order = clusters.chain((0.0, 0.0), sites)
        assert sorted(order) == list(range(n))
        length = lambda o: sum(metres(a, b) for a, b in itertools.pairwise([(0.0, 0.0), *sites[o].tolist()]))
        nearest, here, left = [], (0.0, 0.0), list(range(n))
        while left:
            nearest.append(min(left, key=lambda k: math.dist(here, sites[k])))
            left.remove(nearest[-1])
            here = sites[nearest[-1]]
        assert length(order) <= length(nearest) + 1e-9
        if n >= 3:
            assert not any(length(order[:i] + order[i : j + 1][::-1] + order[j + 1 :]) < length(order) - 1e-6 for i in range(n) for j in range(i + 1, n))


def test_roads(spark):
    rng = random.Random(6)
    nodes = list(range(30))
    edges = [(u, v, 0, rng.choice([None, float(rng.randint(1, 9))])) for u, v in itertools.combinations(nodes[:24], 2) if rng.random() < 0.1] + [(26, 27, 0, 1.0), (0, 1, 1, 20.0), (0, 1, 0, 5.0), (3, 3, 0, 1.0)]
    df = spark.createDataFrame(edges, "u long, v long, key int, length_m double")
    dist = {0: 0.0}
    for _ in nodes:
        for u, v, _, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in dist and w is not None and dist[a] + w < dist.get(b, math.inf):
                    dist[b] = dist[a] + w
    source = spark.createDataFrame([(0, 0.0)], "node long, dist_m double")
    large = {r.node: r.dist_m for r in roads.distances_from(df.where("length_m IS NOT NULL"), source).collect()}
    by = roads.distances_by_design(df.withColumn("d", F.lit(1)), source.withColumn("d", F.lit(1)), "d")
    assert large == dist and {r.node: r.dist_m for r in by.collect()} == dist
    far = max(dist, key=dist.get)
    route = roads.routes_to(by, spark.createDataFrame([(1, far)], "d int, node long"), "d").orderBy("hop").collect()
    assert route[0].node == far and route[-1].node == 0
    label = {n: n for n in nodes}
    for _ in nodes:
        for u, v, _, _ in edges:
            label[u] = label[v] = min(label[u], label[v])
    all_nodes = spark.range(30).withColumnRenamed("id", "node")
    assert {r.node: r.component for r in roads.components(df, all_nodes).collect()} == label
    top = max(set(label.values()), key=lambda c: (list(label.values()).count(c), -c))
    assert {r.node for r in roads.largest_component(df, all_nodes).collect()} == {n for n in nodes if label[n] == top}
    assert sorted(r.length_m or 0 for r in roads.noisy(df, 1).collect()) == sorted(r.length_m or 0 for r in roads.noisy(df, 1).collect())


def test_full_design_of_sixty_four_houses(spark):
    rng = random.Random(2)
    houses = [(1, k, -7.25 + rng.random() / 500, 112.75 + rng.random() / 500) for k in range(64)] + [(2, k, -7.25, 112.75) for k in range(9)]
    made = design.full_design(spark.createDataFrame(houses, "d int, h long, lat double, lon double"), "d", "h")
    totals = {r.d: (r.houses, r.odps, r.odcs) for r in design.summary(made, "d").collect()}
    assert totals == {1: (64, 8, 2), 2: (9, 2, 1)}
    bill = design.bill_of_materials(made, "d").where("d = 1").groupBy("type").count().collect()
    assert {r.type: r["count"] for r in bill} == {"POP / Server OLT": 1, "ODC": 2, "Join Closure": 2, "ODP": 8, "Kabel Distribusi": 8, "Homepass (Titik Rumah)": 64, "Kabel Drop": 64, "Kabel Feeder": 2}


def test_toggle_and_access(spark):
    tree = spark.createDataFrame([("a", ["a"], True), ("b", ["a", "b"], False), ("c", ["a", "b", "c"], True), ("d", ["a", "d"], True)], "node_id string, path array<string>, visible boolean")
    assert {r.node_id: r.visible for r in projects.toggled(tree, F.lit("b")).collect()} == {"a": True, "b": True, "c": True, "d": True}
    assert {r.node_id: r.visible for r in projects.toggled(tree, F.lit("a")).collect()} == {n: False for n in "abcd"}
    features = spark.createDataFrame([(1, "b"), (2, "c"), (3, None), (4, "zz")], "id int, node_id string")
    assert sorted(r.id for r in projects.visible_in_tree(features, tree).collect()) == [2, 3, 4]
    asked = spark.createDataFrame([(1, 5, False), (1, 6, False), (1, 6, True), (9, 5, True), (2, 5, False)], "project_id long, user_id long, is_admin boolean")
    owned = spark.createDataFrame([(1, 5), (2, None)], "id long, user_id long")
    assert sorted(r.status for r in projects.access(asked, owned).collect()) == [200, 200, 403, 403, 404]
