"""Sites of designs go to roads by design, designs run side by side, and only the cables that are asked for are laid."""

import random

import pytest
from pyspark.sql import functions as F

from strandplan.operators import cables, clusters, design, roads, spatial

EDGE = "d int, u long, v long, key int, length_m double, line array<struct<lon: double, lat: double>>"


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(5)
    rows = []
    for d in range(1, 5):
        for u in range(100):
            for v in [u + 1] * (u % 10 < 9) + [u + 10] * (u < 90):
                for key in range(rng.choice([0, 1, 1, 1, 2])):
                    a, b = ((float(n % 10) / 100, float(n // 10) / 100) for n in (u, v))
                    line = [a, *[(a[0] + rng.random() / 100, a[1] + rng.random() / 100) for _ in range(rng.choice([0, 0, 2]))], b]
                    turned = rng.random() < 0.5
                    rows.append((d, v if turned else u, u if turned else v, key, float(rng.randint(1, 9)), line[::-1] if turned else line))
    edges = spark.createDataFrame(rows, EDGE)
    places = [(d, n, rng.randint(-20, 120) / 1000, rng.randint(-20, 120) / 1000) for d in range(1, 6) for n in range(60)]  # some as near to several
    points = spark.createDataFrame(places + [(1, 60, None, 0.1), (2, 60, 0.05, 1.2), (2, 61, 0.05, 0.9)], "d int, p long, lat double, lon double")
    return edges, points


def placed(df):
    return {(r.d, r.p): (r.lat, r.lon) for r in df.collect()}


def test_sites_are_where_the_tiles_put_them(town):
    edges, points = town
    got = cables.on_roads(points, edges, "d")
    wanted = spatial.nearest_on_roads(points, roads.segments(edges, "d"), None, "p", ("d",))
    assert placed(got) == placed(wanted)
    on = {(r.d, r.p): r.on_road for r in got.collect()}
    assert on == {(r.d, r.p): r.segment_id is not None for r in wanted.collect()}
    assert not on[1, 60] and not on[2, 60] and on[2, 61] and not on[5, 0]


def test_nodes_of_a_design_without_roads(spark, town):
    edges, points = town
    nodes = spark.createDataFrame([(5, 1, 0.05, 0.05), (5, 2, 0.02, 0.02), (1, 3, 9.0, 9.0)], "d int, node long, lat double, lon double")
    houses = points.where("lat IS NOT NULL AND lon < 0.5").withColumnRenamed("p", "h")
    made = design.two_levels(houses, "d", "h", on=design.Roads(edges, nodes))
    assert {(r.lat, r.lon) for r in made["odc"].where("d = 5").collect()} <= {(0.05, 0.05), (0.02, 0.02)}
    kept = design.two_levels(houses, "d", "h", on=design.Roads(edges))
    assert made["odc"].where("d < 5").exceptAll(kept["odc"]).isEmpty()


def test_only_what_is_asked_for_is_laid(town):
    edges, points = town
    houses = points.where("d < 3 AND lat IS NOT NULL AND lon < 0.5").withColumnRenamed("p", "h")
    every = design.full_design(houses, "d", "h", on=design.Roads(edges))
    some = design.full_design(houses, "d", "h", on=design.Roads(edges), laid=("feeder",))
    assert set(every) - set(some) == {"distribution", "drop"}
    a, b = (sorted(df["feeder"].collect()) for df in (every, some))
    assert a == b and any(r.by_road for r in a)
    assert design.bill_of_materials(every, "d").exceptAll(design.bill_of_materials(some, "d")).isEmpty()


def test_small_designs_are_no_single_task(town):
    _, points = town
    sites = points.where("lat IS NOT NULL")
    for df in (clusters.capacitated_clusters(sites, "d", "p", 8), clusters.separated(sites, "d", "p"), clusters.feeder_chain(sites, "d", "p", (0.0, 0.0))):
        tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("d").alias("designs"))
        assert tasks.agg(F.max("designs")).first()[0] == 1
