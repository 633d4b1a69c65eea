import math

from pyspark.sql import functions as F

from strandplan.operators import cables
from strandplan.sources import tiles

#  6 - 7   8      a square 0..3 with a bent parallel edge, an edge to 7 over 6, and a lone edge 8-9
EDGES = [(0, 1, 100.0, [(0, 0), (0, 1)]), (1, 2, 100.0, [(0, 1), (1, 1)]), (2, 3, 100.0, [(1, 1), (1, 0)]), (3, 0, 500.0, [(1, 0), (0, 0)]), (0, 1, 90.0, [(0, 0), (-0.5, 0.5), (0, 1)]), (2, 6, None, [(1, 1), (2, 1)]), (8, 9, 1.0, [(5, 5), (5, 6)])]


def edges(spark):
    rows = [(1, u, v, 0, n, [(float(x), float(y)) for y, x in line]) for u, v, n, line in EDGES]
    return spark.createDataFrame(rows, "d int, u long, v long, key int, length_m double, line array<struct<lon: double, lat: double>>")


def route(spark, a, b):
    df = spark.createDataFrame([(1, 7, *map(float, (*a, *b)))], "d int, c int, lat1 double, lon1 double, lat2 double, lon2 double")
    r = cables.routed(df, edges(spark), "d").first()
    return r.by_road, [(round(p.lat, 6), round(p.lon, 6)) for p in r.coords]


def test_routes(spark):
    # Lengths are far smaller than the degrees between nodes, so the way to the node nearest to the end is taken.
    assert route(spark, (0.9, -0.1), (0.2, 1.1)) == (True, [(0.9, -0.1), (0.9, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.2, 1.0), (0.2, 1.1)])
    assert route(spark, (0.5, -0.01), (0.9, -0.01)) == (True, [(0.5, -0.01), (0.5, 0.0), (0.9, 0.0), (0.9, -0.01)])
    assert route(spark, (-0.3, 0.2), (-0.3, 0.8))[1][2] == (-0.5, 0.5)
    assert route(spark, (0.0, 0.0), (5.0, 5.5)) == (False, [(0.0, 0.0), (5.0, 5.5)])


def test_no_roads_and_regeneration(spark):
    df = spark.createDataFrame([(2, 0.0, 0.0, 1.0, 1.0)], "d int, lat1 double, lon1 double, lat2 double, lon2 double")
    assert not cables.routed(df, edges(spark), "d").first().by_road
    ends = F.expr("array(named_struct('lon', 0D, 'lat', 0.9D), named_struct('lon', 1D, 'lat', 0.2D))")
    segments = spark.range(1).select(F.lit(1).alias("d"), F.lit(1).alias("i"), F.lit("POP").alias("from_label"), F.lit("ODC-001").alias("to_label"), ends.alias("coords"))
    got = [cables.regenerated(segments, edges(spark), "d", 5).first() for _ in range(2)]
    assert got[0] == got[1] and got[0].by_road and math.isclose(got[0].coords[0].lat, 0.9)


def test_tiles_and_tags(spark, tmp_path):
    rows = [(k, f"n{k}", -7.3 + k / 100, 112.7 + k / 50, "Point" if k % 2 else "Polygon", {"building": "yes"} if k % 3 else {"highway": "primary"}) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, name string, lat double, lon double, geom_type string, tags map<string,string>")
    tiles.write_tiles(df, f"{tmp_path}/t", ["id", "name", "absent"])
    area = tiles.read_tiles(spark, f"{tmp_path}/t", 112.72, -7.29, 112.9, -7.2)
    assert sorted(r.id for r in area.collect()) == list(range(1, 11)) and area.columns == ["id", "name", "lat", "lon"]
    assert "tile_x" in area._jdf.queryExecution().toString()
    assert tiles.tagged(df, "building", kinds=["Point"]).count() == 10 and tiles.tagged(df, "highway", ["secondary"]).count() == 0
    kept = spark.range(1).select(tiles.without_styles(F.create_map(F.lit("styleUrl"), F.lit("x"), F.lit("name"), F.lit("y"))).alias("m")).first().m
    assert kept == {"name": "y"}
