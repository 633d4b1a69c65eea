"""Spatial tables derived from the driver's, each as Spark expressions and as DuckDB SQL of the same arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOUTH, WEST = -7.26, 112.74
#: An L-shaped zone and a square, as (lon, lat).
ZONE = [(112.743, -7.257), (112.757, -7.257), (112.757, -7.250), (112.750, -7.250), (112.750, -7.243), (112.743, -7.243)]
SQUARE = [(112.745, -7.255), (112.755, -7.255), (112.755, -7.245), (112.745, -7.245), (112.745, -7.255)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(key: str, north: int, east: int, double) -> list[str]:
    d = double
    return [f"{d(SOUTH)} + (({key} * {north}) % 10007) / {d(10007)} * {d(0.02)} AS lat", f"{d(WEST)} + (({key} * {east}) % 10009) / {d(10009)} * {d(0.02)} AS lon"]


def _spark(x: float) -> str:
    return f"{float(x)!r}D"


def _duck(x: float) -> str:
    return f"({x!r}::DOUBLE)"


_VIEWS = {
    "house": ("customer", ["CAST(c_custkey AS BIGINT) AS house_id", "c_nationkey AS design"], "CAST(c_custkey AS BIGINT)", 7919, 6101),
    "odp_site": ("supplier", ["CAST(s_suppkey AS BIGINT) AS site_id", "s_nationkey AS design"], "CAST(s_suppkey AS BIGINT)", 4813, 3571),
    "odc_site": ("nation", ["CAST(n_nationkey AS BIGINT) AS site_id", "n_regionkey AS design"], "CAST(n_nationkey AS BIGINT)", 2713, 1931),
    "track": ("events", ["event_id", "user_id", "ts"], "event_id", 3571, 2713),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """house, odp_site, odc_site or track."""
    source, columns, key, north, east = _VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*columns, *_places(key, north, east, _spark))


def view_sql(name: str) -> str:
    """The same as a common table expression."""
    source, columns, key, north, east = _VIEWS[name]
    return f"{name} AS (SELECT {', '.join(columns + _places(key, north, east, _duck))} FROM {source})"


def metres_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))"
    return f"(asin(sqrt(least(1.0::DOUBLE, {a}))) * 12742000.0::DOUBLE)"


#: Features: seven kinds by o_orderkey.
FEATURES = ["POP/OLT", "ODC 01", "JOIN CLOSURE ODC 01", "01/02", "1/2-3", "FEEDER A", "ODC 01 TO ODP 01/02"]
DESCRIPTIONS = ["SERVER OLT", "Jumlah ODP: 4", None, "Induk: ODC 01", "Induk ODP: 01/02", None, None]
STROKES = ["#ff0000", "orange", None, "ABCDEF", "x22c55ex", "#ff0000", "white"]


def _pick(key: str, values: list[str | None]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


FEATURE_COLUMNS = [
    "o_orderkey AS feature_id",
    f"{_pick('o_orderkey', FEATURES)} AS name",
    f"CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE {_pick('o_orderkey', DESCRIPTIONS)} END AS description",
    "CASE WHEN o_orderkey % 7 >= 5 THEN 'LineString' WHEN o_custkey % 11 = 0 THEN 'Polygon' ELSE 'Point' END AS geom_type",
    f"{_pick('o_custkey', STROKES)} AS stroke",
    "CASE WHEN o_custkey % 13 = 0 THEN 'pop' WHEN o_custkey % 17 = 0 THEN 'boundary' ELSE 'design' END AS layer_id",
    "concat('n', CAST(o_custkey % 25 AS VARCHAR(20))) AS node_id",
    "o_custkey % 2 = 0 AS show_pop",
    "o_custkey % 3 = 0 AS show_odc",
    "o_custkey % 5 <> 0 AS show_odp",
    "o_custkey % 7 <> 0 AS show_house",
    "o_custkey % 4 <> 0 AS show_feeder",
    "o_custkey % 9 <> 0 AS show_distribution",
]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(c.replace("VARCHAR(20)", "STRING") for c in FEATURE_COLUMNS))


FEATURE_SQL = f"feature AS (SELECT {', '.join(FEATURE_COLUMNS)} FROM orders)"

PROJECT_COLUMNS = ["o_orderkey AS id", "o_custkey AS user_id", "o_orderpriority AS name", "o_orderdate AS updated_at", "o_orderstatus AS layers"]


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*PROJECT_COLUMNS)


PROJECT_SQL = f"project AS (SELECT {', '.join(PROJECT_COLUMNS)} FROM orders)"

#: Designs (nations) and, of each, roads on a lattice over the area.  Every order is a road between two neighbouring nodes, the
#: lattice is as wide as gives DENSITY orders a node, and lengths follow from the nodes by integer hashes.
DESIGNS, DENSITY = 25, 2.5
SIDE = 0.02
_U = "(o_orderkey * 7919) % (w * w)"
_ALONG = "(o_orderkey * 48271) % 2147483647 % 2 = 0"


def road_width(spark: SparkSession, sf_dir: str) -> int:
    """Nodes on a side of each lattice."""
    return max(2, int((table(spark, sf_dir, "orders").count() / DESIGNS / DENSITY) ** 0.5))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(design, u, v, key, length_m)."""
    w = road_width(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(w).cast("long").alias("w"))
    ends = orders.selectExpr(f"CAST(o_custkey % {DESIGNS} AS BIGINT) AS design", f"{_U} AS u", f"CASE WHEN {_ALONG} THEN 1L ELSE w END AS step", "w")
    ends = ends.where("(step = w AND u < w * (w - 1)) OR (step = 1 AND u % w < w - 1)").distinct()
    return ends.selectExpr("design", "u", "u + step AS v", "0 AS key", "CAST(50 + (u * 7919 + step * 104729 + design * 31) % 101 AS DOUBLE) AS length_m")


def road_place(node: str, w: int) -> tuple[Column, Column]:
    """Latitude and longitude of a node."""
    return SOUTH + F.floor(F.col(node) / w) * SIDE / (w - 1), WEST + (F.col(node) % w) * SIDE / (w - 1)


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with lines: straight ones, and every third by way of a place aside."""
    w = road_width(spark, sf_dir)
    (lat1, lon1), (lat2, lon2) = road_place("u", w), road_place("v", w)

    def place(lat: Column, lon: Column) -> Column:
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    bent = place((lat1 + lat2) / 2 + SIDE / w / 8, (lon1 + lon2) / 2 + SIDE / w / 8)
    ends = place(lat1, lon1), place(lat2, lon2)
    return road_edges(spark, sf_dir).withColumn("line", F.when((F.col("u") + F.col("v")) % 3 == 0, F.array(ends[0], bent, ends[1])).otherwise(F.array(*ends)))


ROAD_SQL = f"""lattice(w) AS (SELECT greatest(2, floor(sqrt(count(*) / {DESIGNS} / {DENSITY})))::BIGINT FROM orders),
    ends AS (SELECT DISTINCT (o_custkey % {DESIGNS})::BIGINT AS design, {_U} AS u, CASE WHEN {_ALONG} THEN 1 ELSE w END AS s, w FROM orders, lattice),
    road AS (
        SELECT design, u, u + s AS v, (50 + (u * 7919 + s * 104729 + design * 31) % 101)::DOUBLE AS length_m FROM ends
        WHERE (s = w AND u < w * (w - 1)) OR (s = 1 AND u % w < w - 1)),
    both_ways AS (SELECT design, u, v, length_m FROM road UNION ALL SELECT design, v, u, length_m FROM road)"""
