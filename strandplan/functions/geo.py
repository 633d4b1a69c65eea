"""Geometry as Column expressions.  Angles are degrees, lengths metres, rings and lines arrays of struct<lon, lat>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0
#: Side of a cache tile.
TILES_PER_DEGREE = 20
#: Angle between successive coincident sites that are spread apart.
GOLDEN_ANGLE = 137.5

Value = Column | str | float


def _col(x: Value) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x


def _half_chord(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    dlat, dlon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon


def haversine(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Great-circle distance by the arc sine."""
    return F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2)))) * (2 * EARTH_RADIUS)


def haversine_atan2(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Great-circle distance by the arc tangent; equal to :func:`haversine` up to rounding."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))) * (2 * EARTH_RADIUS)


def bearing(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Initial bearing from the first point to the second, from 0 up to 360."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def destination(lat: Value, lon: Value, metres: Value, towards: Value) -> tuple[Column, Column]:
    """(lat, lon) of the point so many metres away at a bearing."""
    lat, lon, arc, towards = F.radians(_col(lat)), F.radians(_col(lon)), _col(metres) / EARTH_RADIUS, F.radians(_col(towards))
    lat2 = F.asin(F.sin(lat) * F.cos(arc) + F.cos(lat) * F.sin(arc) * F.cos(towards))
    lon2 = lon + F.atan2(F.sin(towards) * F.sin(arc) * F.cos(lat), F.cos(arc) - F.sin(lat) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def planar(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    """Distance in degrees, as if they were a plane."""
    dlat, dlon = _col(lat2) - _col(lat1), _col(lon2) - _col(lon1)
    return F.sqrt(dlat * dlat + dlon * dlon)


def golden_bearing(place: Value) -> Column:
    """Bearing at which the coincident site of a place is moved away."""
    return F.pmod(_col(place) * GOLDEN_ANGLE, F.lit(360.0))


def even_bearing(place: Value, count: Value) -> Column:
    """Bearings that divide the circle evenly."""
    return _col(place) * (F.lit(360.0) / _col(count))


def parse_coordinates(text: Value) -> Column:
    """Ring or line of "lon,lat[,alt]" tuples between white space; tuples that aren't numbers are left out."""
    parts = F.transform(F.filter(F.split(F.trim(_col(text)), r"\s+"), lambda t: t != ""), lambda t: F.split(t, ","))
    points = F.transform(parts, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat")))
    return F.filter(points, lambda p: p.lon.isNotNull() & p.lat.isNotNull())


def ring_of(points: list[tuple[float, float]]) -> Column:
    """A literal ring of (lon, lat)."""
    return F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points))


def _edges(ring: Column) -> Column:
    """Of a ring, closed or not, the edges as struct<a, b> of successive vertices."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), after.alias("b"))


def contains(ring: Value, lon: Value, lat: Value) -> Column:
    """Is the point strictly inside?  Points on an edge or a vertex aren't."""
    ring, lon, lat = _col(ring), _col(lon), _col(lat)

    def side(e: Column) -> Column:
        return (e.b.lon - e.a.lon) * (lat - e.a.lat) - (e.b.lat - e.a.lat) * (lon - e.a.lon)

    def touches(e: Column) -> Column:
        within = lon.between(F.least(e.a.lon, e.b.lon), F.greatest(e.a.lon, e.b.lon)) & lat.between(F.least(e.a.lat, e.b.lat), F.greatest(e.a.lat, e.b.lat))
        return within & (side(e) == 0)

    def crosses(e: Column) -> Column:
        up = (e.a.lat <= lat) & (e.b.lat > lat) & (side(e) > 0)
        down = (e.a.lat > lat) & (e.b.lat <= lat) & (side(e) < 0)
        return up | down

    edges = _edges(ring)
    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, touches)


def bounds(ring: Value) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat> of a ring or line."""
    lons, lats = F.transform(_col(ring), lambda p: p.lon), F.transform(_col(ring), lambda p: p.lat)
    return F.struct(F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"), F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"))


def grow(box: Value, degrees: float) -> Column:
    """A box with a margin on all sides."""
    box = _col(box)
    return F.struct((box.min_lon - degrees).alias("min_lon"), (box.min_lat - degrees).alias("min_lat"), (box.max_lon + degrees).alias("max_lon"), (box.max_lat + degrees).alias("max_lat"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a.min_lon <= b.max_lon) & (b.min_lon <= a.max_lon) & (a.min_lat <= b.max_lat) & (b.min_lat <= a.max_lat)


def centroid(ring: Value) -> Column:
    """struct<lon, lat>: area centroid of a ring; the mean of the vertices if it has no area."""
    ring = _col(ring)
    edges = _edges(ring)
    first = F.element_at(ring, 1)

    def total(f) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda s, e: s + f(e))

    def cross(e: Column) -> Column:
        return (e.a.lon - first.lon) * (e.b.lat - first.lat) - (e.b.lon - first.lon) * (e.a.lat - first.lat)

    area = total(cross)
    lon = first.lon + total(lambda e: (e.a.lon + e.b.lon - 2 * first.lon) * cross(e)) / (3 * area)
    lat = first.lat + total(lambda e: (e.a.lat + e.b.lat - 2 * first.lat) * cross(e)) / (3 * area)
    mean_lon = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p.lon) / F.size(ring)
    mean_lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p.lat) / F.size(ring)
    flat = (area == 0) | F.isnan(area)
    return F.struct(F.when(flat, mean_lon).otherwise(lon).alias("lon"), F.when(flat, mean_lat).otherwise(lat).alias("lat"))


def line_length(line: Value) -> Column:
    """Sum of great-circle distances between successive vertices."""
    line = _col(line)
    pairs = F.arrays_zip(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.size(line)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + haversine_atan2(e["0"].lat, e["0"].lon, e["1"].lat, e["1"].lon))


def planar_length(line: Value) -> Column:
    """Sum of distances in degrees between successive vertices."""
    line = _col(line)
    pairs = F.arrays_zip(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.size(line)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + planar(e["0"].lat, e["0"].lon, e["1"].lat, e["1"].lon))


def without_repeats(line: Value) -> Column:
    """The line without vertices that equal the one before."""
    line = _col(line)
    return F.filter(line, lambda p, k: (k == 0) | (p != F.get(line, k - 1)))


def padded(line: Value) -> Column:
    """A line of one vertex gets a second one, 1e-5 degrees further on both axes."""
    line = _col(line)
    only = F.element_at(line, 1)
    more = F.struct((only.lon + 1e-5).alias("lon"), (only.lat + 1e-5).alias("lat"))
    return F.when(F.size(line) == 1, F.concat(line, F.array(more))).otherwise(line)


def tile(degrees: Value) -> Column:
    return F.floor(_col(degrees) * TILES_PER_DEGREE).cast("long")


def tile_name(lon: Value, lat: Value) -> Column:
    """Ten hexadecimal digits that name the tile of a point."""
    return F.substring(F.md5(F.concat_ws(",", tile(lon).cast("string"), tile(lat).cast("string"))), 1, 10)


def along_segment(lon: Value, lat: Value, a: Column, b: Column) -> Column:
    """Where, from 0 to 1 between vertices a and b, the nearest place of the segment lies; planar."""
    dx, dy = b.lon - a.lon, b.lat - a.lat
    square = dx * dx + dy * dy
    share = ((_col(lon) - a.lon) * dx + (_col(lat) - a.lat) * dy) / square
    return F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def unproject(x: Value, y: Value, zoom: Value) -> tuple[Column, Column]:
    """(lon, lat) of a web-mercator pixel at a zoom of 512-pixel tiles."""
    world = F.pow(F.lit(2.0), _col(zoom)) * 512
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * _col(y) / world))))
    return _col(x) / world * 360 - 180, lat


def eye_altitude(zoom: Value) -> Column:
    """Metres above ground that a map's zoom stands for."""
    return 35200000 / F.pow(F.lit(2.0), _col(zoom))
