"""Convex hulls that merge: hulls of parts, then hulls of hulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.functions import geo

#: Shares that a group's points are dealt out to before the last hull.
SHARES = 32
#: Points of unfinished hulls that a task holds.
HELD = 1 << 18


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points(x, y), against the clock from the smallest; none lies between two others.

    Repeated points count once; points on one line give its two ends.
    """
    points = np.unique(_outer(points), axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    ordered = list(map(tuple, points.tolist()))
    return np.array(chain(ordered) + chain(ordered[::-1]))


def _outer(points: np.ndarray) -> np.ndarray:
    """Without points well inside the quadrangle of the outermost ones."""
    if len(points) < 64:
        return points
    x, y = points.T
    corners = points[[(x + y).argmin(), (x - y).argmax(), (x + y).argmax(), (x - y).argmin()]]
    inside = np.ones(len(points), bool)
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        side = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
        inside &= side > 1e-9 * (abs(b - a).max() + 1e-300)
    return points[~inside]


def convex_hulls(points: DataFrame, *by: str) -> DataFrame:
    """(by, ring): the convex hull of each group's points(lon, lat) as array of struct<lon, lat>, not closed.

    A task first reduces what it reads to hulls, then shares of a group and at last the group are merged, so no task meets
    more points of a group than its hulls have.  Points without both coordinates are left out, groups without points too.
    """
    rows = points.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select(*by, F.col("lon").cast("double"), F.col("lat").cast("double"))
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(_reduced(batch, by))
            size += len(held[-1])
            if size > HELD:
                held = [_reduced(pd.concat(held), by)]
                size = len(held[0])
                if size > HELD // 2:
                    yield held.pop()
                    size = 0
        if held:
            yield _reduced(pd.concat(held), by)

    share = F.pmod(F.xxhash64("lon", "lat"), F.lit(SHARES))
    small = rows.mapInPandas(parts, schema).groupBy(*by, share).applyInPandas(lambda g: _reduced(g, by), schema)

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ring = [{"lon": x, "lat": y} for x, y in hull(group[["lon", "lat"]].to_numpy()).tolist()]
        return pd.DataFrame({**{b: [k] for b, k in zip(by, key)}, "ring": [ring]})

    kinds = "".join(f"`{n}` {k}, " for n, k in rows.dtypes[: len(by)])
    return small.groupBy(*by).applyInPandas(whole, f"{kinds}ring array<struct<lon: double, lat: double>>")


def _reduced(rows: pd.DataFrame, by: tuple[str, ...]) -> pd.DataFrame:
    if not by:
        return pd.DataFrame(hull(rows[["lon", "lat"]].to_numpy()), columns=["lon", "lat"])
    out = []
    for key, group in rows.groupby(list(by), dropna=False, sort=False):
        corners = hull(group[["lon", "lat"]].to_numpy())
        out.append(pd.DataFrame({**{b: [k] * len(corners) for b, k in zip(by, key)}, "lon": corners[:, 0], "lat": corners[:, 1]}))
    return pd.concat(out).astype(rows.dtypes.to_dict()) if out else rows


def buffered(ring: Column | str, lon: Column | str, lat: Column | str, degrees: float) -> Column:
    """Is a point within so many degrees (planar) of what the ring encloses?  Rings of one or two corners are a point or a line."""
    ring, lon, lat = (F.col(c) if isinstance(c, str) else c for c in (ring, lon, lat))

    def off(e: Column) -> Column:
        t = geo.along_segment(lon, lat, e.a, e.b)
        return geo.planar(lat, lon, e.a.lat + t * (e.b.lat - e.a.lat), e.a.lon + t * (e.b.lon - e.a.lon))

    return geo.contains(ring, lon, lat) | (F.array_min(F.transform(geo._edges(ring), off)) <= degrees)
