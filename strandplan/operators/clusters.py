"""Capacity-bounded clusters, separation and chains of sites, one grouped pandas task for each design.

The algorithms take a design's sites in order and each step depends on the one before, so a design is one task and
many designs run side by side.
"""

from __future__ import annotations

import math
import random
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from strandplan.operators.indexes import FreePlaces, MovingSites, Tour

#: Draws the first seed of a clustering.
SEED = 42
EARTH_RADIUS = 6371000.0


def group_by_capacity(points: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Places of each cluster's points.

    The next cluster is seeded with the free point nearest to the mean of the one before and takes the ``capacity``
    free points nearest to its seed, in this order; ties go to the earlier point.  Each step asks an index of the free
    points, so time grows with n log n.
    """
    if len(points) <= capacity:
        return [np.arange(len(points))] if len(points) else []
    clusters: list[np.ndarray] = []
    free, left = FreePlaces(points), len(points)
    seed = random.Random(SEED).randint(0, len(points) - 1)
    while left:
        if clusters:
            seed = free.nearest(points[clusters[-1]].mean(axis=0), 1)[0]
        clusters.append(free.nearest(points[seed], capacity))
        free.take(clusters[-1])
        left -= len(clusters[-1])
    return clusters


#: Partitions that designs are dealt out to: so many that few share one, as what is given in number is not merged again for being small.
DEALT = 256


def by_design(rows: DataFrame, design: str) -> GroupedData:
    """A group for each design, for work that is long for the size of its input: designs run side by side."""
    return rows.repartition(DEALT, design).groupBy(design)


def _grouped(rows: DataFrame, design: str, run, added: str) -> DataFrame:
    return by_design(rows, design).applyInPandas(run, f"{rows.schema.simpleString()[7:-1]}, {added}")


def capacitated_clusters(points: DataFrame, design: str, order: str, capacity: int) -> DataFrame:
    """``points``(design, order, lat, lon) with cluster and member, both from 1; order is that of the input."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        cluster, member = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for k, chosen in enumerate(group_by_capacity(rows[["lat", "lon"]].to_numpy(float), capacity), 1):
            cluster[chosen], member[chosen] = k, np.arange(1, len(chosen) + 1)
        return rows.assign(cluster=cluster, member=member)

    return _grouped(points, design, run, "cluster int, member int")


def centres(clustered: DataFrame, design: str) -> DataFrame:
    """(design, cluster, lat, lon, members): mean place of each cluster."""
    return clustered.groupBy(design, "cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("members"))


def metres(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(a, 1)))


def _bearing(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    lat1, lon1, lat2, lon2 = map(math.radians, (lat1, lon1, lat2, lon2))
    east = math.sin(lon2 - lon1) * math.cos(lat2)
    north = math.cos(lat1) * math.sin(lat2) - math.sin(lat1) * math.cos(lat2) * math.cos(lon2 - lon1)
    return math.degrees(math.atan2(east, north)) % 360


def _moved(lat: float, lon: float, distance: float, towards: float) -> tuple[float, float]:
    lat, lon, arc, towards = math.radians(lat), math.radians(lon), distance / EARTH_RADIUS, math.radians(towards)
    lat2 = math.asin(math.sin(lat) * math.cos(arc) + math.cos(lat) * math.sin(arc) * math.cos(towards))
    lon2 = lon + math.atan2(math.sin(towards) * math.sin(arc) * math.cos(lat), math.cos(arc) - math.sin(lat) * math.sin(lat2))
    return math.degrees(lat2), math.degrees(lon2)


def push_apart(sites: np.ndarray, least: float, passes: int = 20) -> np.ndarray:
    """Places (lat, lon) after moving the later of two sites nearer than ``least`` metres to that distance.

    Pairs are taken in order and a move counts at once; coincident sites part at golden-angle bearings.  It ends with a
    pass that moves nothing, or after so many.  Only sites of cells beside each other are compared, and a site that moves
    changes its cell, so a pass takes time in proportion to the sites unless they crowd.
    """
    out = sites.astype(float).copy()
    cells = MovingSites(out, least)
    for _ in range(passes):
        still = True
        for i in range(len(out) - 1):
            beside = cells.beside(i)
            if not beside:
                continue
            away = metres(out[i, 0], out[i, 1], out[beside, 0], out[beside, 1])
            for j, d in zip(beside, away.tolist()):
                if d < least:
                    towards = 137.5 * j % 360 if d < 1e-6 else _bearing(*out[i], *out[j])
                    cells.move(j, *_moved(*out[i], least, towards))
                    still = False
        if still:
            break
    return out


def separated(sites: DataFrame, design: str, order: str, least: float = 40.0) -> DataFrame:
    """``sites`` with their places after :func:`push_apart` in columns lat and lon."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        rows[["lat", "lon"]] = push_apart(rows[["lat", "lon"]].to_numpy(float), least)
        return rows

    return by_design(sites, design).applyInPandas(run, sites.schema)


#: Up to so many sites a chain tries every reversal, sweep by sweep.
ALL_PAIRS = 1000


def chain(start: tuple[float, float], sites: np.ndarray, sweeps: int = 200, all_pairs: int = ALL_PAIRS) -> list[int]:
    """Order in which a cable from ``start`` visits sites(lat, lon).

    First always the nearest, planar; then segments of the chain are reversed wherever this saves over 1e-6 metres.
    The saving comes from the two legs that a reversal changes.  Chains of up to ``all_pairs`` sites try every segment in
    order, for at most so many sweeps; longer ones try those that bring a site beside one of its nearest, until none saves.
    """
    order, here, free = [], np.array(start, float), FreePlaces(sites)
    for _ in range(len(sites)):
        (k,) = free.nearest(here, 1)
        order.append(int(k))
        free.take(np.array([k]))
        here = sites[k]
    if len(order) < 3:
        return order
    return _every_reversal(start, sites, order, sweeps) if len(order) <= all_pairs else _near_reversals(start, sites, order)


def _every_reversal(start: tuple[float, float], sites: np.ndarray, order: list[int], sweeps: int) -> list[int]:
    path, numbers, n = np.vstack([np.array(start, float)[None], sites[order]]), np.array([-1, *order]), len(order)

    def legs(place: np.ndarray, others: np.ndarray) -> np.ndarray:
        return metres(place[0], place[1], others[:, 0], others[:, 1])

    for _ in range(sweeps):
        better = False
        for i in range(1, n):
            j = i + 1
            while j <= n:
                ends, after = path[j:], path[j + 1 :]
                saved = metres(*path[i - 1], *path[i]) - legs(path[i - 1], ends)
                saved[:-1] += metres(ends[:-1, 0], ends[:-1, 1], after[:, 0], after[:, 1]) - legs(path[i], after)
                found = np.flatnonzero(saved > 1e-6)
                if not len(found):
                    break
                j += int(found[0])
                path[i : j + 1], numbers[i : j + 1] = path[i : j + 1][::-1].copy(), numbers[i : j + 1][::-1].copy()
                better, j = True, j + 1
        if not better:
            break
    return numbers[1:].tolist()


def _near_reversals(start: tuple[float, float], sites: np.ndarray, order: list[int], near: int = 10) -> list[int]:
    """The chain as a tour closed by a node at no distance from any place but the start, which it never leaves.

    A site is looked at again only when one of its legs has changed.
    """
    places = np.vstack([np.array(start, float)[None], sites])
    close, n = len(places), len(places) + 1
    beside = neighbours(places, near)
    rad = np.radians(places)
    lat, lon, cosine = rad[:, 0].tolist(), rad[:, 1].tolist(), np.cos(rad[:, 0]).tolist()

    def leg(a: int, b: int) -> float:
        if a == close or b == close:
            return -math.inf if a + b == close else 0.0
        h = math.sin((lat[b] - lat[a]) / 2) ** 2 + cosine[a] * cosine[b] * math.sin((lon[b] - lon[a]) / 2) ** 2
        return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(h, 1.0)))

    tour = Tour(np.array([0, *(k + 1 for k in order), close]))
    waiting, queued = deque(tour.order.tolist()), np.ones(n, bool)

    def improved(a: int) -> tuple[int, ...] | None:
        for forward in (True, False):
            s = tour.after(a) if forward else tour.before(a)
            own = leg(a, s)
            for c in beside[a] if a != close else ():
                gain = own - leg(a, c)
                if gain <= 1e-6:
                    break
                t = tour.after(c) if forward else tour.before(c)
                if c != s and t != a and gain + leg(c, t) - leg(s, t) > 1e-6:
                    tour.reverse(*((s, c) if forward else (c, s)))
                    return a, s, c, t
        return None

    while waiting:
        a = waiting.popleft()
        queued[a] = False
        while changed := improved(a):
            for x in changed:
                if not queued[x] and x != a:
                    queued[x] = True
                    waiting.append(x)
    at = int(tour.at[0])
    turned = np.roll(tour.order, -at)
    turned = turned if turned[-1] == close else np.roll(turned[::-1], 1)
    return (turned[1:-1] - 1).tolist()


def neighbours(places: np.ndarray, k: int) -> list[list[int]]:
    """The ``k`` nearest others of each place, nearest first, on a plane in proportion at the places' mean latitude."""
    flat = places * (1.0, math.cos(math.radians(float(places[:, 0].mean()))))
    tree = FreePlaces(flat)
    return [[int(m) for m in tree.nearest(flat[n], k + 1) if m != n][:k] for n in range(len(flat))]


def feeder_chain(sites: DataFrame, design: str, order: str, start: tuple[float, float]) -> DataFrame:
    """``sites`` with chain_seq (from 1) and leg_m, the distance from the chain's place before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        places = rows[["lat", "lon"]].to_numpy(float)
        rows = rows.iloc[chain(start, places)].reset_index(drop=True)
        path = np.vstack([start, rows[["lat", "lon"]].to_numpy(float)])
        return rows.assign(chain_seq=np.arange(1, len(rows) + 1, dtype=np.int32), leg_m=metres(path[:-1, 0], path[:-1, 1], path[1:, 0], path[1:, 1]))

    return _grouped(sites, design, run, "chain_seq int, leg_m double")
