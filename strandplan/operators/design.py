"""Whole designs: houses into distribution points (ODP), these into cabinets (ODC), a feeder chain, labels."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.functions import geo, labels
from strandplan.lineage import materialise
from strandplan.operators import cables, clusters, roads, spatial

POP = ("POP/OLT", -7.25, 112.75)
#: Kinds of cables that follow the roads.
CABLES = ("feeder", "distribution", "drop")


class Roads(NamedTuple):
    """Roads of designs: edges(design, u, v, key, length_m, line of struct<lon, lat>) and, if there are any without edges,
    nodes(design, node, lat, lon)."""

    edges: DataFrame
    nodes: DataFrame | None = None


def _written(on: Roads | None) -> Roads | None:
    """The same with edges that are made once."""
    return on and on._replace(edges=materialise(on.edges, "design-roads"))


def _sites(clustered: DataFrame, design: str, seq: str, members: str, on: Roads | None) -> DataFrame:
    """(design, seq, lat, lon, members): the clusters' mean places, moved to the nearest road."""
    mean = clusters.centres(clustered, design).select(design, F.col("cluster").alias(seq), "lat", "lon", F.col("members").alias(members))
    if on is None:
        return mean
    moved = cables.on_roads(mean, on.edges, design)
    if on.nodes is None:
        return moved.drop("on_road")
    moved = materialise(moved, "design-moved")
    near, far = (moved.where(c).drop("on_road") for c in ("on_road", "NOT on_road"))
    return near if far.isEmpty() else near.unionByName(spatial.nearest_on_roads(far, roads.segments(on.edges, design), on.nodes, seq, (design,)).drop("segment_id"))


def two_levels(houses: DataFrame, design: str, order: str, odp_capacity: int = 8, odc_capacity: int = 4, on: Roads | None = None) -> dict[str, DataFrame]:
    """house(design, order, lat, lon, odp_seq, member), odp(design, odp_seq, lat, lon, houses, odc_seq, member) and
    odc(design, odc_seq, lat, lon, odps) of every design.

    With roads, ODPs stand on the road nearest to the mean of their houses, are clustered by where they stand, and so do
    cabinets on the road nearest to the mean of their ODPs.
    """
    return _two_levels(houses, design, order, odp_capacity, odc_capacity, _written(on))


def _two_levels(houses: DataFrame, design: str, order: str, odp_capacity: int, odc_capacity: int, on: Roads | None) -> dict[str, DataFrame]:
    house = materialise(clusters.capacitated_clusters(houses.select(design, order, "lat", "lon"), design, order, odp_capacity), "design-house")
    odp = _sites(house, design, "odp_seq", "houses", on)
    odp = materialise(clusters.capacitated_clusters(odp, design, "odp_seq", odc_capacity), "design-odp")
    odc = _sites(odp, design, "odc_seq", "odps", on)
    return {"house": house.withColumnRenamed("cluster", "odp_seq"), "odp": odp.withColumnRenamed("cluster", "odc_seq"), "odc": odc}


def full_design(houses: DataFrame, design: str, order: str, odp_capacity: int = 8, odc_capacity: int = 4, apart: float = 40.0, pop: tuple = POP, on: Roads | None = None, laid: tuple[str, ...] = CABLES) -> dict[str, DataFrame]:
    """The two levels with cabinets moved apart and numbered along the feeder chain (i), ODPs (j) and houses (k) within.

    With roads there are also feeder, distribution and drop, or those of them in ``laid``: their cables along the roads, see
    :func:`cable_lines`.
    """
    on = _written(on)
    made = _two_levels(houses, design, order, odp_capacity, odc_capacity, on)
    moved = clusters.separated(made["odc"], design, "odc_seq", apart)
    odc = materialise(clusters.feeder_chain(moved, design, "odc_seq", pop[1:]).withColumnRenamed("chain_seq", "i"), "design-odc")
    odp = made["odp"].withColumnRenamed("member", "j").join(odc.select(design, "odc_seq", "i", F.col("lat").alias("odc_lat"), F.col("lon").alias("odc_lon")), [design, "odc_seq"])
    odp = materialise(odp, "design-odp-labelled")
    house = made["house"].withColumnRenamed("member", "k").join(odp.select(design, "odp_seq", "i", "j", F.col("lat").alias("odp_lat"), F.col("lon").alias("odp_lon")), [design, "odp_seq"])
    out = {"house": house, "odp": odp, "odc": odc}
    return out if on is None else out | cable_lines(out, design, on, pop, laid)


def cable_lines(made: dict[str, DataFrame], design: str, on: Roads, pop: tuple = POP, laid: tuple[str, ...] = CABLES) -> dict[str, DataFrame]:
    """feeder(design, i, from_label, to_label), distribution(design, i, j) and drop(design, i, j, k), each with coords and by_road;
    only those in ``laid``, for callers that need no others.

    All cables of a design are routed in one task over one copy of its roads; straight where these don't lead.
    """
    ends = ["lat1", "lon1", "lat2", "lon2"]
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    feeders = feeder_segments(made["odc"], design, pop)
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    parts = {
        "feeder": feeders.select(design, F.lit("feeder").alias("cable"), "i", none.alias("j"), none.alias("k"), "from_label", "to_label", first.lat.alias("lat1"), first.lon.alias("lon1"), last.lat.alias("lat2"), last.lon.alias("lon2")),
        "distribution": made["odp"].select(design, F.lit("distribution").alias("cable"), "i", "j", none.alias("k"), text.alias("from_label"), text.alias("to_label"), F.col("odc_lat").alias("lat1"), F.col("odc_lon").alias("lon1"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")),
        "drop": made["house"].select(design, F.lit("drop").alias("cable"), "i", "j", "k", text.alias("from_label"), text.alias("to_label"), F.col("odp_lat").alias("lat1"), F.col("odp_lon").alias("lon1"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")),
    }
    ways = materialise(cables.routed(reduce(DataFrame.unionByName, (parts[n] for n in laid)), on.edges, design).drop(*ends), "design-cables")
    columns = {"feeder": ["i", "from_label", "to_label"], "distribution": ["i", "j"], "drop": ["i", "j", "k"]}
    return {n: ways.where(F.col("cable") == n).select(design, *columns[n], "coords", "by_road") for n in laid}


def feeder_segments(odc: DataFrame, design: str, pop: tuple = POP) -> DataFrame:
    """(design, i, from_label, to_label, coords) along the chain, straight lines; the first one begins at the POP."""
    w = Window.partitionBy(design).orderBy("i")
    name = F.concat(F.lit("ODC-"), labels.number("i", 3))
    place = F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    start = F.struct(F.lit(float(pop[2])).alias("lon"), F.lit(float(pop[1])).alias("lat"))
    return odc.select(design, "i", F.lag(name, 1, pop[0]).over(w).alias("from_label"), name.alias("to_label"), F.array(F.coalesce(F.lag(place).over(w), start), place).alias("coords"))


def pop_guard(boundaries: DataFrame, design: str, pop: tuple = POP, most: float = 3000.0) -> DataFrame:
    """(design, distance_m, problem): from the centroid of each of boundaries(design, ring) to the POP; a problem if over ``most``."""
    placed = boundaries.select(design, geo.centroid("ring").alias("__c"))
    away = placed.select(design, geo.haversine_atan2(F.col("__c.lat"), F.col("__c.lon"), pop[1], pop[2]).alias("distance_m"))
    return away.select(design, "distance_m", F.when(F.col("distance_m") > most, "POP too far").alias("problem"))


def assigned_design(points: DataFrame, design: str) -> dict[str, DataFrame]:
    """The tables of :func:`full_design` for placed points(design, point_id, kind, lat, lon) of one design each.

    Houses go to the nearest ODP and ODPs to the nearest ODC, without regard to capacity; the first "olt" is the POP.
    """
    out: dict[str, DataFrame] = {}
    of = {k: points.where(F.col("kind") == k) for k in ("odc", "odp", "hc")}
    near = [("hc", "odp"), ("odp", "odc")]
    for kind, site in near:
        sites = of[site].select(F.col("point_id").alias("site_id"), "lat", "lon")
        out[kind] = spatial.nearest_site(of[kind], sites, "point_id", "site_id")
    return out | {"odc": of["odc"]}


def guards(points: DataFrame, design: str) -> DataFrame:
    """(design, problem): what a set of placed points lacks; null if nothing."""
    has = {k: F.max((F.col("kind") == k).cast("int")) for k in ("olt", "odc", "odp")}
    found = points.groupBy(design).agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in has.items()))
    problem = F.when(F.col("olt") == 0, "no OLT").when(F.col("odc") == 0, "no ODC").when(F.col("odp") == 0, "no ODP")
    return found.select(design, problem.alias("problem"))


def expected(houses: DataFrame, design: str, odp_capacity: int = 8, odc_capacity: int = 4) -> DataFrame:
    """(design, houses, odps, odcs): the numbers that the capacities call for."""
    odps = F.ceil(F.col("houses") / odp_capacity)
    return houses.groupBy(design).agg(F.count("*").alias("houses")).select(design, "houses", odps.alias("odps"), F.ceil(odps / odc_capacity).alias("odcs"))


def bill_of_materials(made: dict[str, DataFrame], design: str, pop: tuple = POP, slack: float = 1.2) -> DataFrame:
    """(design, section, i, j, k, sub, type, name, quantity, unit, lat, lon), ordered by the middle columns.

    Cables have no place; distribution and drop cables are straight with slack, feeders follow their coordinates (along
    the roads, if the design was made with any) without.  Quantities in metres aren't rounded.
    """
    odc, odp, house = made["odc"], made["odp"], made["house"]
    none = F.lit(None).cast("double")

    def rows(df: DataFrame, place: tuple, kind: str, name, quantity=None, at: tuple | None = None) -> DataFrame:
        section, i, j, k, sub = (x if not isinstance(x, int) else F.lit(x) for x in place)
        lat, lon = at if at else (none, none)
        amount, unit = (F.lit(1.0), "pcs") if quantity is None else (quantity, "m")
        return df.select(design, section.cast("int").alias("section"), i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), sub.cast("int").alias("sub"), F.lit(kind).alias("type"), name.alias("name"), amount.alias("quantity"), F.lit(unit).alias("unit"), lat.alias("lat"), lon.alias("lon"))

    i, j, k = F.col("i"), F.col("j"), F.col("k")
    own = (F.col("lat"), F.col("lon"))
    odc_name, odp_name, house_name = labels.odc_label("i"), labels.odp_label("i", "j"), labels.house_label("i", "j", "k")
    to_odp = geo.haversine_atan2("odc_lat", "odc_lon", "lat", "lon") * slack
    to_house = geo.haversine_atan2("odp_lat", "odp_lon", "lat", "lon") * slack
    feeders = made["feeder"] if "feeder" in made else feeder_segments(odc, design, pop)
    arrow = F.lit(" -> ")
    parts = [
        rows(odc.select(design).distinct(), (0, 0, 0, 0, 0), "POP / Server OLT", F.lit(pop[0]), at=(F.lit(float(pop[1])), F.lit(float(pop[2])))),
        rows(odc, (1, i, 0, 0, 0), "ODC", odc_name, at=own),
        rows(odc, (1, i, 0, 0, 1), "Join Closure", F.concat(F.lit("JOIN CLOSURE "), odc_name), at=own),
        rows(odp, (1, i, j, 0, 0), "ODP", odp_name, at=own),
        rows(odp, (1, i, j, 0, 1), "Kabel Distribusi", F.concat(odc_name, arrow, odp_name), to_odp),
        rows(house, (1, i, j, k, 0), "Homepass (Titik Rumah)", house_name, at=own),
        rows(house, (1, i, j, k, 1), "Kabel Drop", F.concat(odp_name, arrow, house_name), to_house),
        rows(feeders, (2, i, 0, 0, 0), "Kabel Feeder", F.concat("from_label", arrow, "to_label"), geo.line_length("coords")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def placemarks(made: dict[str, DataFrame], design: str, pop: tuple = POP, homepass: bool = True) -> DataFrame:
    """(design, seq, folders, name, description, geom_type, coords, colour, size): a design's map, in its order.

    Cables follow the roads if the design was made with any, and are straight otherwise.
    """
    odc, odp, house = made["odc"], made["odp"], made["house"]
    point = F.array(F.struct("lon", "lat"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    top = F.concat(F.lit("ODC "), i.cast("string"))
    odc_name, odp_name, house_name = labels.odc_label("i"), labels.odp_label("i", "j"), labels.house_label("i", "j", "k")

    def line(lat: str, lon: str):
        return F.array(F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")), F.struct("lon", "lat"))

    def rows(df: DataFrame, order: tuple, folders: list, name, description, kind: str, coords, colour: str, size: float) -> DataFrame:
        seq = F.struct(*(x.cast("int").alias(f"o{n}") if not isinstance(x, int) else F.lit(x).alias(f"o{n}") for n, x in enumerate(order)))
        path = F.array(*(F.lit(x) if isinstance(x, str) else x for x in folders))
        return df.select(design, seq.alias("seq"), path.alias("folders"), name.alias("name"), description.alias("description"), F.lit(kind).alias("geom_type"), coords.alias("coords"), F.lit(colour).alias("colour"), F.lit(float(size)).alias("size"))

    nothing = F.lit(None).cast("string")
    centre = odc.select(design).distinct().select(design, F.lit(float(pop[2])).alias("lon"), F.lit(float(pop[1])).alias("lat"))
    feeders = made["feeder"] if "feeder" in made else feeder_segments(odc, design, pop)
    to_odp, to_house = line("odc_lat", "odc_lon"), line("odp_lat", "odp_lon")
    cabled, dropped = odp, house
    if "drop" in made:
        cabled = odp.join(made["distribution"].select(design, "i", "j", "coords"), [design, "i", "j"])
        dropped = house.join(made["drop"].select(design, "i", "j", "k", "coords"), [design, "i", "j", "k"])
        to_odp, to_house = geo.padded("coords"), geo.padded("coords")
    of_odc = F.concat(F.lit("Splitter: 1:4\nJumlah ODP: "), F.col("odps").cast("string"))
    of_odp = F.concat(F.lit("Splitter: 1:8\nJumlah rumah: "), F.col("houses").cast("string"), F.lit("\nInduk: "), odc_name)
    parts = [
        rows(centre, (0, 0, 0, 0, 0), ["OLT"], F.lit(pop[0]), F.lit("SERVER OLT"), "Point", point, "red", 1.3),
        rows(feeders, (1, i, 0, 0, 0), ["LINE FD"], F.concat(F.lit("FD "), "from_label", F.lit(" -> "), "to_label"), nothing, "LineString", geo.padded("coords"), "red", 3),
        rows(odc, (2, i, 0, 0, 0), [top, "ODC"], odc_name, of_odc, "Point", point, "red", 1.1),
        rows(odc, (2, i, 1, 0, 0), [top, "JOIN CLOSURE"], F.concat(F.lit("JOIN CLOSURE "), odc_name), F.concat(F.lit("Closure untuk "), odc_name), "Point", point, "gray", 0.8),
        rows(odp, (2, i, 2, j, 0), [top, "ODP"], odp_name, of_odp, "Point", point, "blue", 0.9),
        rows(cabled, (2, i, 3, j, 0), [top, "LINE ODC TO ODP"], F.concat(odc_name, F.lit(" TO ODP "), odp_name), nothing, "LineString", to_odp, "blue", 2),
    ]
    if homepass:
        parts += [
            rows(house, (2, i, 4, j, k), [top, "HC"], house_name, F.concat(F.lit("Induk ODP: "), odp_name), "Point", point, "green", 0.6),
            rows(dropped, (2, i, 5, j, k), [top, "LINE ODP TO HC"], F.concat(F.lit("ODP "), odp_name, F.lit(" TO HC "), house_name), nothing, "LineString", to_house, "white", 1),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(made: dict[str, DataFrame], design: str) -> DataFrame:
    """(design, houses, odps, odcs, feeders, chain): totals and the chain as text."""
    names = F.transform(F.array_sort(F.collect_list("i")), lambda n: F.concat(F.lit("ODC-"), labels.number(n, 3)))
    odc = made["odc"].groupBy(design).agg(F.count("*").alias("odcs"), F.count("*").alias("feeders"), F.concat(F.lit("POP -> "), F.array_join(names, " -> ")).alias("chain"))
    odp = made["odp"].groupBy(design).agg(F.count("*").alias("odps"), F.sum("houses").alias("houses"))
    return odp.join(odc, design).select(design, "houses", "odps", "odcs", "feeders", "chain")
