"""KML and KMZ files: every placemark with its folders, and the points, boundaries and design points among them."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.functions import geo, labels

PLACEMARKS = "path string, place int, id string, name string, description string, folders array<string>, geom_type string, coordinates string, extended map<string,string>, error string"
_GEOMETRIES = ("Point", "LineString", "Polygon")


def kml_bytes(path: str, content: bytes) -> bytes:
    """The file itself, or the first .kml member of a .kmz."""
    if not path.lower().endswith(".kmz"):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        member = next((n for n in archive.namelist() if n.lower().endswith(".kml")), None)
        if member is None:
            raise ValueError("the archive has no .kml member")
        return archive.read(member)


def _tag(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _child(element: ET.Element, tag: str) -> ET.Element | None:
    return next((e for e in element if _tag(e) == tag), None)


def _text(element: ET.Element | None) -> str | None:
    return None if element is None or element.text is None else element.text.strip()


def placemarks_of(path: str, content: bytes) -> list[tuple]:
    """A row for each geometry, in document order; one row with an error for a file that can't be read.

    A file with a document type declaration counts as such, so that no entities are expanded.
    """
    try:
        raw = kml_bytes(path, content)
        if b"<!DOCTYPE" in raw[:4096].upper() or b"<!ENTITY" in raw.upper():
            raise ValueError("document type declarations are not read")
        root = ET.fromstring(raw)
    except (ValueError, ET.ParseError, zipfile.BadZipFile) as e:
        return [(path, 0, None, None, None, [], None, None, {}, str(e))]
    rows: list[tuple] = []
    stack: list[tuple[ET.Element, list[str]]] = [(root, [])]
    while stack:
        element, folders = stack.pop()
        if _tag(element) == "Placemark":
            data = {d.get("name"): _text(d if _tag(d) == "SimpleData" else _child(d, "value")) for d in element.iter() if _tag(d) in ("SimpleData", "Data") and d.get("name")}
            for shape in (e for e in element.iter() if _tag(e) in _GEOMETRIES):
                line = next((e for e in shape.iter() if _tag(e) == "coordinates"), None)  # of a polygon the outer ring
                if line is not None:
                    rows.append((path, len(rows), element.get("id"), _text(_child(element, "name")), _text(_child(element, "description")), folders, _tag(shape), _text(line) or "", data, None))
        else:
            inner = folders + [_text(_child(element, "name")) or ""] if _tag(element) == "Folder" else folders
            stack += [(e, inner) for e in reversed(element)]
    return rows


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PLACEMARKS.split(", ")]
    for batch in batches:
        rows = [r for path, content in zip(batch["path"], batch["content"], strict=True) for r in placemarks_of(path, content)]
        yield pd.DataFrame(rows, columns=columns)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """All placemarks of the files at ``path``, with their parsed line; a file is one row of the scan."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(_parse, PLACEMARKS)
    return found.withColumn("line", geo.parse_coordinates("coordinates")).drop("coordinates")


def points(placemarks: DataFrame, default: str = "POP") -> DataFrame:
    """(path, place, name, lon, lat) of every point."""
    at = F.element_at("line", 1)
    found = placemarks.where("geom_type = 'Point' AND size(line) > 0")
    return found.select("path", "place", labels.name_or("name", default).alias("name"), at.lon.alias("lon"), at.lat.alias("lat"))


def boundaries(placemarks: DataFrame) -> DataFrame:
    """(path, ring): the first polygon's outer ring of every file that has one."""
    found = placemarks.where("geom_type = 'Polygon' AND size(line) > 0")
    return found.groupBy("path").agg(F.min_by("line", "place").alias("ring"))


def houses(placemarks: DataFrame, ring: DataFrame | None = None) -> DataFrame:
    """Points as houses; with ring(ring), one row, only those strictly inside of it."""
    found = points(placemarks, "")
    if ring is None:
        return found
    joined = found.join(F.broadcast(ring.select("ring").limit(1)))
    return joined.where(geo.contains("ring", "lon", "lat")).drop("ring")


def design_points(placemarks: DataFrame) -> DataFrame:
    """(path, place, kind, name, lon, lat) of the points whose names tell their kind."""
    found = points(placemarks, "Unknown").withColumn("kind", labels.mapping_kind("name"))
    return found.where("kind IS NOT NULL").select("path", "place", "kind", "name", "lon", "lat")


def folder_tree(placemarks: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth, path_ids, name, geom_type): folders and placemarks of every file as a tree.

    Ids follow from the file, the folders' names and, for placemarks, the place in the file.
    """
    def node(depth):
        return F.sha2(F.concat_ws("\x1f", "path", F.slice("folders", 1, depth)), 256)

    levels = F.when(F.size("folders") > 0, F.sequence(F.lit(1), F.size("folders"))).otherwise(F.array().cast("array<int>"))
    folders = placemarks.select("path", "folders", F.explode(levels).alias("depth"))
    ids = F.transform(F.sequence(F.lit(1), F.col("depth")), node)
    folders = folders.select(ids.alias("path_ids"), "depth", F.element_at("folders", F.col("depth")).alias("name"), F.lit(None).cast("string").alias("geom_type")).distinct()
    leaf = F.sha2(F.concat_ws("\x1f", "path", F.col("place").cast("string"), F.lit("leaf")), 256)
    leaves = placemarks.select(F.concat(F.transform(levels, node), F.array(leaf)).alias("path_ids"), (F.size("folders") + 1).alias("depth"), "name", "geom_type")
    both = folders.unionByName(leaves)
    return both.select(F.element_at("path_ids", -1).alias("node_id"), F.try_element_at("path_ids", F.lit(-2)).alias("parent_id"), "depth", "path_ids", "name", "geom_type")


def expired(spark: SparkSession, path: str, now, seconds: int = 3600) -> DataFrame:
    """(path, modificationTime): map and report files last changed more than so many seconds before ``now``."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    old = F.unix_timestamp(now) - F.unix_timestamp("modificationTime") > seconds
    return files.where(F.lower("path").rlike(r"\.(kml|kmz|csv)$") & old)
