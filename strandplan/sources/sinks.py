"""KML, KMZ and CSV files of designs, and design states as JSON."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from types import SimpleNamespace
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: KML colours as alpha, blue, green, red.
COLOURS = {"red": "ff0000ff", "blue": "ffff0000", "green": "ff008000", "gray": "ff808080", "white": "ffffffff"}

STATE = (
    "design string, pop struct<name: string, lon: double, lat: double>, odcs array<struct<id: string, lat: double, lon: double, closure_id: string,"
    " splitter_ratio: string, splitter_location: string, odps array<struct<id: string, lat: double, lon: double, splitter_ratio: string,"
    " splitter_location: string, houses: array<struct<lat: double, lon: double>>>>>>"
).replace("odps array", "odps: array")


def _placemark(row) -> str:
    colour = COLOURS.get(row.colour, "ffffffff")
    style = f"<IconStyle><color>{colour}</color><scale>{row.size_}</scale></IconStyle>" if row.geom_type == "Point" else f"<LineStyle><color>{colour}</color><width>{row.size_}</width></LineStyle>"
    coordinates = " ".join(f"{p['lon']!r},{p['lat']!r},0" for p in row.coords)
    description = f"<description>{escape(row.description)}</description>" if row.description else ""
    return f"<Placemark><name>{escape(row.name_)}</name>{description}<Style>{style}</Style><{row.geom_type}><coordinates>{coordinates}</coordinates></{row.geom_type}></Placemark>"


def document_parts(rows: Iterable) -> Iterator[str]:
    """The KML document of placemarks in their order, piece by piece; successive ones of a folder share it."""
    yield '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    open_folders: list[str] = []
    for folders, group in groupby(rows, key=lambda r: list(r.folders)):
        shared = 0
        while shared < min(len(folders), len(open_folders)) and folders[shared] == open_folders[shared]:
            shared += 1
        yield "</Folder>" * (len(open_folders) - shared)
        for n in range(shared, len(folders)):
            yield f"<Folder id={quoteattr('/'.join(folders[: n + 1]))}><name>{escape(folders[n])}</name>"
        yield from map(_placemark, group)
        open_folders = folders
    yield "</Folder>" * len(open_folders) + "</Document></kml>"


def document(rows: list) -> str:
    return "".join(document_parts(rows))


def _marks(batches: Iterator[pa.RecordBatch], design: str) -> Iterator[tuple[object, SimpleNamespace]]:
    for row in (row for batch in batches for k in range(0, batch.num_rows, 1000) for row in batch.slice(k, 1000).to_pylist()):
        yield row[design], SimpleNamespace(name_=row["name"], size_=row["size"], **{c: row[c] for c in ("folders", "description", "geom_type", "coords", "colour")})


def _cell(content: bytearray, kind: pa.DataType) -> pa.Array:
    """One text or binary value over the content's own memory."""
    sizes = pa.py_buffer(struct.pack("<2i", 0, len(content)))
    return pa.Array.from_buffers(kind, 1, [None, sizes, pa.py_buffer(content)])


def files_of(design: str, placed: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row of a design's two files for all its placemarks, which follow each other in the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(_marks(batches, design), key=lambda r: r[0]):
            text, packed = bytearray(), io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(zipfile.ZipInfo("doc.kml"), "w", force_zip64=True) as inner:
                for piece in _pieces(document_parts(mark for _, mark in own)):
                    text += piece
                    inner.write(piece)
            yield pa.RecordBatch.from_arrays([pa.array([key], placed), _cell(text, pa.string()), _cell(packed.getbuffer(), pa.binary())], [design, "kml", "kmz"])

    return run


def documents(placemarks: DataFrame, design: str) -> DataFrame:
    """(design, kml, kmz): one file's content for each design, whose placemarks come to one task in their order.

    They are written and packed as they come, so a task holds little more than one design's two files.
    """
    kind = dict(placemarks.dtypes)[design]
    columns = ["folders", "name", "description", "geom_type", "coords", "colour", "size"]
    run = files_of(design, to_arrow_type(placemarks.schema[design].dataType))
    ordered = placemarks.repartition(design).sortWithinPartitions(design, "seq").select(design, *columns)
    return ordered.mapInArrow(run, f"{design} {kind}, kml string, kmz binary")


def _pieces(parts: Iterable[str], step: int = 1 << 16) -> Iterator[bytes]:
    """The parts' bytes, many parts at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= step:
            yield "".join(held).encode()
            held, size = [], 0
    yield "".join(held).encode()


def merged(files: DataFrame, *order: str) -> DataFrame:
    """(kml) one document of all placemarks of ``files``' rows kml, in order, doubles kept.

    The body of every document is taken whole, so this is meant for as many files as one document should hold.
    """
    body = F.regexp_extract("kml", "(?s)<Document[^>]*>(.*)</Document>", 1)
    rows = files.select(F.struct(*order, body.alias("__body")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["__body"])
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    return rows.agg(F.concat(F.lit(head), F.array_join(parts, ""), F.lit("</Document></kml>")).alias("kml"))


def write_bill(bill: DataFrame, path: str, design: str) -> None:
    """CSV files of bill rows in their order, a folder for each design; metres with two decimals."""
    columns = [F.col("type").alias("Tipe"), F.col("name").alias("Nama"), F.round("quantity", 2).alias("Kuantitas/Panjang"), F.col("unit").alias("Satuan"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude")]
    ordered = bill.repartition(design).sortWithinPartitions(design, "section", "i", "j", "k", "sub")
    ordered.select(design, *columns).write.partitionBy(design).option("header", True).csv(path)


def states(made: dict[str, DataFrame], design: str, pop: tuple) -> DataFrame:
    """Nested states of the designs, as :data:`STATE` has them."""
    place = [F.col("lat").alias("lat"), F.col("lon").alias("lon")]
    own = F.transform(F.array_sort(F.collect_list(F.struct("k", *place))), lambda h: F.struct(h.lat.alias("lat"), h.lon.alias("lon")))
    houses = made["house"].groupBy(design, "odp_seq").agg(own.alias("houses_"))
    odp = made["odp"].join(houses, [design, "odp_seq"], "left").select(design, "i", F.struct("j", F.format_string("ODP-%03d", "odp_seq").alias("id"), *place, F.lit("1:8").alias("splitter_ratio"), F.lit("ODP").alias("splitter_location"), F.coalesce("houses_", F.array().cast("array<struct<lat:double,lon:double>>")).alias("houses")).alias("odp"))
    odps = odp.groupBy(design, "i").agg(F.transform(F.array_sort(F.collect_list("odp")), lambda o: o.dropFields("j")).alias("odps_"))
    odc = made["odc"].join(odps, [design, "i"]).select(design, F.struct("i", F.format_string("ODC-%03d", "i").alias("id"), *place, F.format_string("CL-%03d", "i").alias("closure_id"), F.lit("1:4").alias("splitter_ratio"), F.lit("ODC").alias("splitter_location"), F.col("odps_").alias("odps")).alias("odc"))
    out = odc.groupBy(design).agg(F.transform(F.array_sort(F.collect_list("odc")), lambda o: o.dropFields("i")).alias("odcs"))
    centre = F.struct(F.lit(pop[0]).alias("name"), F.lit(float(pop[2])).alias("lon"), F.lit(float(pop[1])).alias("lat"))
    return out.select(F.col(design).cast("string").alias("design"), centre.alias("pop"), "odcs")


def read_states(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """house, odp and odc tables of JSON states; splitters that are missing get their defaults."""
    state = spark.read.schema(STATE).json(path)
    odc = state.select("design", F.posexplode("odcs").alias("i", "odc")).withColumn("i", F.col("i") + 1)
    odp = odc.select("design", "i", F.posexplode("odc.odps").alias("j", "odp")).withColumn("j", F.col("j") + 1)
    house = odp.select("design", "i", "j", F.posexplode("odp.houses").alias("k", "house")).withColumn("k", F.col("k") + 1)
    return {
        "odc": odc.select("design", "i", "odc.id", "odc.lat", "odc.lon", "odc.closure_id", F.coalesce("odc.splitter_ratio", F.lit("1:4")).alias("splitter_ratio"), F.coalesce("odc.splitter_location", F.lit("ODC")).alias("splitter_location")),
        "odp": odp.select("design", "i", "j", "odp.id", "odp.lat", "odp.lon", F.coalesce("odp.splitter_ratio", F.lit("1:8")).alias("splitter_ratio"), F.coalesce("odp.splitter_location", F.lit("ODP")).alias("splitter_location")),
        "house": house.select("design", "i", "j", "k", "house.lat", "house.lon"),
    }
