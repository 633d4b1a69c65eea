"""KML and KMZ files as a data source of Spark: ``spark.read.format("kml")`` and ``df.write.format("kml")``.

Reading: a partition holds several files, up to ``bytesPerPartition`` together, and a file is parsed as a stream that keeps
one placemark and the open folders at a time.  Only the columns of the schema that is asked for are made, so
``.schema("path string, name string")`` parses no coordinates.  Options: ``geometry`` (names, comma-separated: other
geometries are skipped), ``mode`` (``permissive``: an unreadable file is one row with its error; ``failfast``),
``bytesPerPartition``.  A file that declares a document type is unreadable, so no entities are expanded; whether a file
can be read to its end is looked at before its first row is given.  A folder's name must stand before its placemarks.

Writing: rows (file, folders, name, description, geom_type, coords, colour, size) of a file must come to one task in their
order; each file is written as a stream under a name of its own and gets its place when all tasks are done, so a lost or
repeated task leaves nothing behind.  Options: ``kmz`` (true: zipped).  ``overwrite`` takes the folder's other KML and KMZ
files away at the end.

Files are reached through pyarrow's file systems, from the driver and the executors alike (a shared folder, S3, GCS or HDFS).
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby
from types import SimpleNamespace
from xml.etree import ElementTree
from xml.parsers import expat

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from strandplan.sources import kml, sinks

SCHEMA = "path string, place int, id string, name string, description string, folders array<string>, geom_type string, line array<struct<lon: double, lat: double>>, extended map<string,string>, error string"
WRITTEN = "file string, folders array<string>, name string, description string, geom_type string, coords array<struct<lon: double, lat: double>>, colour string, size double"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[fs.FileInfo]:
    """The KML and KMZ files at or below a path, by name; hidden ones and what is not yet in place are left out."""
    store, root = place_of(path)
    at = store.get_file_info(root)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".kml", ".kmz"))]
    return sorted((f for f in kept if not any(p.startswith((".", "_")) for p in f.path.removeprefix(root).split("/"))), key=lambda f: f.path)


class _Placemarks:
    """Handlers of an XML stream: elements of one placemark as a tree, folders as their names."""

    def __init__(self) -> None:
        self.folders: list[str] = []
        self.open: list[str] = []
        self.tree: ElementTree.TreeBuilder | None = None
        self.depth = 0
        self.name: list[str] | None = None
        self.done: list[tuple[ElementTree.Element, list[str]]] = []

    def parser(self):
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self._start, self._end, self._text
        parser.StartDoctypeDeclHandler = self._doctype
        return parser

    def _doctype(self, *_) -> None:
        raise ValueError("document type declarations are not read")

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        tag = tag.rpartition(":")[2]
        if self.tree is None and tag == "Placemark":
            self.tree, self.depth = ElementTree.TreeBuilder(), 0
        if self.tree is not None:
            self.tree.start(tag, attributes)
            self.depth += 1
            return
        if tag == "Folder":
            self.folders.append("")
        elif tag == "name" and self.open and self.open[-1] == "Folder":
            self.name = []
        self.open.append(tag)

    def _text(self, text: str) -> None:
        if self.tree is not None:
            self.tree.data(text)
        elif self.name is not None:
            self.name.append(text)

    def _end(self, tag: str) -> None:
        if self.tree is not None:
            self.tree.end(tag.rpartition(":")[2])
            self.depth -= 1
            if not self.depth:
                self.done.append((self.tree.close(), list(self.folders)))
                self.tree = None
            return
        tag = self.open.pop()
        if tag == "Folder":
            self.folders.pop()
        elif tag == "name" and self.name is not None:
            self.folders[-1], self.name = "".join(self.name).strip(), None


def stream(file, step: int = 1 << 16) -> Iterator[tuple[ElementTree.Element, list[str]]]:
    """(placemark, names of its folders) of an open KML file, one after another."""
    held = _Placemarks()
    parser = held.parser()
    while block := file.read(step):
        parser.Parse(block, False)
        yield from held.done
        held.done.clear()
    parser.Parse(b"", True)
    yield from held.done


@contextmanager
def opened(store: fs.FileSystem, path: str):
    """The KML stream of a file: itself, or the first .kml member of an archive."""
    with store.open_input_file(path) as file:
        if not path.lower().endswith(".kmz"):
            yield file
            return
        with zipfile.ZipFile(file) as archive:
            member = next((n for n in archive.namelist() if n.lower().endswith(".kml")), None)
            if member is None:
                raise ValueError("the archive has no .kml member")
            with archive.open(member) as inner:
                yield inner


def line_of(text: str | None) -> list[Row]:
    """Vertices of coordinates as text; what isn't two numbers at least is left out."""
    out = []
    for part in (text or "").split():
        try:
            lon, lat = map(float, part.split(",")[:2])
        except ValueError:
            continue
        out.append(Row(lon=lon, lat=lat))
    return out


@dataclass
class Files(InputPartition):
    paths: list[str]


class KmlReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.path = schema.names, options["path"]
        self.most = int(options.get("bytesperpartition", 16 << 20))
        self.kinds = {k.strip() for k in options["geometry"].split(",")} if "geometry" in options else None
        self.failfast = options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[Files]:
        out, size = [], 0
        for file in listed(self.path):
            if not out or size + (file.size or 0) > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(file.path)
            size += file.size or 0
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = place_of(self.path)
        for path in partition.paths:
            try:
                with opened(store, path) as file:
                    for _ in stream(file):
                        pass
            except (ValueError, expat.ExpatError, zipfile.BadZipFile) as e:
                if self.failfast:
                    raise ValueError(f"{path}: {e}") from e
                yield tuple({"path": path, "place": 0, "folders": [], "extended": {}, "error": str(e)}.get(c) for c in self.columns)
                continue
            with opened(store, path) as file:
                place = 0
                for element, folders in stream(file):
                    for row in self._rows(path, element, folders):
                        if self.kinds is None or row["geom_type"] in self.kinds:
                            yield tuple(row[c](place) if callable(row[c]) else row[c] for c in self.columns)
                        place += 1

    def _rows(self, path: str, element: ElementTree.Element, folders: list[str]) -> Iterator[dict]:
        wanted = set(self.columns)
        shared = {"path": path, "place": lambda n: n, "id": element.get("id"), "folders": folders, "error": None}
        shared |= {c: kml._text(kml._child(element, c)) for c in ("name", "description") if c in wanted}
        if "extended" in wanted:
            named = (d for d in element.iter() if d.tag in ("SimpleData", "Data") and d.get("name"))
            shared["extended"] = {d.get("name"): kml._text(d if d.tag == "SimpleData" else kml._child(d, "value")) for d in named}
        for shape in (e for e in element.iter() if e.tag in kml._GEOMETRIES):
            line = next((e for e in shape.iter() if e.tag == "coordinates"), None)  # of a polygon the outer ring
            if line is not None:
                yield shared | {"geom_type": shape.tag, "line": line_of(line.text) if "line" in wanted else None}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class KmlWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        missing = {c.split()[0] for c in WRITTEN.split(", ") if ": " not in c} - {*schema.names, "lat"}
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.kmz = options["path"], overwrite, options.get("kmz", "false").lower() == "true"
        self.waiting = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = place_of(self.path)
        folder = f"{root}/{self.waiting}/{uuid.uuid4().hex}"
        store.create_dir(folder)
        out = []
        for name, own in groupby(rows, key=lambda r: r["file"]):
            if not name or "/" in name or name in {n for _, n in out}:
                raise ValueError(f"{name!r}: a file needs a name of its own, and its rows in one task, one after another")
            placed = f"{name}.{'kmz' if self.kmz else 'kml'}"
            text = sinks.document_parts(SimpleNamespace(name_=r["name"], size_=r["size"], **{c: r[c] for c in ("folders", "description", "geom_type", "coords", "colour")}) for r in own)
            with store.open_output_stream(f"{folder}/{placed}") as file:
                if self.kmz:
                    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(zipfile.ZipInfo("doc.kml"), "w", force_zip64=True) as inner:
                        _put(inner, text)
                else:
                    _put(file, text)
            out.append((f"{folder}/{placed}", name))
        return Written([(f, f"{root}/{f.rpartition('/')[2]}") for f, _ in out])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place_of(self.path)
        files = [f for m in messages if m for f in m.files]
        twice = [p for p, n in Counter(p for _, p in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"more than one task wrote {', '.join(sorted(twice)[:3])}")
        store.create_dir(root)
        old = {f.path for f in listed(self.path)} if self.overwrite else set()
        for made, placed in files:
            store.move(made, placed)
        for path in old - {p for _, p in files}:
            store.delete_file(path)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place_of(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.waiting}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.waiting}")


def _put(file, text: Iterator[str], step: int = 1 << 16) -> None:
    held = io.StringIO()
    for part in text:
        held.write(part)
        if held.tell() >= step:
            file.write(held.getvalue().encode())
            held.seek(0)
            held.truncate()
    file.write(held.getvalue().encode())


class KmlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> KmlReader:
        return KmlReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> KmlWriter:
        return KmlWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Let ``format("kml")`` mean this source in the session."""
    spark.dataSource.register(KmlDataSource)


def written(placemarks: DataFrame, file: str, order: str, path: str, kmz: bool = False) -> None:
    """Write placemarks as files named by column ``file``, each one's rows sorted by ``order``."""
    register(placemarks.sparkSession)
    columns = [c.split()[0] for c in WRITTEN.split(", ") if not c.startswith("lat:")][1:]
    rows = placemarks.withColumn("file", placemarks[file].cast("string")).repartition("file").sortWithinPartitions("file", order)
    rows.select("file", *columns).write.format("kml").option("kmz", kmz).mode("overwrite").save(path)
