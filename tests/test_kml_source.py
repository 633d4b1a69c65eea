"""The KML data source: streams, schemas, partitions, errors, commits."""

import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandplan.sources import kml, kml_source
from tests.test_files import KML, folder  # noqa: F401


@pytest.fixture(scope="module")
def source(spark):
    kml_source.register(spark)
    return spark.read.format("kml")


def rows_of(df, *columns):
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_reads_what_whole_trees_give(spark, source, folder):  # noqa: F811
    os.makedirs(f"{folder}/_hidden")
    with open(f"{folder}/_hidden/x.kml", "w") as f:
        f.write(KML)
    tree = kml.read_placemarks(spark, f"{folder}/*.[kK]*").withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    read = source.load(folder)
    columns = ["path", "place", "id", "name", "description", "folders", "geom_type", "line", "extended"]
    good = F.col("error").isNull()
    assert rows_of(read.where(good), *columns) == rows_of(tree.where(good), *columns) and read.where(good).count() == 10
    assert rows_of(read.where(~good), "path", "place") == rows_of(tree.where(~good), "path", "place") and read.where(~good).count() == 3


def test_only_asked_for_columns_and_geometries(spark, folder):  # noqa: F811
    read = spark.read.format("kml").schema("name string, path string").option("geometry", "Point, LineString")
    assert sorted(r.name or "" for r in read.load(f"{folder}/a.kml").collect()) == ["", "POP one", "cable"]
    reader = kml_source.KmlReader(kml_source.StructType.fromDDL("name string"), {"path": f"{folder}/a.kml"})
    assert all(r["line"] is None and "extended" not in r for f in reader.partitions() for e, n in kml_source.stream(open(f.paths[0], "rb")) for r in reader._rows("", e, n))
    place = spark.read.format("kml").option("geometry", "LineString").load(f"{folder}/a.kml").first()
    assert place.place == 4 and [tuple(p) for p in place.line] == [(0.0, 0.0), (1.0, 1.0)]


def test_partitions_hold_several_files(folder):  # noqa: F811
    size = os.path.getsize(f"{folder}/a.kml")
    schema = kml_source.StructType.fromDDL(kml_source.SCHEMA)
    counts = {most: [len(p.paths) for p in kml_source.KmlReader(schema, {"path": folder, "bytesperpartition": str(most)}).partitions()] for most in (1, 2 * size, 1 << 20)}
    assert counts[1] == [1] * 5 and counts[1 << 20] == [5] and 1 < len(counts[2 * size]) < 5


def test_errors(spark, folder, tmp_path):  # noqa: F811
    with pytest.raises(PySparkException):
        spark.read.format("kml").option("mode", "failfast").load(folder).collect()
    with pytest.raises(PySparkException):
        spark.read.format("kml").load(f"{tmp_path}/nothing").collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("kml").load(f"{tmp_path}/empty").count() == 0


def test_a_stream_holds_one_placemark(tmp_path):
    path = tmp_path / "large.kml"
    with open(path, "w") as f:
        f.write('<k:kml xmlns:k="http://www.opengis.net/kml/2.2"><k:Folder><k:name>a<![CDATA[ & b]]></k:name>')
        for n in range(20_000):
            f.write(f"<k:Placemark><k:name>{n}</k:name><k:Point><k:coordinates>{n / 1000},1</k:coordinates></k:Point></k:Placemark>")
        f.write("</k:Folder></k:kml>")
    seen = 0
    with open(path, "rb") as file:
        for element, folders in kml_source.stream(file, 4096):
            assert folders == ["a & b"] and kml._text(kml._child(element, "name")) == str(seen)
            if not seen:
                assert file.tell() == 4096
            seen += 1
    assert seen == 20_000


MARKS = [("one", 0, ["A"], "p & q", "x\ny", "Point", [(1.5, 2.25)]), ("one", 1, ["A", "B"], "l", None, "LineString", [(0.1, 0.2), (0.3, 1e-7)]), ("one", 2, [], "z", None, "Point", [(1.0, 1.0)]), ("two", 0, [], "é", None, "Point", [(3.0, 4.0)])]


def marks(spark, rows=MARKS):
    schema = "f string, seq int, folders array<string>, name string, description string, geom_type string, coords array<struct<lon: double, lat: double>>"
    return spark.createDataFrame(rows, schema).withColumns({"colour": F.lit("red"), "size": F.lit(1.0)})


@pytest.mark.parametrize("kmz", [False, True])
def test_round_trip_and_overwrite(spark, source, tmp_path, kmz):
    path = f"{tmp_path}/out"
    kml_source.written(marks(spark), "f", "seq", path, kmz)
    end = "kmz" if kmz else "kml"
    assert sorted(os.listdir(path)) == [f"one.{end}", f"two.{end}"] and (not kmz or zipfile.ZipFile(f"{path}/one.kmz").namelist() == ["doc.kml"])
    got = {(os.path.basename(r.path)[:3], r.place): r for r in source.load(path).collect()}
    for f, seq, folders, name, description, kind, coords in MARKS:
        r = got.pop((f, seq))
        assert (r.folders, r.name, r.description, r.geom_type, [tuple(p) for p in r.line]) == (folders, name, description, kind, coords)
    assert not got
    kml_source.written(marks(spark, MARKS[3:]), "f", "seq", path, kmz)
    assert os.listdir(path) == [f"two.{end}"]


def test_nothing_is_left_of_a_failed_write(spark, tmp_path):
    path = f"{tmp_path}/out"
    kml_source.written(marks(spark), "f", "seq", path)
    fail = marks(spark).withColumn("name", F.when(F.col("f") == "two", F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(PySparkException):
        kml_source.written(fail.where("seq < 1"), "f", "seq", path)
    rows = marks(spark).select(F.col("f").alias("file"), "folders", "name", "description", "geom_type", "coords", "colour", "size")
    with pytest.raises(PySparkException):
        rows.union(rows).repartition(2).write.format("kml").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["one.kml", "two.kml"] and spark.read.format("kml").load(path).count() == 4
