import zipfile

import pytest
from pyspark.sql import functions as F

from strandplan.operators import design
from strandplan.plans import catalog
from strandplan.sources import kml, sinks

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>A &amp; B</name>
<Placemark id="p1"><name>POP one</name><Point><coordinates>112.75,-7.25,0</coordinates></Point></Placemark>
<Placemark><Point><coordinates> 1,2 </coordinates></Point><ExtendedData><SchemaData><SimpleData name="k">v</SimpleData></SchemaData></ExtendedData></Placemark>
<Folder><name>In</name><Placemark><name>zone</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,4 0,0</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><name>second</name><Polygon><outerBoundaryIs><LinearRing><coordinates>9,9 8,8 7,9</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder></Folder>
<Placemark><name>cable</name><LineString><coordinates>0,0,1 1,1,1</coordinates></LineString></Placemark></Document></kml>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "b.KMZ", "w") as z:
        z.writestr("x.txt", "no")
        z.writestr("doc.kml", KML)
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("x.txt", "no")
    (tmp_path / "d.kml").write_text("<kml><broken>")
    (tmp_path / "e.kml").write_text('<!DOCTYPE x [<!ENTITY e "ee">]><kml>&e;</kml>')
    return str(tmp_path)


def test_placemarks(spark, folder):
    rows = kml.read_placemarks(spark, folder).collect()
    by = {n: sorted((r for r in rows if r.path.endswith(n)), key=lambda r: r.place) for n in ("a.kml", "b.KMZ", "c.kmz", "d.kml", "e.kml")}
    assert [(r.name, r.geom_type, r.folders) for r in by["a.kml"]] == [("POP one", "Point", ["A & B"]), (None, "Point", ["A & B"]), ("zone", "Polygon", ["A & B", "In"]), ("second", "Polygon", ["A & B", "In"]), ("cable", "LineString", [])]
    assert len(by["b.KMZ"]) == 5 and by["a.kml"][1].extended == {"k": "v"} and by["a.kml"][0].id == "p1"
    assert all(len(by[n]) == 1 and by[n][0].error for n in ("c.kmz", "d.kml", "e.kml"))


def test_points_boundaries_and_houses(spark, folder):
    marks = kml.read_placemarks(spark, f"{folder}/a.kml")
    assert [(r.name, r.lon, r.lat) for r in kml.points(marks).orderBy("place").collect()] == [("POP one", 112.75, -7.25), ("POP", 1.0, 2.0)]
    ring = kml.boundaries(marks)
    assert len(ring.first().ring) == 5
    assert [(r.lon, r.lat) for r in kml.houses(marks, ring).collect()] == [(1.0, 2.0)]
    assert [(r.kind, r.name) for r in kml.design_points(marks).collect()] == [("olt", "POP one")]
    tree = kml.folder_tree(marks).collect()
    ids = {r.node_id: r for r in tree}
    assert len(tree) == 7 and sum(r.parent_id is None for r in tree) == 2
    assert all(r.parent_id is None or r.parent_id in ids for r in tree)


def test_expired_files(spark, folder):
    later = F.current_timestamp() + F.expr("INTERVAL 2 HOURS")
    assert kml.expired(spark, folder, later).count() == 5 and kml.expired(spark, folder, F.current_timestamp()).count() == 0


def test_design_to_kml_and_back(spark, tmp_path):
    made = catalog._dealt(spark, "/root/testdata/sf0.001")
    made = {k: v.where("design = 3") for k, v in made.items()}
    marks = design.placemarks(made, "design")
    files = sinks.documents(marks, "design").collect()
    (tmp_path / "x.kmz").write_bytes(bytes(files[0].kmz))
    (tmp_path / "x.kml").write_text(files[0].kml)
    back = kml.read_placemarks(spark, str(tmp_path))
    n = marks.count()
    assert back.count() == 2 * n and back.where("error IS NOT NULL").count() == 0
    want = sorted((r.name, r.geom_type, list(r.folders), [tuple(p) for p in r.coords]) for r in marks.collect())
    got = sorted((r.name, r.geom_type, r.folders, [tuple(p) for p in r.line]) for r in back.where("path LIKE '%kmz'").collect())
    assert got == want
    whole = sinks.merged(spark.createDataFrame([(2, files[0].kml), (1, files[0].kml)], "n int, kml string"), "n").first().kml
    assert len(kml.placemarks_of("m.kml", whole.encode())) == 2 * n


def test_state_and_bill_files(spark, tmp_path):
    made = catalog._dealt(spark, "/root/testdata/sf0.001")
    sinks.write_bill(design.bill_of_materials(made, "design"), f"{tmp_path}/bill", "design")
    read = spark.read.option("header", True).csv(f"{tmp_path}/bill")
    assert read.columns == ["Tipe", "Nama", "Kuantitas/Panjang", "Satuan", "Latitude", "Longitude", "design"]
    houses = catalog.QUERIES["state_round_trip"](spark, "/root/testdata/sf0.001")
    assert sorted((r.lat, r.lon) for r in houses.collect()) == sorted((r.lat, r.lon) for r in made["house"].collect())
    (tmp_path / "s.json").write_text('{"design":"1","odcs":[{"id":"a","lat":1.0,"lon":2.0,"odps":[{"id":"b","lat":1.0,"lon":2.0,"houses":[]}]}]}')
    read = sinks.read_states(spark, f"{tmp_path}/s.json")
    assert read["odc"].first().splitter_ratio == "1:4" and read["odp"].first().splitter_location == "ODP" and read["house"].count() == 0
