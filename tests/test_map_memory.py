"""Documents are written as their placemarks come, without holding these."""

import io
import tracemalloc
import zipfile

import pyarrow as pa

from strandplan.sources import sinks


def batches(many, rows=1000):
    kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    for design in (1, 2):
        for k in range(many):
            at = range(k * rows, (k + 1) * rows)
            coords = pa.array([[{"lon": 112.7 + n / 1e6, "lat": -7.2 - n / 3e6}] for n in at], kind)
            yield pa.record_batch(
                {"design": pa.array([design] * rows, pa.int32()), "folders": [["ODC 1", "HC"]] * rows, "name": [f"01/01-{n}" for n in at], "description": ["Induk ODP: 01/01 & so on"] * rows,
                 "geom_type": ["Point"] * rows, "coords": coords, "colour": ["green"] * rows, "size": [0.6] * rows}
            )


def test_task_holds_little_more_than_the_files():
    tracemalloc.start()
    sizes = []
    for batch in sinks.files_of("design", pa.int32())(batches(40)):
        sizes.append(batch.nbytes)
        assert batch.schema.names == ["design", "kml", "kmz"] and batch.num_rows == 1
        last = batch
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(sizes) == 2 and min(sizes) > 10_000_000
    assert peak < 3 * max(sizes) + 8_000_000  # the last one's files and those being written
    row = last.to_pylist()[0]
    assert row["kml"].count("<Placemark>") == 40_000 and row["kml"].count("<Folder ") == 2
    assert zipfile.ZipFile(io.BytesIO(row["kmz"])).read("doc.kml").decode() == row["kml"]
