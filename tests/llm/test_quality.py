import zlib

from tests.llm.fixtures import DOCUMENTS, awkward, documents

from strandplan.llm import quality
from strandplan.llm.queries import op5_quality_classifier

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(p == y for _, p, y in held) / len(held) > 0.93


def test_vote_matches_brute_force(spark):
    texts = ["plain words here", "plain other words", "### $$$ %%%", "&&& ### %%%", "more plain prose", "### more"]
    df = documents(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, quality.Settings(neighbours=2))
    at, np = model.settings, quality.np
    for r in quality.with_score(df, model, "__score").collect():
        x = quality.features(r.text.encode(), at) * model.weights
        x = (x / np.linalg.norm(x)) @ model.axes - model.centre
        cosine = model.vectors @ x / np.linalg.norm(x)
        top = np.argsort(-cosine)[:2]
        w = np.exp((cosine[top] - cosine[top].max()) / at.temperature)
        assert abs(r["__score"] - (w * model.labels[top]).sum() / w.sum()) < 1e-3


def test_awkward_rows_and_labels(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (2, 0, 0), (2, 0, 1), (None, 1, 0), (5, 0, 0), (99, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(df, labels).columns == df.columns
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], DOCUMENTS), labels).count() == 0


def test_a_repeated_doc_id_is_learnt_once(spark):
    rows = [(i, f"plain words {i}") for i in range(6)] + [(2, f"copy {k}") for k in range(50)] + [(3, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    at = quality.Settings(max_labelled=4)
    models = [quality.fit(documents(spark, r), labels, at) for r in (rows, rows[::-1])]
    assert len(models[0].labels) == 4 and (models[0].vectors == models[1].vectors).all()


def test_texts_beyond_a_piece_are_read_whole():
    at, np = quality.Settings(), quality.np
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, (1 << 21) + 12345, dtype=np.uint8))
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    mixed = (raw[:-2] * quality._MULTIPLIERS[0]) ^ ((raw[1:-1] + np.uint32(257)) * quality._MULTIPLIERS[1]) ^ ((raw[2:] + np.uint32(65537)) * quality._MULTIPLIERS[2])
    mixed ^= mixed >> np.uint32(15)
    mixed *= quality._MULTIPLIERS[1]
    counts = np.bincount(mixed >> np.uint32(32 - int(np.log2(at.buckets))), minlength=at.buckets)
    assert np.allclose(quality.features(text, at)[: at.buckets], np.log1p(counts))
