from corpus_pipeline import STAGES, run
from tests.llm.fixtures import awkward
from tests.llm.test_dedup import groups_brute, lower
from tests.llm.test_tokens import check_packing

from strandplan.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_run_equals_a_brute_force_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = quality.vote([t.encode() for _, t in rows], model)
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    last = {lower(t): i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[lower(t)] == i]
    near = groups_brute(rows)
    rows = [(i, t) for i, t in rows if near[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(decontaminate.normalise(x) in decontaminate.normalise(t) for _, x in items)]
    pieces = run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows}
    assert check_packing(rows, pieces) < 0.05


def test_stages_keep_columns_and_bear_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_bear_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in STAGES:
        before = {r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == STAGES[-1][0]:
            assert out.count() >= docs.count()
        else:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count() and {r.text for r in out.collect()} <= before, name
            docs = out
