"""Every query that has SQL against DuckDB over the smallest tables; the others at least run."""

import math
import os

import duckdb
import pytest

from strandplan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(x):
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, (bool, int, float)):
        return None if isinstance(x, float) and math.isnan(x) else float(x)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(map(value, r)) for r in want.fetchall()), key=str)
    assert sorted((tuple(value(r[c]) for c in columns) for r in rows), key=str) == expected


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_llm_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/strandplan"):
        if "llm" not in folder:
            assert not any("strandplan.llm" in open(f"{folder}/{n}").read() for n in names if n.endswith(".py"))
