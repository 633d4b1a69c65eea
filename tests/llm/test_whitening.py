import random
from fractions import Fraction

import numpy as np
import pytest

from strandplan.llm import whitening as wh
from strandplan.llm.queries import op13_embedding_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [int(np.floor(256 * float(c))) for c in v]


def check(rows, vectors, tolerance=1e-9):
    """Against exact fractions for what is exact, and a covariance from exact fractions for the rest."""
    d = max(map(len, vectors.values()))
    x = {k: whole(v) + [0] * (d - len(v)) for k, v in vectors.items()}
    distinct = sorted(set(map(tuple, x.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[n * v - s for v, s in zip(row, sums)] for row in distinct], object)
    covariance = (centred.T @ centred) * Fraction(1, n**3)
    v = covariance.astype(float)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:4]
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((k, c + 1) for k in x for c in range(min(4, d)))
    by = {(r.vec_id, r.component): r for r in rows}
    for c, o in enumerate(order):
        got = np.array([by[k, c + 1].whitened for k in sorted(x)])
        want = np.array([float(sum(Fraction(n * e - s, n) * Fraction(float(a)) for e, s, a in zip(x[k], sums, axes[:, o]))) for k in sorted(x)]) / np.sqrt(values[o])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < tolerance
    for (k, c), r in by.items():
        assert r.n == n and r.deviation == sum((n * e - s) ** 2 for e, s in zip(x[k], sums))
        assert r.explained == pytest.approx(values[order[c - 1]] / float(np.trace(v)), rel=1e-10) and r.identity_error < 1e-9


def test_a_whole_table(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(op13_embedding_whitening(spark, SF).collect(), vectors)


def test_a_large_mean_loses_no_digits(spark):
    rng = random.Random(1)
    vectors = {i: [3e9 + rng.gauss(0, 5), rng.gauss(0, 3), -1e8 + rng.gauss(0, 0.5), rng.gauss(0, 1), 7.0] for i in range(400)}
    rows = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(7)
    check(wh.whiten(rows).collect(), vectors, 1e-7)


def test_copies_count_once_and_incomplete_rows_go(spark):
    rng = random.Random(2)
    vectors = {i: [float(np.float32(rng.gauss(0, 1))) for _ in range(6)] for i in range(60)}
    vectors |= {100 + i: vectors[0] for i in range(300)} | {500: [], 501: [0.5, -0.25]} | {502: [-0.0] * 6}
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [0.0, float("-inf")])]
    rows = spark.createDataFrame([(i, v, 0) for i, v in [*vectors.items(), *bad]], SCHEMA)
    for name in ("x", "n", "component", "line", "__x"):
        rows = rows.withColumn(name, rows.label)
    check(wh.whiten(rows).collect(), vectors)
    again = wh.whiten(rows.union(rows)).collect()
    assert len(again) == 8 * len(vectors) and {r.n for r in again} == {r.n for r in wh.whiten(rows).collect()}


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    assert wh.whiten(empty).count() == 0 and wh.whiten(empty).schema.names == wh.whiten(one).schema.names
    rows = wh.whiten(one).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained) for r in rows) == sorted((i, c, 1, 0, 0.0, 0.0) for i in ("1", "None") for c in (1, 2))
    assert wh.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0


def test_dependent_dimensions_have_fewer_components(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(50)], SCHEMA)
    out = wh.whiten(rows).collect()
    assert {r.whitened for r in out if r.component > 1} == {0.0} and all(r.identity_error < 1e-9 for r in out)


def test_extreme_entries_do_not_fail(spark):
    rows = spark.createDataFrame([(1, [3.4e38, 1.0], 0), (2, [-3.4e38, 2.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    out = wh.whiten(rows).collect()
    assert len(out) == 6 and {r.deviation for r in out if r.vec_id < 3} == {None}


def test_error_free_steps():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 500)) * 10.0 ** rng.integers(-12, 12, (2, 500))
    for (high, low), op in ((wh.two_sum(a, b), Fraction.__add__), (wh.two_product(a, b), Fraction.__mul__)):
        assert all(Fraction(h) + Fraction(e) == op(Fraction(x), Fraction(y)) for h, e, x, y in zip(high, low, a, b))
    high, low = wh.tree_sum((a, b * 1e-30))
    exact = sum(map(Fraction, a)) + sum(map(Fraction, b * 1e-30))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - exact) <= abs(exact) * Fraction(1, 10**27)


@pytest.mark.parametrize("scale", [3, 10**4, 10**8, 10**15, 10**18])
def test_deviations_are_exact(scale):
    rng = random.Random(scale)
    x = np.array([[rng.randint(-scale, scale) for _ in range(9)] for _ in range(30)], np.int64)
    n, sums = 31, [rng.randint(-30 * scale, 30 * scale) for _ in range(9)]
    made = wh.Whitening(n, sums, (np.zeros(9), np.zeros(9)), np.zeros((9, 1)), np.ones(1), np.ones(1))
    assert made.deviations(x) == [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
