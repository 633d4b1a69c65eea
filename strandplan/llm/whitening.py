"""Whitening of embeddings by a covariance in compensated arithmetic.

An entry c becomes the whole number floor(256 c).  The fit list holds each distinct vector once.  Sums of its dimensions
are exact whole numbers.  The covariance adds up centred outer products as pairs of doubles (a high and a low part, twice
the digits): differences and products come from error-free transformations, and each block of rows is added as a binary tree
of such sums.  A task keeps one triangle of pairs and returns it in rows; for each row of the triangle the high and low
parts of all tasks are merged on the executors, as a stream.  What reaches the driver is the finished triangle, d (d + 1) / 2
pairs for d dimensions, whatever the number of vectors.  Its eigenvectors come from LAPACK's symmetric solver, which reduces
the matrix to a tridiagonal one and divides and conquers; numpy's ``eigh`` is that routine.

Rows whose vector is null, or holds a null, a NaN or an infinity, are dropped.  Vectors shorter than the longest have zeros
for what they lack (an empty vector is all zeros).  Entries beyond the range of a long are held at its ends.  Repeated rows
give repeated results.  Without any vector there are no rows.  A component without variance has whitened 0 and explained 0,
and no part in identity_error; there are no more components than dimensions.  A deviation beyond the range of a long is
null.  A null vec_id stays null; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import materialise

Pair = tuple[np.ndarray, np.ndarray]

SCALE = 256
#: Doubles in each array of a step.
HELD = 1 << 18
#: Bits of the parts that exact squares are added up from.
_LIMB = 20


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its error (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The same for |a| >= |b| (Dekker)."""
    s = a + b
    return s, b - (s - a)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded product and its error, by splitting the factors in halves (Veltkamp, Dekker)."""

    def halves(x: np.ndarray) -> Pair:
        t = 134217729.0 * x
        high = t - (t - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = quick_two_sum(s, e + t)
    return quick_two_sum(s, e + f)


def multiply(x: Pair, y: Pair) -> Pair:
    p, e = two_product(x[0], y[0])
    return quick_two_sum(p, e + (x[0] * y[1] + x[1] * y[0]))


def tree_sum(x: Pair) -> Pair:
    """The sum over the first axis."""
    high, low = x
    while len(high) > 1:
        half = len(high) // 2
        rest = high[2 * half :], low[2 * half :]
        high, low = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = np.concatenate([high, rest[0]]), np.concatenate([low, rest[1]])
    return high[0], low[0]


def centred(x: np.ndarray, centre: Pair) -> Pair:
    """x - centre, for whole numbers x."""
    high = x.astype(np.float64)
    inside = np.abs(high) < 2.0**62
    low = np.where(inside, x - np.where(inside, high, 0).astype(np.int64), 0).astype(np.float64)
    return add((high, low), (-centre[0], -centre[1]))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sum_batches(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact sums of a task's rows by dimension, as high and low parts of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d), object)
        for batch in batches:
            x = _matrix(batch)
            total += np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(object)
        sums = [pa.array([Decimal(int(v)) for v in part], pa.decimal128(38, 0)) for part in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *sums], ["dimension", "high", "low"])

    return run


def _product_batches(m: int, own: Callable[[np.ndarray], Pair]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Summed products of the ``m`` columns of own(x) with each other over a task's rows, a line of the triangle a row."""
    i, j = np.triu_indices(m)
    block = max(1, HELD // len(i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = (np.zeros(len(i)), np.zeros(len(i))), False
        for batch in batches:
            high, low = own(_matrix(batch))
            for k in range(0, len(high), block):
                h, rest = high[k : k + block], low[k : k + block]
                total, seen = add(total, tree_sum(multiply((h[:, i], rest[:, i]), (h[:, j], rest[:, j])))), True
        if seen:
            yield _lines({int(line): (total[0][i == line], total[1][i == line]) for line in range(m)})

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line of the triangle that a task reads."""
    lines: dict[int, Pair] = {}
    for batch in batches:
        for row in batch.to_pylist():
            x = np.array(row["high"]), np.array(row["low"])
            lines[row["line"]] = add(lines[row["line"]], x) if row["line"] in lines else x
    if lines:
        yield _lines(lines)


def _lines(lines: dict[int, Pair]) -> pa.RecordBatch:
    parts = [pa.array([x[p] for x in lines.values()], pa.list_(pa.float64())) for p in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), *parts], ["line", "high", "low"])


def products(rows: DataFrame, m: int, own: Callable[[np.ndarray], Pair]) -> np.ndarray:
    """The m x m sums over ``rows``(x) of the products of the columns of own(x), rounded to doubles at the end."""
    schema = "line int, high array<double>, low array<double>"
    parts = rows.select("x").mapInArrow(_product_batches(m, own), schema)
    merged = parts.repartition("line").mapInArrow(_merge_batches, schema).collect()
    out = np.zeros((m, m))
    for r in merged:
        out[r.line, r.line :] = out[r.line :, r.line] = np.array(r.high) + np.array(r.low)
    return out


def vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x): whole numbers of the rows whose vector is complete and finite."""
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda c: F.coalesce((c.cast("double") < inf) & (c.cast("double") > -inf), F.lit(False)))
    ends = F.lit(2.0**63), F.lit(-(2.0**63))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, ends[0]), ends[1])).cast("long"))
    return rows.where(F.col(vector).isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), whole.alias("x"))


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    centre: Pair
    #: Columns are the components by falling eigenvalue; those without variance are zero.
    axes: np.ndarray
    scale: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.centre)[0] @ self.axes / self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2."""
        bound = self.n * max(-int(x.min()), int(x.max()), 0) + max(map(abs, self.sums)) if x.size else 0
        if x.shape[1] * bound * bound < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        if bound >= 1 << 3 * _LIMB or x.shape[1] >= 1 << 23:
            return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        y = np.abs(self.n * x - np.array(self.sums, np.int64))
        limbs = [(y >> (_LIMB * k)) & ((1 << _LIMB) - 1) for k in range(3)]
        total = np.zeros(len(x), object)
        for a in range(3):
            for b in range(3):
                total += (limbs[a] * limbs[b]).sum(axis=1).astype(object) << (_LIMB * (a + b))
        return total.tolist()


def fit(distinct: DataFrame, d: int, components: int) -> Whitening:
    """Learn from distinct(x), every vector of ``d`` entries, at least one row."""
    found = distinct.select("x").mapInArrow(_sum_batches(d), "dimension int, high decimal(38,0), low decimal(38,0)")
    found = found.groupBy("dimension").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("dimension").collect()
    n, sums = distinct.count(), [(int(r.high) << 32) + int(r.low) for r in found]
    means = [Fraction(s, n) for s in sums]
    high = np.array([float(v) for v in means])
    centre = high, np.array([float(v - Fraction(h)) for v, h in zip(means, high.tolist())])
    covariance = products(distinct, d, lambda x: centred(x, centre)) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    varies = values > max(d, 1) * np.finfo(float).eps * values.max(initial=0)
    trace = float(np.trace(covariance))
    made = Whitening(n, sums, centre, np.where(varies, axes, 0), np.where(varies, np.sqrt(np.where(varies, values, 1)), 1), np.where(varies, values / (trace or 1), 0))
    own = int(varies.sum())
    if not own:
        return made

    def with_one(x: np.ndarray) -> Pair:
        y = np.hstack([made.whitened(x)[:, :own], np.ones((len(x), 1))])
        return y, np.zeros_like(y)

    mean = products(distinct, own + 1, with_one)[-1, :own] / n

    def about_mean(x: np.ndarray) -> Pair:
        return two_sum(made.whitened(x)[:, :own], -mean)

    return replace(made, identity_error=float(np.abs(products(distinct, own, about_mean) / n - np.eye(own)).max()))


def _apply_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Whitening = shared.value
        k = made.axes.shape[1]
        for batch in batches:
            x = _matrix(batch)
            deviation = [v if v < 1 << 63 else None for v in made.deviations(x)]
            again = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column("vec_id").take(again),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(deviation, pa.int64()).take(again),
                pa.array(made.whitened(x).ravel()),
                pa.array(np.tile(made.explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])

    return run


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each complete vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[vec_id]
    whole = materialise(vectors(rows, vec_id, vector), "whitening-rows")
    d = whole.agg(F.max(F.size("x"))).first()[0]
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not d:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    whole = whole.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))).alias("x"))
    made = fit(materialise(whole.select("x").distinct(), "whitening-distinct"), d, components)
    shared = spark.sparkContext.broadcast(made)
    out = whole.mapInArrow(_apply_batches(shared), f"vec_id {kind}, component int, deviation long, whitened double, explained double")
    return out.withColumns({"n": F.lit(made.n).cast("long"), "identity_error": F.lit(made.identity_error)}).select(*columns)
