"""Connected components of a large graph by alternating star contractions, as joins and groupings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import materialise

#: Edges that a task contracts at once.
HELD = 1 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges``(u long, v long); a component is named by its smallest node.

    Loops and repeated edges are allowed, nulls are not edges.  Each task first replaces the edges that it reads by stars,
    and those of as many tasks as hold ``HELD`` edges together are contracted once more; what fits in one is done then.
    Every further round replaces the edges by ones to smaller
    neighbours and writes them to the shared folder; it ends when a round changes nothing, which takes a number of
    rounds logarithmic in the size of the largest component.
    """
    stars = materialise(edges.where("u <> v").select("u", "v").mapInArrow(_star_batches, "u long, v long"), "components")
    tasks = max(1, -(-stars.count() // HELD))
    stars = materialise(stars.coalesce(tasks).mapInArrow(_star_batches, "u long, v long"), "components")
    before = _signature(stars) if tasks == 1 else None
    while (now := _signature(stars)) != before:
        before = now
        stars = materialise(_small_star(_large_star(stars)), "components")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())


def _stars(ends: np.ndarray) -> np.ndarray:
    """Nodes and the smallest that the edges (two rows) connect them to, where it is another."""
    nodes, place = np.unique(ends, return_inverse=True)
    u, v = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]])


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def contracted() -> pa.RecordBatch:
        u, v = _stars(np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()]))
        if sum(x.shape[1] for x in held) >= HELD:
            yield contracted()
            held.clear()
    if held:
        yield contracted()


def _signature(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = stars.union(stars.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
