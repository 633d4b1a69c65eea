"""Road tables cut by an adaptive quadtree and composed again.

A source of roads that answers only for areas of at most so many nodes is asked cell by cell; a cell that holds more is
cut in four.  Each cell answers with the edges that have an end in it and with both of their nodes, so edges over a seam,
and the nodes at their other ends, come from more than one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandplan.lineage import materialise

#: Cuts at most; places that still share a cell then stay together.
DEEPEST = 20
#: The level at which places are counted first.
HALFWAY = 10


def _code(axes: tuple[Column, Column]) -> Column:
    """Bits of x and y by turns: the first ones tell the cell of a coarse level, more of them a finer one."""
    def bit(c: Column, b: int) -> Column:
        return F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long"))

    x, y = axes
    return reduce(Column.__add__, (F.shiftleft(bit(x, b), 2 * b) + F.shiftleft(bit(y, b), 2 * b + 1) for b in range(DEEPEST)))


def placed(nodes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """``nodes`` with their code within a box; what lies outside counts as on its edge."""
    most = (1 << DEEPEST) - 1

    def axis(c: str, low: float, high: float) -> Column:
        share = (F.col(c) - low) / max(high - low, 1e-12) * (1 << DEEPEST)
        return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(share))).cast("long")

    return nodes.withColumn("code", _code((axis("lon", west, east), axis("lat", south, north))))


def quadtree(coded: DataFrame, most: int) -> DataFrame:
    """(level, prefix, cell, nodes): the cells that cover all of coded(code), with at most ``most`` nodes unless at the last level.

    ``cell`` orders cells from south-west to north-east.  Counts of the upper levels come from one grouping at ``HALFWAY``,
    those of the levels below from the codes in cells that are too full there, and a cell is kept if it isn't too full and
    the one around it was.
    """
    def counted(by_code: DataFrame, low: int, high: int) -> DataFrame:
        levels = by_code.select("nodes", "code", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level"))
        return levels.groupBy("level", _prefix("code", "level").alias("prefix")).agg(F.sum("nodes").alias("nodes"))

    coarse = F.shiftleft(F.shiftright("code", 2 * (DEEPEST - HALFWAY)), 2 * (DEEPEST - HALFWAY))
    halfway = materialise(coded.groupBy(coarse.alias("code")).agg(F.count("*").alias("nodes")), "quadtree-halfway")
    crowded = halfway.where(F.col("nodes") > most).select(F.col("code").alias("coarse"))
    deep = coded.select("code", coarse.alias("coarse")).join(crowded, "coarse", "left_semi").groupBy("code").agg(F.count("*").alias("nodes"))
    counts = materialise(counted(halfway, 0, HALFWAY).unionByName(counted(deep, HALFWAY + 1, DEEPEST)), "quadtree-counts")
    full = counts.where(F.col("nodes") > most).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("around"))
    inner = counts.withColumn("around", F.shiftright("prefix", 2)).join(full, ["level", "around"]).drop("around")
    kept = inner.unionByName(counts.where("level = 0")).where((F.col("nodes") <= most) | (F.col("level") == DEEPEST))
    return kept.select("level", "prefix", F.expr(f"shiftleft(prefix, 2 * ({DEEPEST} - level))").alias("cell"), "nodes")


def _prefix(code: str, level: str) -> Column:
    return F.expr(f"shiftright({code}, 2 * ({DEEPEST} - {level}))")


def cells_of(coded: DataFrame, tree: DataFrame) -> DataFrame:
    """``coded`` with the cell of each row: one equality join on the prefixes of the levels that the tree has."""
    levels = sorted(r.level for r in tree.select("level").distinct().collect())
    spread = coded.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")) if levels else coded.withColumn("level", F.lit(0))
    found = spread.withColumn("prefix", _prefix("code", "level")).join(tree.select("level", "prefix", "cell"), ["level", "prefix"])
    return found.select(*coded.columns, "cell")


def cut(nodes: DataFrame, edges: DataFrame, most: int, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Parts of a road table: nodes with their cell, and edges with theirs; both have a row for every cell that answers with them."""
    coded = placed(nodes, *box)
    own = materialise(cells_of(coded, quadtree(coded, most)).drop("code"), "quadtree-nodes")
    at = own.select("node", "cell")
    ends = [edges.join(at.withColumnRenamed("node", end), end).select(*edges.columns, "cell") for end in ("u", "v")]
    parts = materialise(ends[0].unionByName(ends[1]).dropDuplicates(["u", "v", "key", "cell"]), "quadtree-edges")
    seen = parts.select(F.col("u").alias("node"), "cell").union(parts.select("v", "cell")).union(at).distinct()
    return seen.join(nodes, "node").select(*nodes.columns, "cell"), parts


def composed(parts: DataFrame, *keys: str, order: str = "cell") -> DataFrame:
    """One row for each key; of each other column the value of the last cell that has one."""
    others = [c for c in parts.columns if c not in (*keys, order)]
    return parts.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others))
