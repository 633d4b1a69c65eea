"""Numbers in the order of a key without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.lineage import materialise


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with ``name``, their number from 1 in an order; of rows that are equal in it, any.

    Rows are dealt out in ranges of the order, numbered within them, and the sizes of the ranges before are added; only
    these sizes, one for each range, are collected.
    """
    part = "__range"
    ranged = materialise(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = sorted((r[part], r["count"]) for r in ranged.groupBy(part).count().collect())
    before, so_far = {}, 0
    for k, size in sizes:
        before[k], so_far = so_far, so_far + size
    offset = rows.sparkSession.createDataFrame(list(before.items()), f"{part} int, __before long")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(offset), part).select(*rows.columns, (own + F.col("__before")).alias(name))
