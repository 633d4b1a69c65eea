"""Shards of nearly equal bytes by sampled splitters.

The key of a row is a hash of its text, so equal texts are neighbours.  A size-weighted sample of keys gives quantile
boundaries of many more ranges than shards, ``most_ranges`` at most; every row falls into a range.  Ranges that turn
out overfull are subdivided by key, and a key that is overfull by itself by a hash of its rows.  Prefix sums over
ranges, over cells within a range and over rows within a cell give each row its exact place among all bytes.  The
place of its middle decides the shard.

Equal texts share a shard, by the middle of their group, unless the group is larger than both the largest row and
``whole`` of a shard; larger groups are cut between rows.  So a shard's bytes are off by the larger of these at most.
Null texts have no bytes, a null doc_id is the smallest.  Repeated rows have places of their own.  With fewer rows than
shards some shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.llm.common import materialise, shuffle_width, whole_text

_CELL = ["range", "part", "hot", "piece"]
_COMMON = -1  # the piece of rows whose key isn't hot


@dataclass(frozen=True)
class Settings:
    shards: int = 24
    #: Fixed part of a row's size.
    overhead: int = 8
    #: Rows that a range should hold at most, and sampled keys to a range.
    range_rows: int = 50_000
    samples: int = 24
    #: Bound on ranges, and so, times ``samples``, on the keys that are sent to the driver.
    most_ranges: int = 8192
    #: Share of a shard up to which equal texts are kept together.
    whole: float = 0.01


def keyed(docs: DataFrame, at: Settings) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every row."""
    text = whole_text()
    size = F.octet_length(text).cast("long") + at.overhead
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def splitters(rows: DataFrame, ranges: int, total: int, at: Settings) -> np.ndarray:
    """Lower bounds (keys) of all ranges but the first, from a sample of about ``samples`` keys a range."""
    chance = F.col("size") * (ranges * at.samples / max(total, 1))
    lot = (F.xxhash64("doc_id", "key", F.lit(4)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")
    drawn = rows.where(lot < chance).groupBy("key").agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("weight")).toArrow()
    key, weight = (drawn.column(c).to_numpy() for c in ("key", "weight"))
    order = np.argsort(key)
    share = np.cumsum(weight[order]) / max(weight.sum(), 1e-300)
    return np.unique(key[order][np.searchsorted(share, np.arange(1, ranges) / ranges).clip(max=len(key) - 1)]) if len(key) else key


def in_ranges(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``rows`` with the column ``range``: how many bounds aren't above the row's key."""
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for key in batches:
            yield pd.Series(np.searchsorted(shared.value, key.to_numpy(), side="right").astype(np.int32))

    return rows.withColumn("range", place("key"))


def subdivided(placed: DataFrame, at: Settings) -> DataFrame:
    """``placed`` with the columns ``part``, ``hot`` and ``piece``, which with the range name a row's cell.

    An overfull range is cut into parts by key.  A key of more than ``range_rows`` rows in it is hot: its rows form
    cells of their own, dealt out by a hash of the row.
    """
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    overfull = sizes.where(F.col("n") > 2 * at.range_rows).withColumn("parts", F.ceil(F.col("n") / at.range_rows).cast("int")).drop("n")
    keys = placed.join(overfull, "range", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    hot = keys.where(F.col("n") > at.range_rows).select("key", F.ceil(F.col("n") / at.range_rows).cast("int").alias("pieces"))
    wide = F.col("most").cast("double") - F.col("least").cast("double") + 1
    part = F.floor((F.col("key").cast("double") - F.col("least").cast("double")) / wide * F.col("parts")).cast("int")
    lot = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("pieces")).cast("int")
    cells = placed.join(overfull, "range", "left").join(materialise(hot, "shard-hot"), "key", "left")
    cells = cells.withColumns({"part": F.coalesce(part, F.lit(0)), "hot": F.when(F.col("pieces").isNull(), F.lit(0).cast("long")).otherwise(F.col("key")), "piece": F.coalesce(lot, F.lit(_COMMON))})
    return cells.drop("parts", "least", "most", "pieces")




def placed_cells(placed: DataFrame) -> DataFrame:
    """(range, part, hot, piece, begin, hot_begin, hot_bytes): where each cell, and all of its hot key, lies among all bytes.

    Ranges have a bounded number, so one task adds them up; cells are added up within their range.
    """
    cells = placed.groupBy(*_CELL).agg(F.sum("size").alias("bytes"))
    ranges = cells.groupBy("range").agg(F.sum("bytes").alias("bytes"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("range_begin"))
    inside = Window.partitionBy("range").orderBy("part", F.col("piece") >= 0, "hot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "part", "hot", F.col("piece") >= 0)
    own = cells.join(ranges, "range").withColumn("begin", F.col("range_begin") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return own.select(*_CELL, "begin", F.min("begin").over(group).alias("hot_begin"), F.sum("bytes").over(group).alias("hot_bytes"))


def shard(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    slot numbers a shard's rows from 0 in the order of their cells and, within a cell, of their keys.
    """
    at, spark = settings, docs.sparkSession
    rows = materialise(keyed(docs, at), "shard-keys")
    count, total, largest = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = min(max(4 * at.shards, shuffle_width(spark), -(-count // (at.range_rows // 2))), at.most_ranges)
    ranged = materialise(in_ranges(rows, splitters(rows, ranges, total, at)), "shard-ranges")
    placed = materialise(subdivided(ranged, at), "shard-cells")

    own = placed.join(placed_cells(placed), _CELL)
    order = Window.partitionBy(*_CELL).orderBy("key", "doc_id", "text_crc32", "size")
    group = Window.partitionBy(*_CELL, "key")
    before = F.col("begin") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    own = own.select("*", before.alias("before"), F.row_number().over(order).alias("rank"))
    group_bytes = F.when(F.col("piece") == _COMMON, F.sum("size").over(group)).otherwise(F.col("hot_bytes"))
    group_begin = F.when(F.col("piece") == _COMMON, F.min("before").over(group)).otherwise(F.col("hot_begin"))
    together = group_bytes <= max(largest, at.whole * total / at.shards)
    middle = F.when(together, group_begin + group_bytes / 2).otherwise(F.col("before") + F.col("size") / 2)
    numbered = own.withColumn("shard", F.least(F.floor(middle * F.lit(at.shards / max(total, 1))), F.lit(at.shards - 1)).cast("int"))
    numbered = materialise(numbered.select("doc_id", "size", "text_crc32", *_CELL, "shard", "rank"), "shard-numbered")

    # A shard's rows within a cell are consecutive, so a row's slot is its rank less what lies before.
    runs = numbered.groupBy("shard", *_CELL).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range", "part", F.col("piece") >= 0, "hot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", *_CELL, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("skip"))
    joined = numbered.join(runs, ["shard", *_CELL])
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("skip")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
