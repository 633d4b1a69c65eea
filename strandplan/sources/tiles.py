"""Map features kept in Parquet by tile, so that reading an area opens only its tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.functions import geo
from strandplan.lineage import materialise


def write_tiles(features: DataFrame, path: str, columns: list[str]) -> None:
    """Features with lat and lon, the ``columns`` that they have, in a folder for each tile."""
    kept = [c for c in columns if c in features.columns]
    placed = features.select(*dict.fromkeys([*kept, "lat", "lon"]), geo.tile("lon").alias("tile_x"), geo.tile("lat").alias("tile_y"))
    placed.repartition("tile_x", "tile_y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)


def read_tiles(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features within a box, bounds included; tiles outside are pruned."""
    n = geo.TILES_PER_DEGREE
    tiles = F.col("tile_x").between(int(west * n // 1), int(east * n // 1)) & F.col("tile_y").between(int(south * n // 1), int(north * n // 1))
    found = spark.read.parquet(path).where(tiles & F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return found.drop("tile_x", "tile_y")


def tagged(features: DataFrame, key: str, values: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Features with a tag, of some value if ``values`` are given, and of some kinds of geometry."""
    tag: Column = F.try_element_at("tags", F.lit(key))
    found = features.where(tag.isin(values) if values else tag.isNotNull())
    return found.where(F.col("geom_type").isin(kinds)) if kinds else found


def without_styles(properties: str | Column) -> Column:
    """A feature's properties but for its style references."""
    return F.map_filter(properties, lambda k, _: ~k.isin("styleUrl", "styleHash"))


def tiles_of(spark: SparkSession, west: float, south: float, east: float, north: float) -> DataFrame:
    """(tile_x, tile_y) of every tile that a box meets."""
    n = geo.TILES_PER_DEGREE
    columns = spark.range(int(west * n // 1), int(east * n // 1) + 1).withColumnRenamed("id", "tile_x")
    rows = F.explode(F.sequence(F.lit(int(south * n // 1)).cast("long"), F.lit(int(north * n // 1)).cast("long")))
    return columns.select("tile_x", rows.alias("tile_y"))


class TileStore:
    """Features by tile, fetched once: a folder of tiles and a manifest of those that are held, empty ones too."""

    def __init__(self, spark: SparkSession, path: str, columns: str) -> None:
        """``columns``: the schema of the features that are kept; lat and lon are always among them."""
        self.spark, self.features, self.manifest = spark, f"{path}/features", f"{path}/manifest"
        names = {c.strip().split()[0] for c in columns.split(",")}
        self.schema = ", ".join([columns, *(f"{c} double" for c in ("lat", "lon") if c not in names)])

    def _read(self, path: str, schema: str) -> DataFrame:
        """The table at a path, an empty one before the first write."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def held(self) -> DataFrame:
        """(tile_x, tile_y, fetch, features): which fetch brought each tile and how many features it has."""
        return self._read(self.manifest, "tile_x long, tile_y long, fetch int, features long")

    def missing(self, *box: float) -> DataFrame:
        """Tiles of a box (west, south, east, north) that aren't held."""
        return tiles_of(self.spark, *box).join(self.held().select("tile_x", "tile_y"), ["tile_x", "tile_y"], "left_anti")

    def fetch(self, source: Callable[[DataFrame], DataFrame], *box: float) -> int:
        """Get what ``source`` gives for the missing tiles (of which it gets the table) and return their number.

        Only their partitions are written, as a dynamic overwrite, so a fetch that was cut short is done again
        without doubles; the manifest is written last.
        """
        wanted = materialise(self.missing(*box), "tile-store-missing")
        count = wanted.count()
        if count:
            n = (self.held().agg(F.max("fetch")).first()[0] or 0) + 1
            names = [c.strip().split()[0] for c in self.schema.split(",")]
            given = source(wanted).select(*names).withColumns({"tile_x": geo.tile("lon"), "tile_y": geo.tile("lat")})
            own = given.join(wanted, ["tile_x", "tile_y"], "left_semi").select(*names, "tile_x", "tile_y")
            own.repartition("tile_x", "tile_y").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_x", "tile_y").parquet(self.features)
            sizes = self._stored().join(wanted, ["tile_x", "tile_y"], "left_semi").groupBy("tile_x", "tile_y").agg(F.count("*").alias("features"))
            rows = wanted.join(sizes, ["tile_x", "tile_y"], "left").select("tile_x", "tile_y", F.lit(n).alias("fetch"), F.coalesce("features", F.lit(0).cast("long")).alias("features"))
            rows.coalesce(1).write.mode("append").parquet(self.manifest)
        return count

    def _stored(self) -> DataFrame:
        return self._read(self.features, f"{self.schema}, tile_x long, tile_y long")

    def read(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """Features within a box, bounds included, of the tiles that are held; others aren't opened."""
        n = geo.TILES_PER_DEGREE
        tiles = F.col("tile_x").between(int(west * n // 1), int(east * n // 1)) & F.col("tile_y").between(int(south * n // 1), int(north * n // 1))
        return self._stored().where(tiles & F.col("lon").between(west, east) & F.col("lat").between(south, north)).drop("tile_x", "tile_y")
