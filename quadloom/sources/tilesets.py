"""Parquet tilesets: (z, x, y, tile_data) partitioned by zoom, so reads of a zoom read no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tiles import tms_flip


def write_tileset(tiles: DataFrame, path: str) -> None:
    """Within a zoom tiles are dealt out and sorted by place, so row groups can be skipped."""
    tiles.select("z", "x", "y", "tile_data").repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y").write.mode("overwrite").partitionBy("z").parquet(path)


def read_tileset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("z").cast("int").alias("z"), "x", "y", "tile_data")


def replace_zooms(tiles: DataFrame, path: str) -> None:
    """Overwrites only the zooms that tiles hold."""
    tiles.select("x", "y", "tile_data", "z").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("z").parquet(path)


def get_tile(tiles: DataFrame, z: int, x: int, y: int) -> DataFrame:
    return tiles.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))


def get_tile_tms(tiles: DataFrame, z: int, x: int, row: int) -> DataFrame:
    return get_tile(tiles, z, x, (1 << z) - 1 - row)


def keys(tiles: DataFrame) -> DataFrame:
    """The tiles' keys with their TMS rows, in order."""
    row: Column = tms_flip(F.col("y"), F.col("z"))
    return tiles.select("z", "x", row.alias("tile_row")).orderBy("z", "x", "tile_row")
