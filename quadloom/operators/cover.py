"""Tile covers: from bounds to the tiles they touch, and the spatial join of features with tiles built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tiles as T


def _range(low: Column, high: Column) -> Column:
    """The numbers from low to high, none if low is larger or null."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _limits(bounds: Column, z: Column, widened: bool) -> tuple[Column, Column, Column, Column]:
    """First and last x and y of the tiles of bounds; widened: with a tile more where a bound lies exactly on an edge."""
    most = T.last_tile(z)
    hold = lambda v: F.least(v, most)
    x0, x1 = hold(T.tile_x(bounds["min_lon"], z)), hold(T.tile_x(bounds["max_lon"], z))
    y0, y1 = hold(T.tile_y(bounds["max_lat"], z)), hold(T.tile_y(bounds["min_lat"], z))
    if widened:
        on_west = T.tile_lon(x0, z) >= bounds["min_lon"]
        on_north = T.tile_lat(y0, z) <= bounds["max_lat"]
        # Rounding may also put an edge's own latitude into the tile before it.
        on_south = T.tile_lat(y1 + 1, z) >= bounds["min_lat"]
        on_east = T.tile_lon(x1 + 1, z) <= bounds["max_lon"]
        x0 = F.greatest(F.when(on_west, x0 - 1).otherwise(x0), F.lit(0).cast("bigint"))
        y0 = F.greatest(F.when(on_north, y0 - 1).otherwise(y0), F.lit(0).cast("bigint"))
        x1, y1 = hold(F.when(on_east, x1 + 1).otherwise(x1)), hold(F.when(on_south, y1 + 1).otherwise(y1))
    return x0, x1, y0, y1


def cover(rows: DataFrame, bounds: str, min_zoom: int | Column, max_zoom: int | Column, widened: bool = False) -> DataFrame:
    """rows with the columns z, x, y, once for each tile that the bounds touch. Bounds whose minimum is beyond their maximum touch none."""
    z0, z1 = (F.lit(v) if isinstance(v, int) else v for v in (min_zoom, max_zoom))
    zoomed = rows.where(F.col(bounds).isNotNull()).withColumn("z", F.explode(F.when(z0 <= z1, F.sequence(z0.cast("int"), z1.cast("int")))))
    x0, x1, y0, y1 = _limits(F.col(bounds), F.col("z"), widened)
    ranged = zoomed.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1})
    columns = ranged.withColumn("x", F.explode(_range(F.col("_x0"), F.col("_x1"))))
    return columns.withColumn("y", F.explode(_range(F.col("_y0"), F.col("_y1")))).drop("_x0", "_x1", "_y0", "_y1")


def tiles_of_features(features: DataFrame, min_zoom: int | Column, max_zoom: int | Column, geometry: str = "geometry", bounds: str = "bbox") -> DataFrame:
    """The spatial join of features with all tiles of the zooms: features with z, x, y, where the geometry meets the closed tile.

    Each feature brings its own candidates, so there is no tile table, no shuffle and no nested loop. Bounds decide where
    they miss a tile or lie in it, as a point's always do; the geometry is looked at for the rest.
    """
    candidates = cover(features, bounds, min_zoom, max_zoom, widened=True)
    return _meeting(candidates, geometry, bounds)


def _meeting(candidates: DataFrame, geometry: str, bounds: str) -> DataFrame:
    """The candidates whose geometry meets the closed tile z, x, y."""
    tile = T.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    b = F.col(bounds)
    near = (b["min_lon"] <= tile["max_lon"]) & (b["max_lon"] >= tile["min_lon"]) & (b["min_lat"] <= tile["max_lat"]) & (b["max_lat"] >= tile["min_lat"])
    inside = (b["min_lon"] >= tile["min_lon"]) & (b["max_lon"] <= tile["max_lon"]) & (b["min_lat"] >= tile["min_lat"]) & (b["max_lat"] <= tile["max_lat"])
    return candidates.where(near & (inside | G.intersects_box(F.col(geometry), tile)))


#: Tiles of zooms beyond this one find their features by their ancestors at it; tables of tiles to broadcast have so many rows at most.
COARSE, BROADCAST_TILES = 7, 20_000


def features_of_tiles(features: DataFrame, tiles: DataFrame, min_zoom: int, max_zoom: int, geometry: str = "geometry", bounds: str = "bbox") -> DataFrame:
    """The spatial join of features with given tiles (z, x, y, each once): features with z, x, y, as tiles_of_features has them for those tiles.

    Bounds are covered at the coarse zooms alone, and what is tested exactly is a feature and a given tile below one of its coarse
    tiles. So the work beyond coarse zooms follows the tiles that are given, however deep they lie. The tiles are counted; if few they are broadcast.
    """
    top = min(max_zoom, max(min_zoom, COARSE))
    up = F.greatest(F.col("z") - top, F.lit(0))
    wanted = tiles.select(F.col("z").cast("int").alias("z"), "x", "y").where(F.col("z").between(min_zoom, max_zoom))
    keyed = wanted.select((F.col("z") - up).cast("int").alias("_z"), F.expr(f"shiftright(x, greatest(z - {top}, 0))").alias("_x"), F.expr(f"shiftright(y, greatest(z - {top}, 0))").alias("_y"), "z", "x", "y")
    keyed = F.broadcast(keyed) if wanted.count() <= BROADCAST_TILES else keyed
    covered = cover(features, bounds, min_zoom, top, widened=True).withColumnsRenamed({"z": "_z", "x": "_x", "y": "_y"})
    return _meeting(covered.join(keyed, ["_z", "_x", "_y"]).drop("_z", "_x", "_y"), geometry, bounds)


def features_in_bounds(features: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Features that meet a box, by their bounds first. Where bounds are stored as columns, files are skipped by them."""
    box = F.struct(F.lit(min_lon).alias("min_lon"), F.lit(min_lat).alias("min_lat"), F.lit(max_lon).alias("max_lon"), F.lit(max_lat).alias("max_lat"))
    b = F.col("bbox")
    near = (b["min_lon"] <= max_lon) & (b["max_lon"] >= min_lon) & (b["min_lat"] <= max_lat) & (b["max_lat"] >= min_lat)
    return features.where(near).where(G.intersects_box(F.col("geometry"), box))
