"""Web-map tile mathematics on columns. Longitudes and latitudes are degrees; y grows southwards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest unsigned 32-bit number, at which tile numbers saturate.
MOST = 4294967295.0
EXTENT = 4096


def _count(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def _saturated(value: Column) -> Column:
    """A tile number of a double: rounded down, held between 0 and MOST; NaN is 0."""
    held = F.least(F.greatest(value, F.lit(0.0)), F.lit(MOST))
    return F.when(F.isnan(value), F.lit(0).cast("bigint")).otherwise(F.floor(held).cast("bigint"))


def tile_x(lon: Column, z: Column) -> Column:
    return _saturated((lon + 180.0) / 360.0 * _count(z))


def tile_y(lat: Column, z: Column) -> Column:
    return _saturated((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * _count(z))


def last_tile(z: Column) -> Column:
    return F.floor(_count(z)).cast("bigint") - 1


def tms_flip(y: Column, z: Column) -> Column:
    """The row number counted from the other side; null where y lies outside the zoom."""
    return F.when((y >= 0) & (y <= last_tile(z)), last_tile(z) - y)


def tile_lon(x: Column, z: Column) -> Column:
    """Longitude of a tile's western edge."""
    return x / _count(z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    """Latitude of a tile's northern edge."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * y / _count(z)))))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of a tile."""
    return F.struct(tile_lon(x, z).alias("min_lon"), tile_lat(y + 1, z).alias("min_lat"), tile_lon(x + 1, z).alias("max_lon"), tile_lat(y, z).alias("max_lat"))


def _truncated(value: Column) -> Column:
    """Towards zero, held within 32 bits; NaN is 0."""
    return F.when(F.isnan(value), 0).otherwise(F.least(F.greatest(value, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int"))


def local_x(lon: Column, bounds: Column, extent: int = EXTENT) -> Column:
    return _truncated((lon - bounds["min_lon"]) / (bounds["max_lon"] - bounds["min_lon"]) * float(extent))


def local_y(lat: Column, bounds: Column, extent: int = EXTENT) -> Column:
    """Linear in latitude within the tile."""
    return _truncated((bounds["max_lat"] - lat) / (bounds["max_lat"] - bounds["min_lat"]) * float(extent))


def down_tile_mercator(lat: Column, y: Column, z: Column) -> Column:
    """The share of a tile's height above a latitude, linear in the projection."""
    return (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * _count(z) - y


def local_y_mercator(lat: Column, y: Column, z: Column, extent: int = EXTENT) -> Column:
    """Linear in the projection, as maps draw it."""
    return _truncated(down_tile_mercator(lat, y, z) * float(extent))


def simplification_tolerance(base: Column, z: Column) -> Column:
    """A layer's tolerance at a zoom: it doubles with each zoom below 18."""
    return base * F.pow(F.lit(2.0), F.greatest(F.lit(18) - z, F.lit(0)))
