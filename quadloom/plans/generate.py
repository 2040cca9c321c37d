"""Generating a source's tiles, and regenerating those that changes touch."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Layer, Source
from ..functions import shapes
from ..functions.text import base_layer
from ..operators import encode as E
from ..operators import tilesets
from ..operators.cover import features_of_tiles, tiles_of_features
from ..sources import layers as L
from ..sources import mbtiles

#: How a layer's table is found.
Tables = Callable[[Layer], DataFrame] | Mapping[str, DataFrame]


def catalog_tables(spark: SparkSession) -> Callable[[Layer], DataFrame]:
    """Tables of the session's catalog: schema.table, or the plain name where there is no such schema."""

    def find(layer: Layer) -> DataFrame:
        full = f"{layer.schema}.{layer.table}"
        return spark.table(full if spark.catalog.tableExists(full) else layer.table)

    return find


def _table(tables: Tables, layer: Layer) -> DataFrame:
    return tables[layer.table] if isinstance(tables, Mapping) else tables(layer)


def source_features(source: Source, tables: Tables) -> DataFrame:
    """Features of all layers of a source, derived ones among them; `parent` is the geometry that decides on tiles."""
    out = None
    for layer in source.layers:
        one = L.with_derived(L.scan(_table(tables, layer), layer), layer)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"source {source.name} has no layers")
    return out


def placed_features(features: DataFrame, source: Source) -> DataFrame:
    """Features by tile, with `drawn` as each zoom shows them. Tiles are decided by the unsimplified parent geometry."""
    if not any(one.simplify_tolerance for one in source.layers):
        return tiles_of_features(features.withColumn("drawn", F.col("geometry")), source.min_zoom, source.max_zoom, "parent")
    drawn = E.simplify_by_zoom(features, source.min_zoom, source.max_zoom, source.layers)
    return tiles_of_features(drawn, F.col("zoom"), F.col("zoom"), "parent").drop("zoom")


def generate(source: Source, tables: Tables, mercator: bool = False, restart: bool = False) -> DataFrame:
    """(z, x, y, tile_data, n_features, n_layers) of all tiles that any feature touches."""
    placed = placed_features(E.coded(source_features(source, tables)), source)
    return E.encode(placed, source.layers, "drawn", mercator=mercator, restart=restart)


def regenerate(source: Source, tables: Tables, affected: DataFrame) -> DataFrame:
    """The tiles of generate() among affected (z, x, y, each once), from the features that touch them alone; those that can't be written have null data."""
    placed = features_of_tiles(E.coded(source_features(source, tables)), affected, source.min_zoom, source.max_zoom, "parent")
    drawn = F.col("geometry")
    if any(one.simplify_tolerance for one in source.layers):
        drawn = shapes.simplify(drawn, E.tolerance_at(F.col("layer"), F.col("z"), source.layers))
    return E.encode(placed.withColumn("drawn", drawn), source.layers, "drawn", skip_failed=True)


def bounds_of(features: DataFrame) -> tuple[float, float, float, float] | None:
    """The bounds of all features; None if there are none."""
    b = F.col("bbox")
    row = features.agg(F.min(b["min_lon"]), F.min(b["min_lat"]), F.max(b["max_lon"]), F.max(b["max_lat"])).first()
    return None if row[0] is None else tuple(row)


def shown_layers(spark: SparkSession, config: Config) -> DataFrame:
    """(source, layer, shown, min_zoom, max_zoom): every name that a source shows, and the layer it stands for."""
    rows = [(s.name, layer.name, shown, s.min_zoom, s.max_zoom) for s in config.sources for layer in s.layers for shown in layer.names()]
    return spark.createDataFrame(rows, "source string, layer string, shown string, min_zoom int, max_zoom int")


class Update(NamedTuple):
    """What changes do to a source: tiles with null data where they are to be deleted, and the update_complete event. Call release() when both are used."""

    changed: DataFrame
    event: DataFrame
    release: Callable[[], object]


#: Keys of changed features to broadcast have so many rows at most.
BROADCAST_KEYS = 100_000


def update(spark: SparkSession, config: Config, tables: Tables, changes: DataFrame, previous: DataFrame | None = None) -> dict[str, Update]:
    """An update for each source of changes (layer, id, old_bounds).

    previous: features as they were, for changes that bring no old bounds. Routed changes are kept, so that they are made once for all sources.
    """
    routed = tilesets.route(changes, shown_layers(spark, config))
    if previous is not None:
        old = previous.select("layer", "id", F.col("bbox").alias("before"))
        routed = routed.join(old, ["layer", "id"], "left").withColumn("old_bounds", F.coalesce("old_bounds", "before")).drop("before")
    routed = routed.persist()
    few = routed.count() <= BROADCAST_KEYS
    out = {}
    for source in config.sources:
        own = routed.where(F.col("source") == source.name)
        features = source_features(source, tables)
        named = features.where(F.col("layer").isin([x.name for x in source.layers]))
        affected = tilesets.affected_tiles(own, named, few).select("z", "x", "y").persist()
        changed = tilesets.changes_of(affected, regenerate(source, tables, affected))
        names = own.agg(F.array_sort(F.collect_set(base_layer(F.col("layer")))).alias("layers_affected"))
        zooms = affected.agg(F.lit("update_complete").alias("event"), F.lit(source.name).alias("source"), F.count("*").alias("tiles_updated"), F.array_sort(F.collect_set("z")).alias("affected_zooms"))
        event = zooms.join(names.withColumn("source", F.lit(source.name)), "source").withColumn("max_zoom", F.lit(source.max_zoom)).where("tiles_updated > 0")
        out[source.name] = Update(changed, event, lambda affected=affected: (affected.unpersist(), routed.unpersist()))
    return out


def write_mbtiles(source: Source, tiles: DataFrame, path: str) -> int:
    return mbtiles.write_tiles(tiles, path, mbtiles.default_metadata(source.name, source.min_zoom, source.max_zoom))
