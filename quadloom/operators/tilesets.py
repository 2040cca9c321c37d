"""Tilesets as tables: statistics, comparison, affected tiles, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_bytes
from .cover import cover
from .encode import FAILED

KEY = ["z", "x", "y"]


def inspect(tiles: DataFrame, data: str = "tile_data") -> DataFrame:
    """One row: tiles, bytes and average bytes (whole), zooms, and both sizes as text."""
    size = F.octet_length(data)
    out = tiles.agg(F.count("*").alias("tiles"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average"), F.min("z").cast("int").alias("min_zoom"), F.max("z").cast("int").alias("max_zoom"))
    whole = F.floor("average").cast("bigint")
    return out.select("tiles", "bytes", format_bytes(F.col("bytes")).alias("size"), whole.alias("average_bytes"), format_bytes(whole).alias("average_size"), "min_zoom", "max_zoom")


def count_by_zoom(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z").agg(F.count("*").alias("tiles")).orderBy("z")


def size_stats(tiles: DataFrame, data: str = "tile_data") -> DataFrame:
    """Bytes in all and on average by zoom."""
    size = F.octet_length(data)
    return tiles.groupBy("z").agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average"))


def compare(a: DataFrame, b: DataFrame, data: str = "tile_data") -> DataFrame:
    """(z, x, y, state) of all tiles of either set; only digests are shuffled, never tile data."""
    side = lambda df, name: df.select(*KEY, F.sha2(F.col(data).cast("binary"), 256).alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(a, "a").join(side(b, "b"), KEY, "full_outer")
    state = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.select(*KEY, state.alias("state"))


def _counts() -> list:
    return [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("added", "removed", "changed", "unchanged")]


def diff_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.when(F.col("state") != "added", 1)).alias("tiles_a"), F.count(F.when(F.col("state") != "removed", 1)).alias("tiles_b"), *_counts())


def diff_by_zoom(compared: DataFrame) -> DataFrame:
    """Counts of the zooms that differ."""
    return compared.groupBy("z").agg(*_counts()[:3]).where("added + removed + changed > 0").orderBy("z")


def metadata_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, state, old, new) of the entries that differ."""
    both = a.select("name", F.col("value").alias("old"), F.lit(True).alias("a")).join(b.select("name", F.col("value").alias("new"), F.lit(True).alias("b")), "name", "full_outer")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.where(F.col("a").isNull() | F.col("b").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select("name", state.alias("state"), "old", "new").orderBy("name")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_anti")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def route(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """Changes by source: every source that shows the layer; derived layers' names stand for their parents.

    sources: (source, layer, shown, min_zoom, max_zoom), a row for each name that a source shows: as many as the configuration has.
    """
    return changes.withColumnRenamed("layer", "shown").join(F.broadcast(sources), "shown")


def affected_tiles(routed: DataFrame, features: DataFrame, few: bool = False) -> DataFrame:
    """(source, z, x, y) that routed changes (source, layer, id, old_bounds, min_zoom, max_zoom) touch: now or before, each once.

    The changes of a batch are few, the features many: features are cut down to those that changes name by their keys alone, before their
    bounds are made, and repeated changes of a feature count once. few: the keys are known to be few enough to broadcast, so features aren't shuffled.
    """
    named = routed.select("source", "layer", "id", "min_zoom", "max_zoom").distinct()
    keys = named.select("layer", "id").distinct()
    current = features.select("layer", "id", F.col("bbox").alias("now")).join(F.broadcast(keys) if few else keys, ["layer", "id"], "left_semi")
    now = named.join(current, ["layer", "id"]).select("source", "min_zoom", "max_zoom", F.col("now").alias("bounds"))
    before = routed.select("source", "min_zoom", "max_zoom", F.col("old_bounds").cast(current.schema["now"].dataType).alias("bounds"))
    places = now.union(before).where("bounds IS NOT NULL").distinct()
    return cover(places, "bounds", F.col("min_zoom"), F.col("max_zoom")).select("source", "z", "x", "y").distinct()


def merge(tiles: DataFrame, affected: DataFrame, fresh: DataFrame) -> DataFrame:
    """tiles after an update: affected ones are replaced by fresh ones, or gone where there is none."""
    kept = tiles.select(*KEY, "tile_data").join(affected.select(*KEY), KEY, "left_anti")
    return kept.unionByName(fresh.select(*KEY, "tile_data"))


def changes_of(affected: DataFrame, fresh: DataFrame) -> DataFrame:
    """(z, x, y, tile_data) of affected tiles, null where the tile is to be deleted. Tiles that couldn't be made are left out, so they stay as they are."""
    layers = F.col("n_layers") if "n_layers" in fresh.columns else F.lit(None).cast("int")
    joined = affected.select(*KEY).join(fresh.select(*KEY, "tile_data", layers.alias("_layers")), KEY, "left")
    return joined.where(F.col("_layers").isNull() | (F.col("_layers") != FAILED)).drop("_layers")
