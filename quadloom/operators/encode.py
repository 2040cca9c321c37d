"""Tile encoding: features with tiles become tile data.

What can be done for a feature by itself is done before the shuffle, in arrays of whole batches: rules, tile coordinates, commands, their bytes.
The rows of a tile then stream sorted through a writer that holds the bytes of the tile it writes, nothing else.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Layer
from ..functions import geometry as G
from ..functions import mvt, packed, shapes
from ..functions import tiles as T

TILES = "z int, x bigint, y bigint, tile_data binary, n_features bigint, n_layers int"


def excluded_properties(layer: Column, z: Column, layers: Iterable[Layer]) -> Column:
    """The properties that a layer's rules leave out at a zoom. Derived layers have no rules."""
    out = F.array().cast("array<string>")
    for one in layers:
        dropped = F.array().cast("array<string>")
        for rule in one.property_rules:
            dropped = F.concat(dropped, F.when(z < rule.below_zoom, F.array(*(F.lit(n) for n in rule.exclude))).otherwise(F.array().cast("array<string>")))
        if one.property_rules:
            out = F.when(layer == one.name, F.array_distinct(dropped)).otherwise(out)
    return out


def apply_property_rules(props: Column, layer: Column, z: Column, layers: Iterable[Layer]) -> Column:
    layers = [one for one in layers if one.property_rules]
    if not layers:
        return props
    out = excluded_properties(layer, z, layers)
    return F.map_filter(props, lambda k, _: ~F.array_contains(out, k))


def tolerance_at(layer: Column, z: Column, layers: Iterable[Layer]) -> Column:
    """A layer's simplification tolerance at a zoom; null for layers without, derived ones among them."""
    out = F.lit(None).cast("double")
    for one in layers:
        if one.simplify_tolerance:
            out = F.when(layer == one.name, T.simplification_tolerance(F.lit(float(one.simplify_tolerance)), z)).otherwise(out)
    return out


def simplify_by_zoom(features: DataFrame, min_zoom: int, max_zoom: int, layers: Iterable[Layer]) -> DataFrame:
    """Features once for each zoom, with `drawn`, the geometry as that zoom shows it: simplified once, before tiles multiply it."""
    layers = list(layers)
    zoomed = features.withColumn("zoom", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    if not any(one.simplify_tolerance for one in layers):
        return zoomed.withColumn("drawn", F.col("geometry"))
    return zoomed.withColumn("drawn", shapes.simplify(F.col("geometry"), tolerance_at(F.col("layer"), F.col("zoom"), layers)))


def prepared(placed: DataFrame, layers: Iterable[Layer] = (), geometry: str = "geometry", extent: int = T.EXTENT, mercator: bool = False, restart: bool = False) -> DataFrame:
    """(z, x, y, layer, id, class, commands, props) of features with tiles; those without commands are left out."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    shape = F.col(geometry)
    numbers = mvt.commands(shape["type"], mvt.local_geometry(shape, z, x, y, extent, mercator), restart)
    out = placed.select("z", "x", "y", "layer", "id", G.class_of(shape["type"]).alias("class"), numbers.alias("commands"), apply_property_rules(F.col("props"), F.col("layer"), z, layers).alias("props"))
    return out.where(F.size("commands") > 0)


#: The number of layers that a tile has which couldn't be written; its data is null.
FAILED = -1


#: Features as the shuffle by tile takes them: the fields before and after their tags written, their properties as texts.
PACKED = "z int, x bigint, y bigint, layer string, id bigint, head binary, tail binary, props array<string>"


def _kept_properties(props: pa.ListArray, layer: pa.Array, z: np.ndarray, rules: dict[str, list[tuple[int, frozenset[str]]]]) -> pa.ListArray:
    """Coded properties without those that the layers' rules leave out."""
    coded, names = props.values.dictionary_encode(), layer.dictionary_encode()
    keys = [t.partition(mvt.SEPARATOR)[0] for t in coded.dictionary.to_pylist()]
    offsets = props.offsets.to_numpy()
    which, own = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(props)), np.diff(offsets))
    layers = names.indices.to_numpy(zero_copy_only=False)
    keep = np.ones(len(which), dtype=bool)
    for i, name in enumerate(names.dictionary.to_pylist()):
        for below, out in rules.get(name, ()):
            hit = ((layers == i) & (z < below))[own]
            keep[offsets[0] : offsets[-1]] &= ~(hit & np.array([k in out for k in keys], dtype=bool)[which[offsets[0] : offsets[-1]]])
    if keep.all():
        return props
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)).astype(np.int32)[offsets]), props.values.filter(pa.array(keep)))


def _packer(layers: Iterable[Layer], extent: int, restart: bool):
    rules = {one.name: [(r.below_zoom, frozenset(r.exclude)) for r in one.property_rules] for one in layers if one.property_rules}
    names = [x.split()[0] for x in PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, x, y, layer, number, kinds, parts, *bounds, props = batch.columns
            kind = packed.classes(kinds)
            drawn = packed.commands(kind, packed.flat(parts), tuple(b.to_numpy(zero_copy_only=False) for b in bounds), extent, restart)
            sizes = np.append(0, np.cumsum(packed.varint_sizes(drawn.values)))[drawn.offsets]
            ids = number.to_numpy(zero_copy_only=False)
            rows = np.arange(len(ids) + 1)
            none = packed.Numbers(np.zeros(0, dtype=np.int64), np.zeros(len(rows), dtype=np.int64))
            head = packed.prefixed(none, mvt.FEATURE_ID << 3, ids)
            tail = packed.prefixed(drawn, mvt.FEATURE_TYPE << 3, kind, mvt.FEATURE_GEOMETRY << 3 | 2, np.diff(sizes))
            kept = _kept_properties(props, layer, z.to_numpy(zero_copy_only=False), rules) if rules else props
            out = pa.RecordBatch.from_arrays([z, x, y, layer, number, packed.varints(*head), packed.varints(*tail), kept], names=names)
            yield out.filter(pa.array(np.diff(drawn.offsets) > 0))

    return pack


def _writer(extent: int, skip_failed: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("z", "x", "y", "tile_data", "n_features", "n_layers")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
        tile: tuple | None = None
        layers: list[mvt.LayerWriter] = []
        failed = False

        def finished() -> tuple:
            if not failed:
                try:
                    return (*tile, mvt.compressed(mvt.tile_message(layers)), sum(w.count for w in layers), len(layers))
                except (ValueError, OverflowError) as error:
                    give_up(error)
            return (*tile, None, 0, FAILED)

        def give_up(error: Exception) -> None:
            nonlocal failed
            if not skip_failed:
                raise error
            failed = True
            print(f"tile {tile}: {error}", file=sys.stderr)

        for batch in batches:
            done = []
            *places, props = batch.columns
            texts, offsets = props.values.to_numpy(zero_copy_only=False).tolist(), props.offsets.to_pylist()
            for i, (z, x, y, layer, head, tail) in enumerate(zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in places), strict=True)):
                if tile != (z, x, y):
                    if tile is not None:
                        done.append(finished())
                    tile, layers, failed = (z, x, y), [], False
                if not layers or layers[-1].name != layer:
                    layers.append(mvt.LayerWriter(layer, extent))
                try:
                    layers[-1].add_packed(head, tail, texts[offsets[i] : offsets[i + 1]])
                except (ValueError, OverflowError) as error:
                    give_up(error)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
        if tile is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(finished(), kinds, strict=True)], names=names)

    return write


def coded(features: DataFrame) -> DataFrame:
    """Features with their properties as the writer takes them: made once, before zooms and tiles multiply them."""
    return features.withColumn("props", mvt.coded_properties(F.col("props"))) if dict(features.dtypes)["props"].startswith("map") else features


def encode(placed: DataFrame, layers: Iterable[Layer] = (), geometry: str = "geometry", extent: int = T.EXTENT, mercator: bool = False, restart: bool = False, skip_failed: bool = False) -> DataFrame:
    """Tiles of features with tiles: one shuffle by tile, sorted by layer and id, so that equal features give equal bytes.

    skip_failed: a tile that can't be written has null data and FAILED as its number of layers; otherwise it fails the job.
    """
    z, x, y, shape = F.col("z"), F.col("x"), F.col("y"), F.col(geometry)
    parts = shape["parts"]
    bounds = T.tile_bounds(z, x, y)
    north, south = bounds["max_lat"], bounds["min_lat"]
    if mercator:
        # Heights within the tile, as latitudes from 0 down to -1.
        down = lambda p: F.struct(p["x"].alias("x"), (-T.down_tile_mercator(p["y"], y, z)).alias("y"))
        parts = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, down)))
        north, south = F.lit(0.0), F.lit(-1.0)
    rows = coded(placed).select(z.cast("int").alias("z"), "x", "y", "layer", "id", shape["type"].alias("kind"), parts.alias("parts"), bounds["min_lon"].alias("west"), south.alias("south"), bounds["max_lon"].alias("east"), north.alias("north"), "props")
    shapes_ = rows.where("parts IS NOT NULL").mapInArrow(_packer(layers, extent, restart), PACKED)
    sorted_ = shapes_.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "layer", "id")
    return sorted_.select("z", "x", "y", "layer", "head", "tail", "props").mapInArrow(_writer(extent, skip_failed), TILES)


DECODED = "z int, x bigint, y bigint, layer string, id bigint, class int, commands array<bigint>, properties string"
#: Features that are read back at once.
FEATURES_READ = 10_000


def decoded(tiles: DataFrame, *columns: str) -> DataFrame:
    """(z, x, y, layer, id, class, commands, properties) of every feature in tile data, or these of the columns; properties as JSON text."""
    fields = [x for x in DECODED.split(", ") if not columns or x.split()[0] in columns]
    names = [x.split()[0] for x in fields]

    def made(place: tuple, layer: dict, f: mvt.Features) -> pa.RecordBatch:
        rows = len(f.ids)
        tags = lambda i: f.tags.values[f.tags.offsets[i] : f.tags.offsets[i + 1]].tolist()
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), rows)
        kinds = dict(zip(("z", "x", "y"), (pa.int32(), pa.int64(), pa.int64()), strict=True))
        of = {
            **{k: lambda v=v, k=k: same(v, kinds[k]) for k, v in zip(kinds, place, strict=True)},
            "layer": lambda: same(layer["name"], pa.string()),
            "id": lambda: pa.array(f.ids),
            "class": lambda: pa.array(f.kinds.astype(np.int32)),
            "commands": lambda: pa.ListArray.from_arrays(pa.array(f.commands.offsets.astype(np.int32)), pa.array(f.commands.values)),
            "properties": lambda: pa.array([json.dumps({layer["keys"][k]: layer["values"][v] for k, v in zip(t[::2], t[1::2], strict=True)}, sort_keys=True) for t in map(tags, range(rows))], pa.string()),
        }
        return pa.RecordBatch.from_arrays([of[n]() for n in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for *place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for layer, raw, starts, ends in mvt.tile_layers(data):
                    for at in range(0, len(starts), FEATURES_READ):
                        held.append(made(place, layer, mvt.features_of(raw, starts[at : at + FEATURES_READ], ends[at : at + FEATURES_READ])))
                        rows += held[-1].num_rows
                        if rows >= FEATURES_READ:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return tiles.select("z", "x", "y", "tile_data").where("tile_data IS NOT NULL").mapInArrow(read, ", ".join(fields))


PROPERTIES = "z int, x bigint, y bigint, layer string, id bigint, key string, type string, text string, number double"


def decoded_properties(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, id, key, type, text, number) of every property in tile data: texts and truth values as text, numbers as doubles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
        names = [x.split()[0] for x in PROPERTIES.split(", ")]
        types = {str: "string", bool: "bool", int: "int", float: "double"}
        for batch in batches:
            for place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for layer in mvt.decode_tile(place[3]):
                    for f in layer["features"]:
                        for key, value in f["properties"].items():
                            numeric = type(value) in (int, float)
                            text = None if numeric else str(value).lower() if type(value) is bool else value
                            rows.append((*place[:3], layer["name"], f["id"], key, types[type(value)], text, float(value) if numeric else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return tiles.select("z", "x", "y", "tile_data").where("tile_data IS NOT NULL").mapInArrow(read, PROPERTIES)
