"""Vector-tile encoding: geometry commands and typed values as columns, protobuf writing and reading in Python.

Message and field numbers are those of the public Mapbox Vector Tile specification, version 2.
"""

from __future__ import annotations

import gzip
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import packed
from .geometry import class_of, let
from .tiles import EXTENT, local_x, local_y, local_y_mercator, tile_bounds

VERSION = 2
#: Field numbers.
TILE_LAYER = 3
LAYER_NAME, LAYER_FEATURE, LAYER_KEY, LAYER_VALUE, LAYER_EXTENT, LAYER_VERSION = 1, 2, 3, 4, 5, 15
FEATURE_ID, FEATURE_TAGS, FEATURE_TYPE, FEATURE_GEOMETRY = 1, 2, 3, 4
VALUE_STRING, VALUE_FLOAT, VALUE_DOUBLE, VALUE_INT, VALUE_UINT, VALUE_SINT, VALUE_BOOL = 1, 2, 3, 4, 5, 6, 7
MOVE, LINE, CLOSE = 1, 2, 7
#: A property's value: its kind (s string, i integer, d double, b boolean, o JSON of anything else) and its text.
VALUE = "struct<kind: string, text: string>"


def command(kind: int, count: Column) -> Column:
    return F.shiftleft(count.cast("bigint"), 3).bitwiseOR(F.lit(kind).cast("bigint"))


def zigzag(n: Column) -> Column:
    """Of a 32-bit integer, as an unsigned number."""
    n = n.cast("int")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 31)).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def _zigzags(points: Column, cursor: Column) -> Column:
    """The zigzag coded steps along points from a cursor, flat."""
    before = F.concat(F.array(cursor), F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))))
    return F.flatten(F.zip_with(points, F.slice(before, F.lit(1), F.size(points)), lambda p, c: F.array(zigzag(p["x"] - c["x"]), zigzag(p["y"] - c["y"]))))


def _origin() -> Column:
    return F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))


def local_geometry(geometry: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, mercator: bool = False) -> Column:
    """The parts with integer coordinates in the tile."""

    def placed(bounds: Column) -> Column:
        down = (lambda p: local_y_mercator(p["y"], y, z, extent)) if mercator else (lambda p: local_y(p["y"], bounds, extent))
        place = lambda p: F.struct(local_x(p["x"], bounds, extent).alias("x"), down(p).alias("y"))
        return F.transform(geometry["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, place)))

    return let(tile_bounds(z, x, y), placed)


def commands(kind: Column, parts: Column, restart: bool = False) -> Column:
    """The command integers of a geometry in tile coordinates.

    The cursor runs on from part to part as the specification says; restart: every part starts from the origin.
    A run of less than two points makes no commands; closed rings leave out their last point and are closed.
    """
    cls = class_of(kind)
    none = F.array().cast("array<bigint>")
    closed = lambda r: (cls == 3) & (F.element_at(r, 1) == F.element_at(r, -1))
    drawn = F.transform(F.filter(F.flatten(parts), lambda r: F.size(r) >= 2), lambda r: F.struct(F.when(closed(r), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r).alias("p"), closed(r).alias("closed")))

    def of_points(points: Column) -> Column:
        return F.when(F.size(points) > 0, F.concat(F.array(command(MOVE, F.size(points))), _zigzags(points, _origin()))).otherwise(none)

    def of_runs(runs: Column) -> Column:
        def run(r: Column, i: Column) -> Column:
            cursor = _origin() if restart else F.when(i > 0, F.element_at(F.element_at(runs, F.greatest(i, F.lit(1)).cast("int"))["p"], -1)).otherwise(_origin())
            lines = F.size(r["p"]) - 1
            end = F.when(r["closed"], F.array(command(CLOSE, F.lit(1)))).otherwise(none)

            def written(steps: Column) -> Column:
                rest = F.when(lines > 0, F.concat(F.array(command(LINE, lines)), F.slice(steps, F.lit(3), F.greatest(F.size(steps) - 2, F.lit(0))))).otherwise(none)
                return F.concat(F.array(command(MOVE, F.lit(1))), F.slice(steps, 1, 2), rest, end)

            return let(_zigzags(r["p"], cursor), written)

        return F.flatten(F.transform(runs, run))

    return F.when(cls == 1, let(F.flatten(F.flatten(parts)), of_points)).when(cls > 1, let(drawn, of_runs)).otherwise(none)


def typed_value(column: Column, kind: str) -> Column:
    """A column of a Spark type (its simple name) as VALUE: whole numbers are integers whatever their type, null is JSON's null."""
    if kind == "string":
        value = F.struct(F.lit("s").alias("kind"), column.alias("text"))
    elif kind == "boolean":
        value = F.struct(F.lit("b").alias("kind"), column.cast("string").alias("text"))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        value = F.struct(F.lit("i").alias("kind"), column.cast("string").alias("text"))
    elif kind in ("float", "double") or kind.startswith("decimal"):
        d = column.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 9.2e18)
        value = F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.struct(F.lit("s").alias("kind"), d.cast("string").alias("text"))).otherwise(F.struct(F.when(whole, "i").otherwise("d").alias("kind"), F.when(whole, F.when(whole, d).otherwise(0.0).cast("bigint").cast("string")).otherwise(d.cast("string")).alias("text")))
    elif kind == "date" or kind.startswith("timestamp"):
        iso = "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss"
        value = F.struct(F.lit("s").alias("kind"), F.date_format(column, iso).alias("text"))
    elif kind.startswith(("array", "struct", "map")):
        value = F.struct(F.lit("o").alias("kind"), F.to_json(column).alias("text"))
    else:
        value = F.struct(F.lit("s").alias("kind"), column.cast("string").alias("text"))
    return F.when(column.isNotNull(), value).otherwise(F.struct(F.lit("o").alias("kind"), F.lit("null").alias("text"))).cast(VALUE)


def dictionary_key(value: Column) -> Column:
    """What tells values apart in a layer's dictionary: s:, n:, b: or o: and the text."""
    prefix = F.when(value["kind"].isin("i", "d"), "n:").otherwise(F.concat(value["kind"], F.lit(":")))
    return F.concat(prefix, value["text"])


#: Parts a coded property's name from its value.
SEPARATOR = "\0"


def coded_properties(props: Column) -> Column:
    """A feature's properties as texts of name, kind and value, sorted by name: what the writer takes."""
    return F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit(SEPARATOR), e["value"]["kind"], e["value"]["text"]))


# Writing


def _varint(n: int) -> bytes:
    """Numbers below 2^14, nearly all that tiles hold, come from a table."""
    if 0 <= n < len(_SMALL):
        return _SMALL[n]
    return _long_varint(n)


def _long_varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_SMALL = [_long_varint(n) for n in range(1 << 14)]


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _packed(field: int, numbers: list[int]) -> bytes:
    return _bytes(field, b"".join(map(_varint, numbers)))


def value_message(kind: str, text: str) -> bytes:
    if kind == "i":
        return _number(VALUE_INT, int(text))
    if kind == "d":
        return _varint(VALUE_DOUBLE << 3 | 1) + struct.pack("<d", float(text))
    if kind == "b":
        return _number(VALUE_BOOL, text == "true")
    return _bytes(VALUE_STRING, text.encode())


class LayerWriter:
    """One layer's message, feature by feature: keys and values are numbered as they first occur."""

    def __init__(self, name: str, extent: int = EXTENT):
        self.name, self.extent, self.features, self.count = name, extent, bytearray(), 0
        self.keys: dict[str, int] = {}
        self.values: dict[tuple[str, str], int] = {}
        self.tags: dict[str, bytes] = {}

    def add(self, feature_id: int, kind: int, geometry: list[int], properties: dict[str, tuple[str, str]]) -> None:
        self.add_coded(feature_id, kind, geometry, [f"{k}{SEPARATOR}{a}{b}" for k, (a, b) in sorted(properties.items())])

    def add_coded(self, feature_id: int, kind: int, geometry: list[int], properties: list[str]) -> None:
        """properties: as coded_properties() makes them."""
        self.add_packed(_number(FEATURE_ID, feature_id), _number(FEATURE_TYPE, kind) + _packed(FEATURE_GEOMETRY, geometry), properties)

    def add_packed(self, before: bytes, after: bytes, properties: list[str]) -> None:
        """before, after: the fields before the tags and those after them, written."""
        known = self.tags
        tags = b"".join([known[p] if p in known else self._learn(p) for p in properties])
        if tags:
            before += _TAGS + _varint(len(tags)) + tags
        self.features += _FEATURE + _varint(len(before) + len(after)) + before + after
        self.count += 1

    def _learn(self, coded: str) -> bytes:
        """The two tags of a property, packed."""
        key, _, value = coded.partition(SEPARATOR)
        self.tags[coded] = out = _varint(self.keys.setdefault(key, len(self.keys))) + _varint(self.values.setdefault((value[:1], value[1:]), len(self.values)))
        return out

    def parts(self) -> list[bytes | bytearray]:
        """What the message is made of."""
        rest = [*(_bytes(LAYER_KEY, k.encode()) for k in self.keys), *(_bytes(LAYER_VALUE, value_message(*v)) for v in self.values)]
        return [_bytes(LAYER_NAME, self.name.encode()), self.features, b"".join([*rest, _number(LAYER_EXTENT, self.extent), _number(LAYER_VERSION, VERSION)])]


_TAGS, _FEATURE = _varint(FEATURE_TAGS << 3 | 2), _varint(LAYER_FEATURE << 3 | 2)


def tile_message(layers: list[LayerWriter]) -> bytes:
    out = []
    for layer in layers:
        if layer.count:
            parts = layer.parts()
            out += [_varint(TILE_LAYER << 3 | 2) + _varint(sum(map(len, parts))), *parts]
    return b"".join(out)


def compressed(data: bytes) -> bytes:
    """gzip at its usual level, without a time, so that equal tiles are equal bytes."""
    return gzip.compress(data, 6, mtime=0)


# Reading


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; fixed-size and length-delimited values as bytes."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _read_varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _read_varint(data, at)
        out.append(n)
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _value(data: bytes) -> object:
    for field, value in fields(data):
        if field == VALUE_STRING:
            return value.decode()
        if field == VALUE_FLOAT:
            return struct.unpack("<f", value)[0]
        if field == VALUE_DOUBLE:
            return struct.unpack("<d", value)[0]
        if field == VALUE_INT:
            return _signed(value)
        if field == VALUE_UINT:
            return value
        if field == VALUE_SINT:
            return (value >> 1) ^ -(value & 1)
        if field == VALUE_BOOL:
            return bool(value)
    return None


def decode_commands(numbers: list[int]) -> list[list[tuple[int, int]]]:
    """The runs of points that commands draw; closed runs end where they began."""
    runs: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(numbers):
        kind, count = numbers[at] & 7, numbers[at] >> 3
        at += 1
        if kind == CLOSE:
            runs[-1].append(runs[-1][0])
            continue
        for _ in range(count):
            x += (numbers[at] >> 1) ^ -(numbers[at] & 1)
            y += (numbers[at + 1] >> 1) ^ -(numbers[at + 1] & 1)
            at += 2
            if kind == MOVE:
                runs.append([(x, y)])
            else:
                runs[-1].append((x, y))
    return runs


def tile_layers(data: bytes) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """The layers of a tile (compressed or not): name, version, extent, keys and values; its bytes, and where the layer's features start and end in them."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    raw, at = np.frombuffer(data, dtype=np.uint8), 0
    while at < len(data):
        key, at = _read_varint(data, at)
        if key != TILE_LAYER << 3 | 2:
            at = _skipped(data, key & 7, at)
            continue
        size, at = _read_varint(data, at)
        end, starts, ends = at + size, array("q"), array("q")
        layer = {"name": "", "version": 1, "extent": EXTENT, "keys": [], "values": []}
        while at < end:
            key, at = _read_varint(data, at)
            if key & 7 != 2:
                value, at = _read_varint(data, at) if key & 7 == 0 else (None, _skipped(data, key & 7, at))
                if key >> 3 in (LAYER_EXTENT, LAYER_VERSION):
                    layer["extent" if key >> 3 == LAYER_EXTENT else "version"] = value
                continue
            size, at = _read_varint(data, at)
            if key >> 3 == LAYER_FEATURE:
                starts.append(at)
                ends.append(at + size)
            elif key >> 3 == LAYER_NAME:
                layer["name"] = data[at : at + size].decode()
            elif key >> 3 == LAYER_KEY:
                layer["keys"].append(data[at : at + size].decode())
            elif key >> 3 == LAYER_VALUE:
                layer["values"].append(_value(data[at : at + size]))
            at += size
        yield layer, raw, np.frombuffer(starts, dtype=np.int64), np.frombuffer(ends, dtype=np.int64)


def _skipped(data: bytes, wire: int, at: int) -> int:
    """The place after a value."""
    if wire in (0, 2):
        value, at = _read_varint(data, at)
    return at + {0: 0, 1: 8, 5: 4}[wire] if wire != 2 else at + value


class Features(NamedTuple):
    """Features of a layer as arrays: ids, classes, commands and tags."""

    ids: np.ndarray
    kinds: np.ndarray
    commands: packed.Numbers
    tags: packed.Numbers


def features_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Features:
    none = lambda: np.zeros(len(starts), dtype=np.int64)
    numbers, spans = {FEATURE_ID: none(), FEATURE_TYPE: none()}, {FEATURE_TAGS: (none(), none()), FEATURE_GEOMETRY: (none(), none())}
    packed.read_fields(raw, starts, ends, numbers, spans)
    return Features(*numbers.values(), packed.packed_numbers(raw, *spans[FEATURE_GEOMETRY]), packed.packed_numbers(raw, *spans[FEATURE_TAGS]))


def decode_tile(data: bytes) -> list[dict]:
    """The layers of a tile (compressed or not): name, version, extent, features with id, type, geometry, properties."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    layers = []
    for field, body in fields(data):
        if field != TILE_LAYER:
            continue
        layer = {"name": "", "version": 1, "extent": EXTENT, "features": []}
        keys, values, raw = [], [], []
        for f, v in fields(body):
            if f == LAYER_NAME:
                layer["name"] = v.decode()
            elif f == LAYER_FEATURE:
                raw.append(v)
            elif f == LAYER_KEY:
                keys.append(v.decode())
            elif f == LAYER_VALUE:
                values.append(_value(v))
            elif f == LAYER_EXTENT:
                layer["extent"] = v
            elif f == LAYER_VERSION:
                layer["version"] = v
        for body_ in raw:
            own = dict(fields(body_))
            tags = _numbers(own.get(FEATURE_TAGS, b""))
            layer["features"].append({"id": _signed(own.get(FEATURE_ID, 0)), "type": own.get(FEATURE_TYPE, 0), "commands": _numbers(own.get(FEATURE_GEOMETRY, b"")), "properties": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}})
        layers.append(layer)
    return layers
