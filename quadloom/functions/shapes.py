"""Shape algorithms that no built-in expresses, in Arrow batches: simplification, label points, well-known binary."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import packed
from .geometry import CLASSES, GEOMETRY

Ring = list[dict]


def kept_vertices(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the vertices that Douglas-Peucker keeps: an end, or farther than the tolerance from the chord of its stretch."""
    keep = np.zeros(len(x), dtype=bool)
    if len(x):
        keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        along = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
        far = np.hypot(px - along * dx, py - along * dy)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplified(geometry: dict | None, tolerance: float | None) -> dict | None:
    """Each line and ring simplified; points, and geometries without a positive tolerance, as they are."""
    if geometry is None or not tolerance or tolerance <= 0 or CLASSES.get(geometry["type"], 0) < 2:
        return geometry

    def run(ring: Ring) -> Ring:
        keep = kept_vertices(np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring]), tolerance)
        return [p for p, k in zip(ring, keep.tolist(), strict=True) if k]

    return {"type": geometry["type"], "parts": [[run(r) for r in part] for part in geometry["parts"]]}


def _widest_run(rings: list[Ring], y: float) -> tuple[float, float] | None:
    """(width, middle) of the widest stretch of a level line inside the rings."""
    cuts = []
    for ring in rings:
        for p, q in zip(ring, ring[1:], strict=False):
            if (p["y"] > y) != (q["y"] > y):
                cuts.append(p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]))
    cuts.sort()
    runs = [(b - a, (a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    return max(runs, default=None)


def label_point(geometry: dict | None) -> dict | None:
    """A point that lies on the geometry: of polygons in the widest stretch at mid-height, of lines the middle vertex."""
    if geometry is None or not geometry["parts"]:
        return None
    kind = CLASSES.get(geometry["type"], 0)
    if kind == 3:
        best = None
        for rings in geometry["parts"]:
            ys = sorted({p["y"] for r in rings for p in r})
            if len(ys) < 2:
                continue
            middle = (ys[0] + ys[-1]) / 2
            below, above = max(v for v in ys if v <= middle), min((v for v in ys if v > middle), default=ys[-1])
            level = middle if below < middle else (below + above) / 2  # not through a vertex
            found = _widest_run(rings, level)
            if found and (best is None or found[0] > best[0]):
                best = (*found, level)
        if best:
            return {"type": "Point", "parts": [[[{"x": best[1], "y": best[2]}]]]}
    points = [p for part in geometry["parts"] for r in part for p in r]
    if not points:
        return None
    return {"type": "Point", "parts": [[[points[len(points) // 2]]]]}


def from_wkb_bytes(data: bytes | None) -> dict | None:
    """A geometry of well-known binary, with or without an SRID; further dimensions are dropped. Null for other kinds."""
    if not data:
        return None
    at = 0

    def read(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def points(n: int) -> Ring:
        out = []
        for _ in range(n):
            x, y, *_ = read("d" * dimensions)
            out.append({"x": x, "y": y})
        return out

    def header() -> int:
        nonlocal at, order, dimensions
        order = "<" if data[at] else ">"
        at += 1
        (code,) = read("I")
        flags, base = code & 0xE0000000, code & 0x1FFFFFFF
        dimensions = 2 + bool(flags & 0x80000000) + bool(flags & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[base // 1000]
        if flags & 0x20000000:
            read("I")
        return base % 1000

    def body(kind: int) -> list:
        if kind == 1:
            return [[points(1)]]
        if kind == 2:
            return [[points(read("I")[0])]]
        if kind == 3:
            return [[points(read("I")[0]) for _ in range(read("I")[0])]]
        inner = [body(header()) for _ in range(read("I")[0])]
        return [part for x in inner for part in x] if kind == 6 else [[ring for x in inner for part in x for ring in part]]

    order, dimensions = "<", 2
    kind = header()
    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
    return {"type": names[kind], "parts": body(kind)} if kind in names else None


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_GEOMETRY = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_POINT))))])


def _arrow(function: Callable, column: Column) -> Column:
    def apply(rows: pa.Array) -> pa.Array:
        return pa.array([function(row) for row in rows.to_pylist()], ARROW_GEOMETRY)

    return F.arrow_udf(lambda a: apply(a), GEOMETRY)(column)


def simplify(geometry: Column, tolerance: Column) -> Column:
    """simplified() of whole batches."""
    return F.arrow_udf(lambda g, t: packed.simplified(g, t, ARROW_GEOMETRY), GEOMETRY)(geometry, tolerance)


def point_on_surface(geometry: Column) -> Column:
    return _arrow(label_point, geometry)


def from_wkb(data: Column) -> Column:
    return _arrow(from_wkb_bytes, data)
