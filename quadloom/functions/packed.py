"""Geometries and features of whole Arrow batches as NumPy arrays: simplified, drawn as commands, written as and read from protobuf bytes.

Results are those of the functions on single rows in mvt and shapes; a row costs some array operations in place of a walk through it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .geometry import CLASSES

LOWEST, HIGHEST = -2147483648.0, 2147483647.0


class Flat(NamedTuple):
    """The points of a column of parts, with the offsets of rows' parts, parts' rings and rings' points."""

    parts: np.ndarray
    rings: np.ndarray
    points: np.ndarray
    x: np.ndarray
    y: np.ndarray


def flat(parts: pa.ListArray) -> Flat:
    rings = parts.values
    points = rings.values
    at = points.values
    return Flat(*(a.offsets.to_numpy() for a in (parts, rings, points)), *(at.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)))


def classes(kinds: pa.Array) -> np.ndarray:
    """1 points, 2 lines, 3 polygons, 0 anything else."""
    coded = kinds.dictionary_encode()
    table = np.array([*(CLASSES.get(k, 0) for k in coded.dictionary.to_pylist()), 0], dtype=np.int64)
    return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + counts, counts)


def kept_vertices(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Mask of the points that Douglas-Peucker keeps of runs of points: all stretches of one depth are looked at together."""
    keep = np.zeros(len(x), dtype=bool)
    some = ends > starts
    keep[starts[some]] = keep[ends[some] - 1] = True
    a, b, most = starts, ends - 1, tolerance
    while True:
        long = b - a >= 2
        a, b, most = a[long], b[long], most[long]
        if not len(a):
            return keep
        inner = b - a - 1
        own, i = np.repeat(np.arange(len(a)), inner), ranges(a + 1, inner)
        dx, dy = (x[b] - x[a])[own], (y[b] - y[a])[own]
        px, py = x[i] - x[a][own], y[i] - y[a][own]
        length = dx * dx + dy * dy
        with np.errstate(all="ignore"):
            along = np.where(length != 0, np.clip((px * dx + py * dy) / length, 0, 1), 0.0)
            far = np.hypot(px - along * dx, py - along * dy)
        farthest = np.maximum.reduceat(far, np.cumsum(inner) - inner)
        hit = np.flatnonzero(far == farthest[own])
        hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])] if len(hit) else hit
        hit = hit[farthest[own[hit]] > most[own[hit]]]
        split, at = own[hit], i[hit]
        keep[at] = True
        a, b, most = np.concatenate([a[split], at]), np.concatenate([at, b[split]]), np.concatenate([most[split]] * 2)


def simplified(geometry: pa.StructArray, tolerance: pa.Array, kind: pa.DataType) -> pa.StructArray:
    """Each line and ring simplified; points, and geometries without a positive tolerance, as they are. kind: the result's type."""
    names, parts = geometry.field(0), geometry.field(1)
    f = flat(parts)
    by_row = np.nan_to_num(tolerance.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf)
    thin = (by_row > 0) & (classes(names) >= 2)
    row_rings = f.rings[f.parts]
    own = np.repeat(np.arange(len(geometry)), np.diff(row_rings))
    first, last = (int(row_rings[0]), int(row_rings[-1])) if len(geometry) else (0, 0)
    starts, ends = f.points[first:last].astype(np.int64), f.points[first + 1 : last + 1].astype(np.int64)
    chosen = thin[own]
    keep = np.ones(len(f.x), dtype=bool)
    for_all = ranges(starts[chosen], (ends - starts)[chosen])
    keep[for_all] = kept_vertices(f.x, f.y, starts[chosen], ends[chosen], by_row[own][chosen])[for_all]
    kept = np.append(0, np.cumsum(keep)).astype(np.int32)
    ring_type, point_type = kind.field(1).type.value_type, kind.field(1).type.value_type.value_type
    points = pa.StructArray.from_arrays([pa.array(f.x[keep]), pa.array(f.y[keep])], fields=list(point_type.value_type))
    rings = pa.ListArray.from_arrays(pa.array(kept[f.points]), points, type=point_type)
    made = pa.ListArray.from_arrays(pa.array(f.rings), rings, type=ring_type)
    lists = pa.ListArray.from_arrays(pa.array(f.parts), made, type=kind.field(1).type, mask=parts.is_null() if parts.null_count else None)
    return pa.StructArray.from_arrays([names, lists], fields=list(kind), mask=geometry.is_null() if geometry.null_count else None)


# Writing


def _local(value: np.ndarray) -> np.ndarray:
    """Towards zero, held within 32 bits; NaN is 0."""
    return np.where(np.isnan(value), 0.0, np.clip(value, LOWEST, HIGHEST)).astype(np.int64)


def _zigzag(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.int32).astype(np.int64)
    return ((n << 1) ^ (n >> 31)) & 0xFFFFFFFF


class Numbers(NamedTuple):
    """Lists of numbers, flat, with their offsets."""

    values: np.ndarray
    offsets: np.ndarray


def commands(kind: np.ndarray, f: Flat, bounds: tuple[np.ndarray, ...], extent: int, restart: bool = False) -> Numbers:
    """The command integers of each row, drawn in the tile of its bounds (west, south, east, north), as mvt.commands() has them."""
    rows = len(kind)
    row_rings = f.rings[f.parts].astype(np.int64)
    row_points = f.points[row_rings].astype(np.int64)
    base, top = (int(row_points[0]), int(row_points[-1])) if rows else (0, 0)
    own = np.repeat(np.arange(rows), np.diff(row_points))
    west, south, east, north = (b[own] for b in bounds)
    with np.errstate(all="ignore"):
        x = _local((f.x[base:top] - west) / (east - west) * float(extent))
        y = _local((north - f.y[base:top]) / (north - south) * float(extent))
    # Runs: all points of a row of points, each ring of other rows.
    single = np.flatnonzero((kind == 1) & (np.diff(row_points) > 0))
    ring_row = np.repeat(np.arange(rows), np.diff(row_rings))
    first, last = (int(row_rings[0]), int(row_rings[-1])) if rows else (0, 0)
    start, size = f.points[first:last].astype(np.int64) - base, np.diff(f.points[first : last + 1]).astype(np.int64)
    chosen = (kind[ring_row] >= 2) & (size >= 2)
    ring_row, start, size = ring_row[chosen], start[chosen], size[chosen]
    end = start + size - 1
    closed = (kind[ring_row] == 3) & (x[start] == x[end]) & (y[start] == y[end])
    row = np.concatenate([single, ring_row])
    order = np.argsort(row, kind="stable")
    row = row[order]
    start = np.concatenate([row_points[single] - base, start])[order]
    count = np.concatenate([np.diff(row_points)[single], size - closed])[order]
    closed = np.concatenate([np.zeros(len(single), dtype=bool), closed])[order]
    dots = kind[row] == 1
    # Steps from the point before; a run's first point from the end of the row's run before or the origin.
    place = ranges(start, count)
    run = np.repeat(np.arange(len(row)), count)
    heads = np.cumsum(count) - count
    fx, fy = x[place], y[place]
    bx, by = np.append(0, fx[:-1]), np.append(0, fy[:-1])
    fresh = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, dtype=bool)
    fresh = np.ones_like(fresh) if restart else fresh
    bx[heads[fresh]] = by[heads[fresh]] = 0
    length = np.where(dots, 1 + 2 * count, 3 + np.where(count > 1, 2 * count - 1, 0) + closed)
    at = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), dtype=np.int64)
    out[at] = np.where(dots, count << 3 | 1, 9)
    nth = np.arange(len(place)) - heads[run]
    to = at[run] + 1 + 2 * nth + (~dots[run] & (nth > 0))
    out[to], out[to + 1] = _zigzag(fx - bx), _zigzag(fy - by)
    lines = ~dots & (count > 1)
    out[at[lines] + 3] = (count[lines] - 1) << 3 | 2
    out[(at + length - 1)[closed]] = 15
    return Numbers(out, np.append(0, np.cumsum(np.bincount(row, weights=length, minlength=rows).astype(np.int64))))


def varint_sizes(numbers: np.ndarray) -> np.ndarray:
    n = numbers.astype(np.uint64)
    out = np.ones(len(n), dtype=np.int64)
    for k in range(1, 10):
        more = n >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        out += more
    return out


def varints(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Lists of numbers as the bytes of their varints; negative ones as unsigned numbers of 64 bits."""
    n = numbers.astype(np.uint64)
    sizes = varint_sizes(n)
    ends = np.append(0, np.cumsum(sizes))
    if ends[-1] > HIGHEST:
        raise OverflowError("a batch's geometry takes more than 2 GB")
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = np.flatnonzero(sizes > k)
        out[ends[has] + k] = (n[has] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int32)), pa.py_buffer(out)])


def prefixed(lists: Numbers, *before: np.ndarray) -> Numbers:
    """Lists with a number of each of some arrays put before."""
    k, rows = len(before), len(lists.offsets) - 1
    offsets = lists.offsets + k * np.arange(rows + 1)
    out = np.zeros(int(offsets[-1] - offsets[0]), dtype=np.int64)
    for i, b in enumerate(before):
        out[offsets[:-1] + i] = b
    counts = np.diff(lists.offsets)
    out[ranges(offsets[:-1] + k, counts)] = lists.values
    return Numbers(out, offsets)


# Reading


def read_varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, as a number of 64 bits, and the place after it."""
    value, at = np.zeros(len(at), dtype=np.uint64), at.copy()
    open_ = np.arange(len(at))
    for k in range(10):
        byte = data[at[open_]]
        value[open_] |= (byte & 127).astype(np.uint64) << np.uint64(7 * k)
        at[open_] += 1
        open_ = open_[byte > 127]
        if not len(open_):
            return value, at
    raise ValueError("a varint of more than ten bytes")


def packed_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Numbers:
    """The varints between each start and end."""
    sizes = ends - starts
    byte = data[ranges(starts, sizes)]
    last = byte < 128
    stops = np.flatnonzero(last)
    counts = np.append(0, np.cumsum(last))
    offsets = counts[np.append(0, np.cumsum(sizes))]
    if not len(stops):
        return Numbers(np.zeros(0, dtype=np.int64), offsets)
    begins = np.append(0, stops[:-1] + 1)
    nth = np.arange(len(byte)) - np.repeat(begins, stops - begins + 1)
    return Numbers(np.add.reduceat((byte & 127).astype(np.uint64) << (7 * nth).astype(np.uint64), begins).astype(np.int64), offsets)


def read_fields(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: dict[int, np.ndarray], spans: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Reads messages field by field, all of them together, into arrays by field: numbers, and the starts and ends of bytes."""
    at = starts.copy()
    while len(rows := np.flatnonzero(at < ends)):
        key, place = read_varints(data, at[rows])
        field, wire = (key >> np.uint64(3)).astype(np.int64), (key & np.uint64(7)).astype(np.int64)
        after = place + np.select([wire == 1, wire == 5], [8, 4], 0)
        coded = np.flatnonzero((wire == 0) | (wire == 2))
        value, behind = read_varints(data, place[coded])
        long = wire[coded] == 2
        after[coded] = behind + np.where(long, value, np.uint64(0)).astype(np.int64)
        for f, out in numbers.items():
            own = ~long & (field[coded] == f)
            out[rows[coded[own]]] = value[own].astype(np.int64)
        for f, (begin, end) in spans.items():
            own = long & (field[coded] == f)
            begin[rows[coded[own]]], end[rows[coded[own]]] = behind[own], after[coded[own]]
        at[rows] = after
