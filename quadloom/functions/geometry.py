"""Geometry columns: struct<type, parts: polygons of rings of points>.

A point is parts[0][0][0], a line parts[0][0], the points or lines of a multi-geometry parts[0][i], a polygon's rings
parts[0], the polygons of a multi-polygon parts. All predicates are higher-order functions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"
GEOMETRY = f"struct<type: string, parts: array<array<array<{POINT}>>>>"
#: Kinds, and the class of each that tiles encode.
CLASSES = {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 3, "MultiPolygon": 3}


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts")).cast(GEOMETRY)


def point(lon: Column, lat: Column) -> Column:
    """A point; null if a coordinate is."""
    return F.when(lon.isNotNull() & lat.isNotNull(), _geometry("Point", F.array(F.array(F.array(_xy(lon, lat))))))


def line(points: list[tuple[Column, Column]]) -> Column:
    known = F.lit(True)
    for x, y in points:
        known = known & x.isNotNull() & y.isNotNull()
    return F.when(known, _geometry("LineString", F.array(F.array(F.array(*(_xy(x, y) for x, y in points))))))


def box(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """A rectangle as a closed polygon; null if a bound is."""
    known = min_lon.isNotNull() & min_lat.isNotNull() & max_lon.isNotNull() & max_lat.isNotNull()
    ring = F.array(_xy(min_lon, min_lat), _xy(max_lon, min_lat), _xy(max_lon, max_lat), _xy(min_lon, max_lat), _xy(min_lon, min_lat))
    return F.when(known, _geometry("Polygon", F.array(F.array(ring))))


def class_of(kind: Column) -> Column:
    """1 points, 2 lines, 3 polygons, 0 anything else."""
    out = F.lit(0)
    for number in (1, 2, 3):
        out = F.when(kind.isin([k for k, c in CLASSES.items() if c == number]), number).otherwise(out)
    return F.coalesce(out, F.lit(0))


def all_points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry["parts"]))


def bbox(geometry: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat); null for a null or empty geometry."""

    def bounds(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        found = F.struct(F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat"))
        return F.when(F.size(points) > 0, found)

    return let(all_points(geometry), bounds)


def segments(ring: Column) -> Column:
    """The edges of a run of points as structs (a, b)."""
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), count), F.slice(ring, F.lit(2), count), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _in_box(p: Column, b: Column) -> Column:
    return (p["x"] >= b["min_lon"]) & (p["x"] <= b["max_lon"]) & (p["y"] >= b["min_lat"]) & (p["y"] <= b["max_lat"])


def segment_meets_box(a: Column, c: Column, b: Column) -> Column:
    """Whether the segment from a to c touches the closed box b: no axis, nor the segment's normal, separates them."""
    overlap = (F.least(a["x"], c["x"]) <= b["max_lon"]) & (F.greatest(a["x"], c["x"]) >= b["min_lon"]) & (F.least(a["y"], c["y"]) <= b["max_lat"]) & (F.greatest(a["y"], c["y"]) >= b["min_lat"])
    side = lambda x, y: (c["x"] - a["x"]) * (y - a["y"]) - (c["y"] - a["y"]) * (x - a["x"])
    corners = [side(b[x], b[y]) for x in ("min_lon", "max_lon") for y in ("min_lat", "max_lat")]
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _covers(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a place lies in a polygon's rings, by the parity of crossings to its east; holes count as crossings do."""
    crossed = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"])
    crossings = F.aggregate(polygon, F.lit(0), lambda n, ring: n + F.size(F.filter(segments(ring), crossed)))
    return crossings % 2 == 1


def intersects_box(geometry: Column, b: Column) -> Column:
    """Closed intersection of a geometry with a box; bounding boxes are enough for points and are tried first for all."""

    def meets(b: Column) -> Column:
        near = let(bbox(geometry), lambda own: (own["min_lon"] <= b["max_lon"]) & (own["max_lon"] >= b["min_lon"]) & (own["min_lat"] <= b["max_lat"]) & (own["max_lat"] >= b["min_lat"]))
        kind = class_of(geometry["type"])
        some_point = F.exists(all_points(geometry), lambda p: _in_box(p, b))
        some_edge = F.exists(F.flatten(geometry["parts"]), lambda ring: F.exists(segments(ring), lambda s: segment_meets_box(s["a"], s["b"], b)))
        inside = F.exists(geometry["parts"], lambda polygon: _covers(polygon, b["min_lon"], b["min_lat"]))
        return near & (some_point | ((kind >= 2) & some_edge) | ((kind == 3) & inside))

    return let(b, meets)


def boundary(geometry: Column) -> Column:
    """Polygons' rings as lines; a line's two ends as points; null for points."""
    rings = F.flatten(geometry["parts"])
    kind = class_of(geometry["type"])
    many = F.when(F.size(rings) == 1, "LineString").otherwise("MultiLineString")
    of_area = F.struct(many.alias("type"), F.array(rings).alias("parts")).cast(GEOMETRY)
    open_lines = F.filter(rings, lambda r: F.element_at(r, 1) != F.element_at(r, -1))
    ends = F.transform(F.flatten(F.transform(open_lines, lambda r: F.array(F.element_at(r, 1), F.element_at(r, -1)))), lambda p: F.array(p))
    of_line = F.struct(F.lit("MultiPoint").alias("type"), F.array(ends).alias("parts")).cast(GEOMETRY)
    return F.when(kind == 3, of_area).when((kind == 2) & (F.size(open_lines) > 0), of_line)


def close_rings(geometry: Column) -> Column:
    """Polygons with every ring ending where it began."""
    closed = lambda r: F.when((F.size(r) > 0) & (F.element_at(r, 1) != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    parts = F.transform(geometry["parts"], lambda p: F.transform(p, closed))
    return F.when(class_of(geometry["type"]) == 3, F.struct(geometry["type"].alias("type"), parts.alias("parts")).cast(GEOMETRY)).otherwise(geometry)


def _points(pairs: Column) -> Column:
    """Points of coordinate lists; those without two finite numbers are left out."""
    good = F.filter(pairs, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.transform(good, lambda p: _xy(p[0], p[1]))


def from_coordinates(kind: Column, coordinates: Column) -> Column:
    """A geometry of its kind and its coordinates as JSON; null for kinds unknown and coordinates that don't parse.

    Lines and rings need two points; bad inner rings are left out, a bad outer ring makes the polygon bad.
    """
    read = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    runs = lambda x: F.filter(F.transform(x, _points), lambda r: F.size(r) >= 2)
    solid = lambda x: F.filter(F.transform(x, lambda p: F.when(F.size(_points(p[0])) >= 2, runs(p))), lambda p: p.isNotNull() & (F.size(p) > 0))
    singles = F.transform(_points(read(2)), lambda p: F.array(p))
    parts = (
        F.when(kind == "Point", F.array(F.array(_points(F.array(read(1))))))
        .when(kind == "MultiPoint", F.array(singles))
        .when(kind == "LineString", F.array(runs(F.array(read(2)))))
        .when(kind == "MultiLineString", F.array(runs(read(3))))
        .when(kind == "Polygon", solid(F.array(read(3))))
        .when(kind == "MultiPolygon", solid(read(4)))
    )
    made = lambda g: F.when(F.size(all_points(g)) > 0, close_rings(g))
    return let(F.struct(kind.alias("type"), parts.alias("parts")).cast(GEOMETRY), made)


def from_geojson(text: Column) -> Column:
    return from_coordinates(F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates"))


def from_wkt(text: Column) -> Column:
    """Of well-known text in two dimensions."""
    kinds = {k.upper(): k for k in CLASSES}
    word = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)\s*\(", 1))
    kind = F.lit(None).cast("string")
    for upper, name in kinds.items():
        kind = F.when(word == upper, name).otherwise(kind)
    body = F.regexp_extract(text, r"^\s*[A-Za-z]+\s*(\(.*\))\s*$", 1)
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    pairs = F.regexp_replace(body, rf"({number})\s+({number})", "[$1,$2]")
    loose = F.regexp_replace(pairs, r"\((\[[^\[\]()]*\])\)", "$1")  # points of a multi-point may stand in parentheses
    listed = F.translate(F.when(word == "MULTIPOINT", F.concat(F.lit("("), F.regexp_replace(F.translate(pairs, "()", ""), r"^", ""), F.lit(")"))).when(word == "POINT", loose).otherwise(pairs), "()", "[]")
    return from_coordinates(kind, listed)


def to_geojson(geometry: Column) -> Column:
    """The geometry as a GeoJSON object's text."""
    kind, parts = geometry["type"], geometry["parts"]
    pair = lambda p: F.array(p["x"], p["y"])
    run = lambda r: F.transform(r, pair)
    text = (
        F.when(kind == "Point", F.to_json(pair(parts[0][0][0])))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts[0], lambda r: pair(r[0]))))
        .when(kind == "LineString", F.to_json(run(parts[0][0])))
        .when(kind.isin("MultiLineString", "Polygon"), F.to_json(F.transform(parts[0], run)))
        .when(kind == "MultiPolygon", F.to_json(F.transform(parts, lambda p: F.transform(p, run))))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}"))


def from_web_mercator(geometry: Column) -> Column:
    """Degrees of a geometry in metres of the spherical Web Mercator projection."""
    radius = 6378137.0
    degrees = lambda p: _xy(F.degrees(p["x"] / radius), F.degrees(F.atan(F.sinh(p["y"] / radius))))
    parts = F.transform(geometry["parts"], lambda a: F.transform(a, lambda r: F.transform(r, degrees)))
    return F.struct(geometry["type"].alias("type"), parts.alias("parts")).cast(GEOMETRY)


def to_degrees(geometry: Column, srid: int) -> Column:
    """The geometry in degrees; projections other than 4326 and 3857 raise."""
    if srid == 4326:
        return geometry
    if srid in (3857, 900913):
        return F.when(geometry.isNotNull(), from_web_mercator(geometry))
    raise ValueError(f"no transformation from {srid} to 4326 here")
