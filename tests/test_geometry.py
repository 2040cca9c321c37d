import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.functions import geometry as G
from quadloom.functions import shapes

TEXTS = {
    "Point": "[1.5, 2.0]",
    "MultiPoint": "[[1.0, 2.0], [3.0, 4.0]]",
    "LineString": "[[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]]",
    "MultiLineString": "[[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 7.0]]]",
    "Polygon": "[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]]",
    "MultiPolygon": "[[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 5.0]]]]",
}


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", G.from_geojson(F.col("t")).alias("g"))


def test_geojson_round_trip(spark):
    texts = [f'{{"type": "{k}", "coordinates": {c}}}' for k, c in TEXTS.items()]
    out = read(spark, texts).select("i", G.to_geojson(F.col("g")).alias("t"), G.class_of(F.col("g.type")).alias("c")).orderBy("i").collect()
    assert [json.loads(r.t) for r in out] == [json.loads(t) for t in texts]
    assert [r.c for r in out] == [1, 1, 2, 2, 3, 3]


def test_bad_geometries(spark):
    texts = ['{"type":"GeometryCollection","geometries":[]}', '{"type":"LineString","coordinates":[[1,2]]}', "nonsense", None, '{"type":"Polygon","coordinates":[[[0,0]]]}', "{}"]
    assert [r.g for r in read(spark, texts).orderBy("i").collect()] == [None] * 6
    kept = read(spark, ['{"type":"LineString","coordinates":[[1,2],[3],[4,5]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[9]]]}']).orderBy("i").collect()
    assert len(kept[0].g.parts[0][0]) == 2
    assert len(kept[1].g.parts[0]) == 1 and kept[1].g.parts[0][0][0] == kept[1].g.parts[0][0][-1]  # closed


def test_class_of_unknown_kinds(spark):
    df = spark.createDataFrame([("Circle",), (None,)], "k string")
    assert [r[0] for r in df.select(G.class_of(F.col("k"))).collect()] == [0, 0]


def test_wkt_and_wkb(spark):
    rows = [
        ("POINT (1 2)", "Point", [1, 2], struct.pack("<BIdd", 1, 1, 1, 2)),
        ("LINESTRING(0 0, 1 1.5)", "LineString", [[0, 0], [1, 1.5]], struct.pack("<BIIdddd", 1, 2, 2, 0, 0, 1, 1.5)),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0))", "Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]], struct.pack(">BIIIdddddddd", 0, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)),
        ("MULTIPOINT ((1 2), (3 4))", "MultiPoint", [[1, 2], [3, 4]], struct.pack("<BII", 1, 4, 2) + struct.pack("<BIdd", 1, 1, 1, 2) + struct.pack("<BIdd", 1, 1, 3, 4)),
        ("MULTIPOINT (1 2, 3 4)", "MultiPoint", [[1, 2], [3, 4]], struct.pack("<BIIII", 1, 0x20000004, 4326, 1, 0)[:13] + struct.pack("<BIdd", 1, 1, 1, 2)),
        ("MULTILINESTRING((0 0,1 1),(2 2,3 -3e0))", "MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, -3]]], None),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]], None),
        ("CIRCLE (1 2)", None, None, struct.pack("<BI", 1, 17)),
    ]
    df = spark.createDataFrame([(i, r[0], r[3]) for i, r in enumerate(rows)], "i int, t string, b binary")
    out = df.select("i", G.to_geojson(G.from_wkt(F.col("t"))).alias("t"), G.to_geojson(shapes.from_wkb(F.col("b"))).alias("b")).orderBy("i").collect()
    for r, (_, kind, coordinates, data) in zip(out, rows, strict=True):
        want = None if kind is None else {"type": kind, "coordinates": coordinates}
        assert (json.loads(r.t) if r.t else None) == want
        if data is not None and r.i != 4:
            assert (json.loads(r.b) if r.b else None) == want


BOX = {"min_lon": 0.0, "min_lat": 0.0, "max_lon": 1.0, "max_lat": 1.0}


@pytest.mark.parametrize(
    "text,meets",
    [
        ("POINT (1 1)", True),
        ("POINT (1.01 1)", False),
        ("LINESTRING (-1 0.5, 2 0.5)", True),  # through
        ("LINESTRING (-1 1.5, 1.5 4)", False),
        ("LINESTRING (-0.6 0.6, 0.6 1.8)", False),  # bounds overlap, the line passes a corner by
        ("LINESTRING (-1 1, 2 1)", True),  # along an edge
        ("LINESTRING (0 2, 2 0)", True),  # touches a corner
        ("POLYGON ((-5 -5, 5 -5, 5 5, -5 5, -5 -5))", True),  # holds the box
        ("POLYGON ((-5 -5, 5 -5, 5 5, -5 5, -5 -5), (-1 -1, 2 -1, 2 2, -1 2, -1 -1))", False),  # the box lies in its hole
        ("POLYGON ((0.2 0.2, 0.4 0.2, 0.4 0.4, 0.2 0.2))", True),
        ("POLYGON ((3 3, 4 3, 4 4, 3 3))", False),
        ("POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))", True),  # shares an edge
    ],
)
def test_closed_intersection(spark, text, meets):
    box = F.struct(*(F.lit(v).alias(k) for k, v in BOX.items()))
    assert spark.range(1).select(G.intersects_box(G.from_wkt(F.lit(text)), box)).first()[0] is meets


def test_bounds_and_boundary(spark):
    g = G.from_geojson(F.lit(f'{{"type": "Polygon", "coordinates": {TEXTS["Polygon"]}}}'))
    line = G.from_wkt(F.lit("LINESTRING (0 0, 5 1, 3 3)"))
    b, e, h, p = spark.range(1).select(G.bbox(g), G.boundary(g), G.boundary(line), G.boundary(G.from_wkt(F.lit("POINT (1 1)")))).first()
    assert tuple(b) == (0, 0, 10, 10)
    assert e.type == "MultiLineString" and len(e.parts[0]) == 2
    assert h.type == "MultiPoint" and [(r[0].x, r[0].y) for r in h.parts[0]] == [(0, 0), (3, 3)] and p is None


def test_web_mercator(spark):
    g = spark.range(1).select(G.to_degrees(G.from_wkt(F.lit("POINT (20037508.342789244 0)")), 3857)).first()[0]
    assert abs(g.parts[0][0][0].x - 180) < 1e-9 and abs(g.parts[0][0][0].y) < 1e-9
    with pytest.raises(ValueError):
        G.to_degrees(F.lit(None), 25832)


def test_simplification():
    line = {"type": "LineString", "parts": [[[{"x": x, "y": y} for x, y in [(0, 0), (0.5, 0.001), (1, 0)]]]]}
    assert len(shapes.simplified(line, 0.01)["parts"][0][0]) == 2
    assert shapes.simplified(line, None) is line and shapes.simplified(line, 0.0001) != {} and len(shapes.simplified(line, 0.0001)["parts"][0][0]) == 3
    ring = {"type": "Polygon", "parts": [[[{"x": x, "y": y} for x, y in [(0, 0), (0.5, 0.001), (1, 0), (1, 1), (0, 1), (0, 0)]]]]}
    assert len(shapes.simplified(ring, 0.01)["parts"][0][0]) < 6
    point = {"type": "Point", "parts": [[[{"x": 1, "y": 1}]]]}
    assert shapes.simplified(point, 5) is point
    rng = np.random.default_rng(0)
    x, y = np.arange(200.0), np.cumsum(rng.normal(size=200))
    keep = shapes.kept_vertices(x, y, 2.0)
    at = np.flatnonzero(keep)
    for i in range(200):  # nothing left out is farther than the tolerance from what stands for it
        a = at[np.searchsorted(at, i, "right") - 1]
        b = at[min(len(at) - 1, np.searchsorted(at, i, "left"))]
        if a != b:
            t = np.clip(((i - a) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a])) / ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2), 0, 1)
            assert np.hypot(x[i] - x[a] - t * (x[b] - x[a]), y[i] - y[a] - t * (y[b] - y[a])) <= 2.0 + 1e-9


def test_label_points_lie_inside(spark):
    text = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 9 1, 9 9, 1 9, 1 1))"
    df = spark.createDataFrame([(text,)], "t string")
    p = df.select(shapes.point_on_surface(G.from_wkt(F.col("t"))).alias("p")).first()[0].parts[0][0][0]
    assert 0 < p.x < 10 and 0 < p.y < 10 and not (1 < p.x < 9 and 1 < p.y < 9)
    assert shapes.label_point(None) is None
